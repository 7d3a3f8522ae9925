"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut into chunks where its own characters say so. Chunks are grouped by a 64-bit hash and
length and compared byte by byte, which gives every chunk a verified identifier: the hash, the
length and a variant number that is 0 unless two different chunks share a hash. A document is then
its ordered list of identifiers, and documents are compared by that list, so a text is moved once,
in chunks of which repeated ones are merged ahead of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import SPACE_CLASS, keep_rows, staged

#: A chunk ends after a separator, one of some letters and a vowel or other letter, at 768 to 8192
#: characters, or else at 8192 characters or the end of the text.
CUT = r"(?s).{765,8189}?[\x20.,;:!?\-][acegikmACEGIKM][adehloADEHLO]|.{1,8192}"


def normalised(text: Column) -> Column:
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def chunks(text: Column, cut: str = CUT) -> Column:
    """The chunks of a text in order; the empty text has one empty chunk."""
    parts = F.regexp_extract_all(text, F.lit(cut), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(parts)


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunk_variants(pieces: DataFrame) -> DataFrame:
    """``(h, n, chunk, variant)`` of chunks that share hash and length with a different chunk.

    All chunks are compared: those of a hash are gathered as a set, merged ahead of the shuffle.
    """
    groups = pieces.groupBy("h", "n").agg(F.collect_set("chunk").alias("found"))
    return groups.filter(F.size("found") > 1).select("h", "n", F.posexplode(F.array_sort("found")).alias("variant", "chunk"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: str = CUT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, chunks``.

    Null text counts as empty, and empty texts equal each other. Of equal texts the smallest id
    stays; a null id comes after all others. Rows repeated with the same id and text count in
    ``group_size``, each is returned, and one of them is kept. Other columns are not read; an empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    cut_up = source.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm"), cut).alias("parts"))
    exploded = cut_up.select("doc_id", "text_sha256", F.posexplode("parts").alias("pos", "chunk"))
    pieces = exploded.withColumns({"h": _hash(F.col("chunk")), "n": F.length("chunk")})
    variants = staged(chunk_variants(pieces.select("h", "n", "chunk")), "chunk-variants")
    known = pieces.join(variants, ["h", "n", "chunk"], "left").select(
        "doc_id", "text_sha256", "pos", F.struct("h", "n", F.coalesce("variant", F.lit(0)).alias("v")).alias("id")
    )
    recipes = known.groupBy("doc_id", "text_sha256").agg(
        F.collect_set(F.struct("pos", "id")).alias("steps"), F.sum((F.col("pos") == 0).cast("long")).alias("copies")
    ).select("doc_id", "text_sha256", "copies", F.transform(F.array_sort("steps"), lambda s: s["id"]).alias("recipe"))
    recipes = staged(recipes, "recipes")
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    out = recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", "text_sha256", F.size("recipe").cast("long").alias("chunks"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256", "chunks")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; all columns stay."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256")
    keys = {"doc_id": F.col(id_col), "text_sha256": F.sha2(normalised(F.col(text_col)), 256)}
    return keep_rows(docs, kept, keys)
