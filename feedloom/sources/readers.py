"""Readers: path specs, delimited text, nested JSON, annotated lines, binary files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.text import strip
from feedloom.operators.joins import require_unique

BLANK_LINE = r"\n[ \t\r]*\n\s*"


def match_files(spark: SparkSession, spec: str | Sequence[str]) -> list[str]:
    """Paths of a spec: a string, a comma-separated string, or a list of either.

    Wildcards are resolved on the file system of the path; a part that matches nothing is an
    error.
    """
    parts = [spec] if isinstance(spec, str) else list(spec)
    patterns = [p.strip() for part in parts for p in part.split(",") if p.strip()]
    if not patterns:
        raise ValueError(f"no path in {spec!r}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        hits = path.getFileSystem(conf).globStatus(path)
        if not hits:
            raise ValueError(f"{pattern!r} matches no file")
        found += sorted(h.getPath().toString() for h in hits)
    return found


def read_records(spark: SparkSession, spec, schema: T.StructType | None = None) -> DataFrame:
    """Parquet records of a path spec; file splits give the read parallelism."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*match_files(spark, spec))


def read_typed_tsv(
    spark: SparkSession, path: str, dense: int, sparse: int, defaults: Sequence | None = None
) -> DataFrame:
    """Tab-separated (label, dense..., sparse...) lines with one default per column.

    The text ``-1`` means missing and takes the column's default.
    """
    names = ["label", *[f"d{i}" for i in range(dense)], *[f"s{i}" for i in range(sparse)]]
    kinds = ["float"] * (1 + dense) + ["int"] * sparse
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    defaults = defaults or [0] * len(names)
    raw = spark.read.csv(path, sep="\t", schema=schema, nullValue="-1")
    full = [F.coalesce(n, F.lit(d).cast(k)).alias(n) for n, d, k in zip(names, defaults, kinds)]
    rows = raw.select(*full)
    return rows.select(
        "label",
        F.array(*names[1 : 1 + dense]).alias("dense_features"),
        F.struct(*[F.col(n).alias(str(i)) for i, n in enumerate(names[1 + dense :])]).alias(
            "sparse_features"
        ),
    )


def read_delimited(
    spark: SparkSession, path: str, names: Sequence[str], separator: str, skip_header: bool = False
) -> DataFrame:
    """Text split at a (multi-character) separator, as strings under fixed names.

    Undecodable bytes are dropped. ``skip_header`` leaves out the first line of every file, by its
    place: later lines that read the same are data.
    """
    lines = spark.read.text(path)
    if skip_header:
        placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
        heads = placed.filter("block = 0").groupBy("file").agg(F.min("nth").alias("nth"))
        lines = placed.join(heads, ["file", "nth"], "left_anti").select("value")
    dropped = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    clean = lines.select(F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(dropped).alias("value"))
    fields = F.split("value", "\\Q" + separator + "\\E", len(names))
    return clean.select(*[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_tsv(spark: SparkSession, path: str, schema, quote: str | None = None) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote=quote or "")


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sentence_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One sentence per line: (key, sent_id, sentence); blank lines hold no sentence."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    return docs.select(key, F.posexplode(lines).alias("sent_id", "sentence"))


def document_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """Blank lines end a document: (key, part, text); empty documents are dropped."""
    parts = F.filter(F.split(text, BLANK_LINE), lambda p: ~p.rlike(r"^\s*$"))
    return files.select(key, F.posexplode(parts).alias("part", "text"))


def token_label_rows(files: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """``token<TAB>label`` lines with a blank line after a sentence.

    Gives (key, sent_id, pos, token, label_id); a line without label has label id 0. ``labels`` is
    the short table of label names, which goes to every task.
    """
    sentences = document_rows(files, key, text).withColumnRenamed("part", "sent_id")
    lines = F.filter(F.split("text", "\n"), lambda s: strip(s) != "")
    rows = sentences.select(key, "sent_id", F.posexplode(lines).alias("pos", "line"))
    fields = F.split("line", "\t")
    rows = rows.select(
        key, "sent_id", "pos", strip(F.get(fields, F.lit(0))).alias("token"),
        strip(F.get(fields, F.lit(1))).alias("name"),
    )
    # A join by name would put all lines of a label, most of all those without one, into one task.
    return rows.join(F.broadcast(labels), "name", "left").select(
        key, "sent_id", "pos", "token", F.coalesce("id", F.lit(0)).alias("label_id")
    )


QA_SCHEMA = (
    "data array<struct<title: string, paragraphs: array<struct<context: string, qas: "
    "array<struct<id: string, question: string, is_impossible: boolean, "
    "answers: array<struct<text: string, answer_start: int>>>>>>>>"
)


def flatten_qa(docs: DataFrame) -> DataFrame:
    """Article > paragraph > question > answers, one row per question and answer."""
    rows = docs.select(F.explode("data").alias("article"))
    rows = rows.select("article.title", F.explode("article.paragraphs").alias("p"))
    rows = rows.select("title", "p.context", F.explode("p.qas").alias("q"))
    return rows.select(
        "title", "context", F.col("q.id").alias("qid"), F.col("q.question").alias("question"),
        F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"),
        F.posexplode_outer("q.answers").alias("answer_no", "answer"),
    ).select("title", "context", "qid", "question", "is_impossible", "answer_no", "answer.*")


def read_qa_json(spark: SparkSession, path: str) -> DataFrame:
    return flatten_qa(spark.read.schema(QA_SCHEMA).json(path, multiLine=True))


EVIDENCE_QA_SCHEMA = (
    "Data array<struct<QuestionId: string, Question: string, "
    "Answer: struct<Value: string, Aliases: array<string>, NormalizedAliases: array<string>>, "
    "EntityPages: array<struct<Filename: string, Title: string>>, "
    "SearchResults: array<struct<Filename: string, Title: string>>>>"
)


def flatten_evidence_qa(docs: DataFrame) -> DataFrame:
    """One row per question and listed evidence file, with its source list's name."""
    q = docs.select(F.explode("Data").alias("q")).select("q.*")

    def listed(source: str):
        entries = F.coalesce(source, F.expr("array()"))
        return F.transform(
            entries,
            lambda e: F.struct(
                F.lit(source).alias("source"), e["Filename"].alias("file"), e["Title"].alias("title")
            ),
        )

    both = F.concat(listed("EntityPages"), listed("SearchResults"))
    return q.select(
        F.col("QuestionId").alias("qid"), F.col("Question").alias("question"),
        F.col("Answer").alias("answer"), F.explode_outer(both).alias("e"),
    ).select("qid", "question", "answer", "e.*")


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every article file below a folder, as (url, title, maintext)."""
    return spark.read.schema("url string, title string, maintext string").json(
        folder, multiLine=True, recursiveFileLookup=True
    )


def read_binary_files(spark: SparkSession, folders: Sequence[str], names: DataFrame) -> DataFrame:
    """Bytes of the named files; a name absent from, or twice in, the folders is an error."""
    files = spark.read.format("binaryFile").load(list(folders))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    wanted = files.select("name", "path", "length").join(names, "name", "left_semi")
    require_unique(wanted, F.col("name"), "file")
    absent = names.join(wanted, "name", "left_anti").limit(1).collect()
    if absent:
        raise ValueError(f"file {absent[0]['name']!r} is in none of the folders")
    return files.join(names, "name")
