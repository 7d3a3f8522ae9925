"""Joins and lookups. Join strategy is Spark's: a side is broadcast only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold``; larger ones are shuffled, with
adaptive skew splitting for hot keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.ordered import top_rows, with_position
from feedloom.session import staged


def by_repetition(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose keys no other row has, and those with repeated keys (None where there are none).

    Only keys are shuffled to tell. Null keys are equal, as in a grouping.
    """
    names = {k: f"_of_{k}" for k in keys}
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(*[F.col(k).alias(n) for k, n in names.items()])
    again = staged(again, "repeated")
    if again.isEmpty():
        return df, None
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def label_map(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """``id,name`` lines as a table; a line without exactly two fields is an error."""
    rows = []
    for line in lines:
        fields = line.split(",")
        if len(fields) != 2:
            raise ValueError(f"expected id,name but found {line!r}")
        rows.append((int(fields[0]), fields[1].strip()))
    return spark.createDataFrame(rows, "id int, name string")


def lookup(df: DataFrame, key: str, table: DataFrame, out: str, default) -> DataFrame:
    """Left lookup of ``key`` in a (id, name) table with a default for unknown names."""
    joined = df.join(table, df[key] == table["name"], "left")
    return joined.withColumn(out, F.coalesce("id", F.lit(default))).drop("id", "name")


def vocab_encode(tokens: DataFrame, vocab: DataFrame, unknown: int) -> DataFrame:
    """Token rows (``token``) to ids through a (token, id) table.

    The distinct tokens are looked up, then joined back, so a vocabulary too large to
    broadcast meets each token once and not once per occurrence.
    """
    ids = tokens.select("token").distinct().join(vocab, "token", "left")
    return tokens.join(ids.select("token", F.coalesce("id", F.lit(unknown)).alias("id")), "token")


def join_ratings_items(ratings: DataFrame, items: DataFrame) -> DataFrame:
    return ratings.join(items, "item_id").withColumn("rating", F.col("rating").cast("float"))


def nested_lists(
    df: DataFrame, key: str, order_by: Sequence[str], fields: Sequence[str], out: str, most: int = 1000
) -> DataFrame:
    """Rows of a key as sorted arrays of at most ``most`` items: (key, part, out).

    Nearly every key has the single part 0; a key with more rows continues in further parts,
    so no array grows with the data and nothing is cut off.
    """
    rows = with_position(df, [*order_by], [key], "_nth")
    rows = rows.withColumn("part", F.floor(F.col("_nth") / most).cast("int"))
    lists = rows.groupBy(key, "part").agg(
        F.array_sort(F.collect_list(F.struct("_nth", *fields))).alias("_l")
    )
    plain = F.transform("_l", lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    return lists.select(key, "part", plain.alias(out))


def join_annotations(
    images: DataFrame, boxes: DataFrame, captions: DataFrame, categories: DataFrame,
    order: Sequence[str], most: int = 1000,
) -> DataFrame:
    """Images with their boxes (category named) and captions as sorted arrays.

    One row per image and part; parts beyond 0 appear only for images with more than ``most``
    boxes or captions. Arrays are null where there is nothing.
    """
    named = boxes.join(categories, "category_id", "left")
    box_lists = nested_lists(named, "image_id", order, [*order, "category_id", "category"], "boxes", most)
    texts = nested_lists(captions, "image_id", ["caption"], ["caption"], "captions", most)
    lists = box_lists.join(texts, ["image_id", "part"], "full")
    return images.join(lists, "image_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def positional_pairs(df: DataFrame, group: str, pivot: str, order_by) -> DataFrame:
    """Pair the i-th row of every group with the i-th row of the ``pivot`` group."""
    rows = with_position(df, order_by, [group], "rank")
    right = rows.filter(F.col(group) == pivot)
    right = right.select("rank", *[F.col(c).alias(f"{c}_{pivot}") for c in df.columns if c != group])
    return rows.filter(F.col(group) != pivot).join(right, "rank")


def sweep_cross(spark: SparkSession, ranges: dict[str, Sequence]) -> DataFrame:
    """Every combination of the swept parameters, built from configuration lists."""
    out = spark.range(1).select(F.lit(0).alias("_one"))
    for name, values in ranges.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("_one")


def stories_to_articles(stories: DataFrame, articles: DataFrame, normalise, most: int) -> DataFrame:
    """Stories with their articles by normalised url, at most ``most`` in url-list order.

    Stories without any match are dropped; missing places are filled with blank articles.
    """
    urls = stories.select("story_id", F.posexplode("urls").alias("url_pos", "raw_url"))
    urls = urls.withColumn("url", normalise(F.col("raw_url")))
    found = urls.join(articles, "url")
    first = top_rows(found, most, ["url_pos", "article_id"], ["story_id"], "place")
    kept = stories.select("story_id", "label").join(
        first.select("story_id").distinct(), "story_id"
    )
    places = kept.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(most))))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return places.join(first.drop("url_pos", "raw_url"), ["story_id", "place"], "left").select(
        "story_id", "label", "place", F.coalesce("article_id", F.lit(-1)).alias("article_id"),
        blank("url"), blank("title"), blank("body"),
    )


def items_not_rated(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """``user_id, n, h`` of the catalogue's items (distinct ``item_id``) that a user has not rated.

    ``h`` sums an arithmetic hash of the items. Both follow from the catalogue's totals minus those
    of the user's distinct items, so users and items are never crossed.
    """
    h = F.col("item_id").cast("bigint") * F.lit(2654435761) % F.lit(4294967291)
    own = ratings.select("user_id", "item_id").distinct().join(items, "item_id", "left_semi")
    totals = items.agg(F.count(F.lit(1)).alias("all_n"), F.sum(h).alias("all_h"))
    found = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"))
    return found.crossJoin(F.broadcast(totals)).select(
        "user_id", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_h") - F.col("h")).alias("h")
    )


def annotation_gaps(images: DataFrame, **annotations: DataFrame) -> DataFrame:
    """One row: how many images there are and, for each named table, how many have no row in it (``no_<name>``).

    A null image id counts as an image that no table holds. Tables are cut to their distinct image ids
    ahead of the join, so an image with many rows is not hot.
    """
    found = images.select("image_id").distinct()
    for name, table in annotations.items():
        ids = table.select("image_id").distinct().withColumn(f"has_{name}", F.lit(1))
        found = found.join(ids, "image_id", "left")
    none = [F.count_if(F.col(f"has_{name}").isNull()).alias(f"no_{name}") for name in annotations]
    return found.agg(F.count(F.lit(1)).alias("images"), *none)


def require_unique(df: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` when the key is unique, else an error that names one duplicate."""
    twice = df.groupBy(key.alias("key")).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name} {twice[0]['key']!r} occurs {twice[0]['count']} times")
    return df
