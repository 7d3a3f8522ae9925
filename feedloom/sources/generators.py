"""Generated sources, built from ``spark.range`` so they scale with the row count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.hashing import draw, unit

# Bytes per item, and the largest allowed row.
TYPE_SIZE = {"int": 4, "bigint": 8, "float": 4}
MAX_ROW_BYTES = 1024**3


def int_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def constant_rows(
    spark: SparkSession, rows: int, bytes_per_row: int, columns: int, kind: str = "int", seed: int = 0
) -> DataFrame:
    """``rows`` copies of one random row of ``columns`` arrays, sized to the given bytes."""
    if bytes_per_row > MAX_ROW_BYTES:
        raise ValueError(f"a row may hold at most {MAX_ROW_BYTES} bytes")
    items = -(-bytes_per_row // (columns * TYPE_SIZE[kind]))
    index = F.sequence(F.lit(0), F.lit(items - 1))

    def one_array(c: int) -> Column:
        if kind == "float":
            return F.transform(index, lambda i: unit(i, F.lit(c), seed).cast(kind))
        return F.transform(index, lambda i: draw(F.lit(2**31 - 1), i, F.lit(c), seed).cast(kind))

    arrays = [one_array(c).alias(f"c{c}") for c in range(columns)]
    return spark.range(rows).select(*arrays)


def ranking_rows(
    spark: SparkSession, rows: int, dense: int, vocabulary: Sequence[int], seed: int = 0
) -> DataFrame:
    """Uniform dense features, uniform sparse ids, and a label that depends on both."""
    base = spark.range(rows)
    d = [unit("id", F.lit(i), seed).alias(f"d{i}") for i in range(dense)]
    s = [draw(F.lit(v), "id", F.lit(dense + i), seed).cast("int").alias(f"s{i}") for i, v in enumerate(vocabulary)]
    wide = base.select("id", *d, *s)
    dn, sn = [F.col(f"d{i}") for i in range(dense)], [F.col(f"s{i}") for i in range(len(vocabulary))]
    return wide.select(
        "id", ranking_label(dn, sn, vocabulary).alias("label"),
        F.array(*dn).alias("dense_features"),
        F.struct(*[c.alias(str(i)) for i, c in enumerate(sn)]).alias("sparse_features"),
    )


def ranking_label(dense: Sequence[Column], sparse: Sequence[Column], vocabulary: Sequence[int]) -> Column:
    """int(mean(dense) / 2 + sum(sparse) / sum(vocabulary) / 2 + 0.5)"""
    d = sum(dense[1:], dense[0]) / float(len(dense))
    s = sum(sparse[1:], sparse[0]) / float(sum(vocabulary))
    return F.floor(d / 2 + s / 2 + 0.5).cast("int")
