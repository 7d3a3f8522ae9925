"""Sinks: sharded record folders, result tables, metadata files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.hashing import mix
from feedloom.operators.ordered import with_position
from feedloom.sources.shards import shard_name

__all__ = ["read_shards", "shard_name", "write_metadata", "write_results", "write_sharded"]


def write_sharded(df: DataFrame, path: str, shards: int, order_by, shuffle_key: str | None = None, seed: int = 0) -> None:
    """Row i goes to shard i mod ``shards``, one folder per shard.

    An existing complete set of shards is kept (``ignore``); the committer renames finished
    files, so a reader never sees half a shard. With ``shuffle_key`` the rows of each shard are
    stored in a pseudo-random order. Each shard is written by one task on its own partition.
    """
    rows = with_position(df, order_by, name="_pos")
    rows = rows.withColumn("shard", (F.col("_pos") % shards).cast("int"))
    order = [mix(shuffle_key, 0, seed), shuffle_key] if shuffle_key else ["_pos"]
    (
        rows.repartition(shards, "shard")
        .sortWithinPartitions("shard", *order)
        .drop("_pos")
        .write.mode("ignore")
        .partitionBy("shard")
        .parquet(path)
    )


def read_shards(spark, path: str, schema) -> DataFrame:
    """The written rows with their recorded types."""
    names = schema.names if hasattr(schema, "names") else None
    rows = spark.read.schema(schema).parquet(path)
    return rows.select(*names) if names else rows


def write_results(df: DataFrame, path: str, append: bool = True) -> None:
    """Result tables as CSV with a header, added to after each configuration."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_metadata(summary: DataFrame, path: str) -> None:
    """A one-row summary as JSON beside the data."""
    summary.write.mode("overwrite").json(path)
