"""Sets of named shards: names, contents, several tasks a shard, jobs that end half-way, odd rows."""

import os

import pyarrow.parquet as pq
import pytest
from feedloom.session import fresh_folder
from feedloom.sources import shards
from pyspark.sql import functions as F


def local(folder):
    return folder.removeprefix("file:")


def contents(path, prefix, n):
    """Rows of each shard in the order of its parts' names, read without Spark."""
    out = []
    for k in range(n):
        folder = f"{local(path)}/{prefix}-{k + 1:05d}-of-{n:05d}"
        tables = [pq.read_table(f"{folder}/{f}", partitioning=None) for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]
        out.append([r for t in tables for r in t.to_pylist()])
    return out


def test_rows_by_place_in_several_parts(spark, many_ranges):
    rows = [(k, None if k % 5 == 0 else f"t{k}" * (k % 4)) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(7)
    path = fresh_folder(spark, "set")
    assert shards.write_set(df, path, "a", 3, ["k"], tasks=9)
    got = contents(path, "a", 3)
    assert [[(r["k"], r["t"]) for r in part] for part in got] == [rows[k::3] for k in range(3)]
    listed = shards.parts_of(path, "a", 3)
    assert max(len(files) for files in listed.values()) > 1 and sum(sum(f.values()) for f in listed.values()) == 1000
    assert [n for n in os.listdir(local(path)) if n.startswith("_")] == []


def test_a_whole_set_is_kept_and_a_broken_one_written_anew(spark):
    path = fresh_folder(spark, "set")
    df = spark.range(40)
    assert shards.write_set(df, path, "b", 4, ["id"])
    assert not shards.write_set(df.filter("id < 3"), path, "b", 4, ["id"])
    assert shards.write_set(df.filter("id < 3"), path, "b", 2, ["id"])  # another set beside it
    name = shards.shard_name("b", 1, 4)
    gone = f"{local(path)}/{name}/{next(iter(shards.parts_of(path, 'b', 4)[name]))}"
    os.replace(gone, gone + ".lost")
    assert shards.parts_of(path, "b", 4) is None
    with pytest.raises(FileNotFoundError):
        shards.read_set(spark, path, "b", 4)
    assert shards.write_set(df.filter("id >= 20"), path, "b", 4, ["id"])
    assert sorted(r.id for r in shards.read_set(spark, path, "b", 4).collect()) == list(range(20, 40))
    assert sorted(r.id for r in shards.read_set(spark, path, "b", 2).collect()) == [0, 1, 2]


def test_a_failed_job_leaves_no_set(spark):
    path = fresh_folder(spark, "set")
    bad = spark.range(1000).withColumn("v", F.when(F.col("id") == 990, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="broken"):
        rows = bad.withColumn("shard", (F.col("id") % 4).cast("int"))
        spark.dataSource.register(shards.ShardSet)
        rows.write.format("shard_set").options(path=path, prefix="c", shards=4).mode("append").save()
    assert shards.parts_of(path, "c", 4) is None
    # a task that was still running may leave its own folder, which no reader looks into
    assert not os.path.exists(local(path)) or [n for n in os.listdir(local(path)) if not n.startswith("_")] == []


def test_tasks_that_are_tried_again_write_their_rows_once(spark):
    """Rows that are not sorted by shard only give more parts; each row is there once."""
    path = fresh_folder(spark, "set")
    spark.dataSource.register(shards.ShardSet)
    rows = spark.range(500, numPartitions=5).withColumn("shard", (F.col("id") * 7 % 4).cast("int"))
    for _ in range(2):
        rows.write.format("shard_set").options(path=path, prefix="d", shards=4).mode("append").save()
    assert [sorted(r["id"] for r in part) for part in contents(path, "d", 4)] == [[k for k in range(500) if k * 7 % 4 == s] for s in range(4)]


def test_empty_tables_and_refused_columns(spark):
    path = fresh_folder(spark, "set")
    empty = spark.createDataFrame([], "id long, tags array<string>")
    assert shards.write_set(empty, path, "e", 3, ["id"])
    back = shards.read_set(spark, path, "e", 3)
    assert back.count() == 0 and back.columns == ["id", "tags"] and len(shards.parts_of(path, "e", 3)) == 3
    with pytest.raises(ValueError, match="shard"):
        shards.write_set(spark.range(3).withColumn("shard", F.lit(1)), path, "f", 2, ["id"])
    rows = spark.range(4).withColumn("shard", F.lit(9))
    with pytest.raises(Exception, match="shard must be from 0 to 1"):
        rows.write.format("shard_set").options(path=path, prefix="g", shards=2).mode("append").save()


def test_a_seeded_order_is_the_same_again(spark):
    df = spark.range(300)
    one, two = fresh_folder(spark, "set"), fresh_folder(spark, "set")
    for path, tasks in ((one, 3), (two, 11)):
        shards.write_set(df, path, "h", 4, ["id"], shuffle_key="id", seed=3, tasks=tasks)
    got = contents(one, "h", 4)
    assert got == contents(two, "h", 4)
    assert [sorted(r["id"] for r in part) for part in got] == [list(range(k, 300, 4)) for k in range(4)]
    assert got[0] != sorted(got[0], key=lambda r: r["id"])
