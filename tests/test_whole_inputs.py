"""Nothing is cut: headers by place, parts of long lists, long arrays, streams that start again."""

from feedloom.operators import batching, joins
from feedloom.session import fresh_folder
from feedloom.sources import readers
from feedloom.streaming import jobs
from pyspark.sql import functions as F


def test_only_the_first_line_of_a_file_is_a_header(spark):
    path = fresh_folder(spark, "headers")
    for part in (["1::a", "2::b", "1::a"], ["1::a", "1::a"]):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(path)
    got = readers.read_delimited(spark, path, ["x", "y"], "::", skip_header=True)
    assert sorted((r.x, r.y) for r in got.collect()) == [("1", "a"), ("1", "a"), ("2", "b")]


def test_long_lists_continue_in_parts(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id int")
    boxes = spark.range(2500).select(F.lit(1).alias("image_id"), F.col("id").alias("nth"), F.lit("c").alias("category_id"))
    captions = spark.createDataFrame([], "image_id int, caption string")
    names = spark.createDataFrame([("c", "cat")], "category_id string, category string")
    got = joins.join_annotations(images, boxes, captions, names, ["nth"])
    found = sorted((r.image_id, r.part, r.boxes and [b.nth for b in r.boxes]) for r in got.collect())
    assert found == [(1, 0, list(range(1000))), (1, 1, list(range(1000, 2000))), (1, 2, list(range(2000, 2500))), (2, 0, None)]


def test_arrays_over_the_last_length_stay_whole(spark):
    rows = spark.createDataFrame([(1, [1] * 3), (2, [2] * 9), (3, [3] * 50)], "id int, a array<int>")
    got = {r.id: (r.bucket, len(r.a)) for r in batching.bucket_fixed_lengths(rows, "a", [4, 10], 2, ["id"]).collect()}
    assert got == {1: (0, 4), 2: (1, 10), 3: (2, 50)}


def test_a_stream_started_again_without_new_files(spark):
    source, out, mark = (fresh_folder(spark, x) for x in ("in", "out", "mark"))
    spark.range(10).write.parquet(source)
    for add in (0, 0, 5):
        if add:
            spark.range(add).write.mode("append").parquet(source)
        total = spark.readStream.schema("id long").parquet(source).groupBy().agg(F.count("id").alias("n"))
        got = jobs.latest_result(total, out, mark).collect()
        assert [r.n for r in got] == [10 + add]
