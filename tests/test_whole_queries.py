"""Registered queries that read all users and whole texts."""

import duckdb
from conftest import SF
from feedloom.functions.text import half_bytes
from feedloom.operators.joins import annotation_gaps, items_not_rated
from feedloom.plans import catalog
from pyspark.sql import functions as F


def test_items_not_rated(spark):
    rated = [(1, 1), (1, 1), (1, 3), (2, 2), (107, 1), (107, 2), (107, 3), (107, 4), (3, 99)]
    ratings, items = spark.createDataFrame(rated, "user_id long, item_id long"), spark.createDataFrame([(k,) for k in range(1, 5)], "item_id long")
    want = set()
    for user in {1, 2, 107}:
        left = set(range(1, 5)) - {i for u, i in rated if u == user}
        want.add((user, len(left), sum(i * 2654435761 % 4294967291 for i in left)))
    assert {tuple(r) for r in items_not_rated(ratings, items).collect()} == want


def test_whole_tables_equal_sql(spark):
    db = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents".split()):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("set_difference_by_user", "map_inflate_bytes", "annotation_gaps"):
        cur = db.execute(catalog.all_oracles()[name])
        names = [d[0] for d in cur.description]
        got = catalog.all_queries()[name](spark, SF)
        assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr), name


def test_half_of_raw_bytes(spark):
    rows = spark.createDataFrame([("né\n日本",), ("",), (None,)], "s string")
    want = [t.encode()[: len(t.encode()) // 2].hex().upper() for t in ("né\n日本", "")] + [None]
    assert [r.h for r in rows.select(F.hex(half_bytes("s")).alias("h")).collect()] == want


def test_annotation_gaps(spark):
    images = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "image_id long")
    boxes = spark.createDataFrame([(1,), (1,), (9,)], "image_id long")
    got = annotation_gaps(images, boxes=boxes, captions=boxes.limit(0)).collect()
    assert [r.asDict() for r in got] == [{"images": 4, "no_boxes": 3, "no_captions": 4}]
    assert annotation_gaps(images.limit(0), boxes=boxes).collect() == [(0, 0)]
