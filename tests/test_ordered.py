"""Ordered scans give the window result for any split, also with one hot group."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions.hashing import mix
from feedloom.operators import ordered as O

pytestmark = pytest.mark.usefixtures("many_ranges")


def mix_int(a, b, seed):
    """The hash of integers, step by step."""
    low = 2147483647
    linear = (a % low * 48271 + b % low * 69621 + seed * 16807 + 12345) % low
    return (linear * linear % low * 48271 + linear + 11) % low


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = [(("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}"), rng.randrange(50), i) for i in range(1500)]
    return [(g, v, i, rng.randrange(-5, 6)) for g, v, i in keys]


def groups(rows):
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    return {k: list(g) for k, g in itertools.groupby(ordered, key=lambda r: r[0])}


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v int, i int, x int").repartition(7)


def test_split_points_are_used(spark, rows):
    df = frame(spark, rows)
    assert len(O.split_points(df, ["v", "i"], 8)) == 7
    ranged, many = O.with_range(df, ["v", "i"])
    assert many and ranged.select(O.RANGE).distinct().count() > 4


def test_ranges_follow_groups(spark, rows):
    ranged, many = O.with_range(frame(spark, rows), ["v", "i"], 8, ["g"])
    found = ranged.groupBy("g").agg(F.collect_set(O.RANGE).alias("r"), F.bool_and(O.EDGE).alias("e")).collect()
    assert many and max(len(r["r"]) for r in found) > 2  # the hot group is spread
    assert sum(len(r["r"]) for r in found) <= len(groups(rows)) + 7
    assert all(r["e"] for r in found if len(r["r"]) > 1) and not all(r["e"] for r in found)


def test_position(spark, rows):
    got = {r["i"]: r["pos"] for r in O.with_position(frame(spark, rows), ["v", "i"], ["g"]).collect()}
    want = {r[2]: n for g in groups(rows).values() for n, r in enumerate(g)}
    assert got == want
    got = {r["i"]: r["n"] for r in O.with_position(frame(spark, rows), [-F.col("v"), "i"], name="n", start=1).collect()}
    assert got == {r[2]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}


def test_running_beside_a_column_of_like_name(spark, rows):
    df = frame(spark, rows).withColumnsRenamed({"x": "_s"})
    out = O.with_running(df, ["v", "i"], {"s": ("sum", F.col("_s"))})
    xs = [r[3] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert [r["s"] for r in out.orderBy("v", "i").collect()] == [*itertools.accumulate(xs)]


def test_running(spark, rows):
    out = O.with_running(frame(spark, rows), ["v", "i"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("min", F.col("x"))}, ["g"])
    got = {r["i"]: (r["s"], r["m"], r["l"]) for r in out.collect()}
    want = {}
    for g in groups(rows).values():
        xs = []
        for r in g:
            xs.append(r[3])
            want[r[2]] = (sum(xs), max(xs), min(xs))
    assert got == want


@pytest.mark.parametrize("back", [False, True])
def test_neighbour(spark, rows, back):
    out = O.with_neighbour(frame(spark, rows), ["v", "i"], {"n": "i"}, ["g"], back=back)
    got = {r["i"]: r["n"] for r in out.collect()}
    want = {}
    for g in groups(rows).values():
        for k, r in enumerate(g):
            j = k - 1 if back else k + 1
            want[r[2]] = g[j][2] if 0 <= j < len(g) else None
    assert got == want


def test_hash_is_the_same_in_python(spark):
    got = spark.range(500).select("id", mix("id", F.col("id") % 7, 11).alias("h")).collect()
    assert all(r["h"] == mix_int(r["id"], r["id"] % 7, 11) for r in got)
