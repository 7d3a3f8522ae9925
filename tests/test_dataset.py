import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions import arrays as A
from feedloom.functions import text as X
from feedloom.operators import batching as B
from feedloom.operators import dataset as D
from feedloom.operators import joins as J
from feedloom.operators import timelines as T
from feedloom.sources import generators, readers, sinks


def one(df):
    return df.first()[0]


def interleaved(sources, cycle, block):
    """Turn by turn, as a reader with open slots would go."""
    waiting = [list(s) for s in sources]
    slots = [waiting.pop(0) if waiting else None for _ in range(cycle)]
    out = []
    while waiting or any(s is not None for s in slots):
        for k in range(cycle):
            if slots[k] is None:
                slots[k] = waiting.pop(0) if waiting else None
                if slots[k] is None:
                    continue
            for _ in range(block):
                if not slots[k]:
                    slots[k] = None
                    break
                out.append(slots[k].pop(0))
    return out


@pytest.mark.parametrize("cycle,block", [(1, 1), (2, 3), (3, 2), (9, 4)])
def test_interleave(spark, cycle, block):
    rng = random.Random(cycle)
    sources = [[(s, s * 100 + i) for i in range(rng.randrange(1, 12))] for s in range(6)]
    df = spark.createDataFrame([r for s in sources for r in s], "s int, i int")
    got = [(r["s"], r["i"]) for r in D.interleave(df, "s", ["i"], cycle, block).orderBy("pos").collect()]
    assert got == interleaved(sources, cycle, block)


def test_batch_sizes():
    assert D.batch_sizes(16, 1.0) == (8, 8)
    assert D.batch_sizes(5, 1.0) == (3, 2)  # 2.5 rounds to even
    with pytest.raises(ValueError):
        D.batch_sizes(-1, 1.0)
    with pytest.raises(ValueError):
        D.batch_sizes(4, -0.5)


def test_boundaries():
    assert B.bucket_boundaries(24, 4, 2) == [(0, 4), (4, 8), (8, 16), (16, 25)]
    assert B.batch_count(101, 10, 4) == 12


def test_token_budget_must_fit(spark):
    with pytest.raises(ValueError):
        B.bucket_by_length(spark.range(3), F.col("id"), 256, 100, ["id"])


def test_shard_paths():
    assert D.shard_paths(["a", "b", "c"], 2, 0) == (["a", "c"], False)
    assert D.shard_paths(["a"], 2, 1) == (["a"], True)


def test_match_files(spark, tmp_path):
    for name in ("x1.txt", "x2.txt", "y.txt"):
        (tmp_path / name).write_text("1")
    found = readers.match_files(spark, [f"{tmp_path}/x*.txt, {tmp_path}/y.txt"])
    assert [f.split("/")[-1] for f in found] == ["x1.txt", "x2.txt", "y.txt"]
    with pytest.raises(ValueError):
        readers.match_files(spark, f"{tmp_path}/z*.txt")


def test_delimited_drops_header_and_bad_bytes(spark, tmp_path):
    (tmp_path / "r.dat").write_bytes(b"u::i::t\n1::2::caf\xe9\n3::4::ok\n")
    rows = readers.read_delimited(spark, f"{tmp_path}/r.dat", ["u", "i", "t"], "::", skip_header=True)
    assert [tuple(r) for r in rows.collect()] == [("1", "2", "caf"), ("3", "4", "ok")]


def test_binary_files_must_be_unique(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "one.bin").write_bytes(b"1")
    (tmp_path / "a" / "two.bin").write_bytes(b"22")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    both = [f"{tmp_path}/a", f"{tmp_path}/b"]
    assert readers.read_binary_files(spark, both, names("two.bin")).first()["length"] == 2
    with pytest.raises(ValueError):
        readers.read_binary_files(spark, both, names("one.bin"))
    with pytest.raises(ValueError):
        readers.read_binary_files(spark, both, names("three.bin"))


def test_label_map_lines_must_have_two_fields(spark):
    with pytest.raises(ValueError):
        J.label_map(spark, ["1,a,b"])


def test_constant_rows(spark):
    df = generators.constant_rows(spark, 50, 1000, 3, "float", 2)
    assert df.distinct().count() == 1 and df.count() == 50
    assert df.select(F.size("c0")).first()[0] == 84
    with pytest.raises(ValueError):
        generators.constant_rows(spark, 1, 2**30 + 1, 1)


def test_existing_shards_are_kept(spark, tmp_path):
    path = f"{tmp_path}/s"
    sinks.write_sharded(spark.range(10), path, 3, ["id"])
    sinks.write_sharded(spark.range(99), path, 3, ["id"])
    back = sinks.read_shards(spark, path, spark.range(1).schema)
    assert sorted(r[0] for r in back.collect()) == list(range(10))
    assert sinks.shard_name("train", 0, 16) == "train-00001-of-00016"


def test_sequence_repeats_when_short(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert one(df.select(A.sample_sequence("a", 5, 1, 1))) == [2, 3, 1, 2, 3]
    assert one(df.select(A.sample_sequence("a", 1, 1))) == [2]
    assert one(df.select(A.sample_linspace("a", 2, 2, 1))) == [1, 2, 2, 3]
    assert one(df.select(A.pad_or_clip("a", 5, 9))) == [1, 2, 3, 9, 9]
    assert one(df.select(A.pad_or_clip("a", 2))) == [1, 2]


def test_sliding(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "a array<int>")
    assert one(df.select(X.sliding("a", 1))) == [[1], [2], [3], [4]]
    assert one(df.select(X.sliding("a", 3))) == [[1, 2, 3], [2, 3, 4]]
    assert one(df.select(X.sliding("a", 4))) == [[1, 2, 3, 4]]
    assert one(df.select(X.sliding("a", 5))) == []


@pytest.mark.parametrize("counts,want", [
    ([1, 2, 3], 3), ([1], 1), ([1, 2, 3, 2], 2), ([1, 3, 4, 3], 3), ([4, 3, 2, 1], 4),
    ([1, 1, 1, 2, 3, 3, 2], 2), ([1, 1, 1, 2, 3, 3, 1], 2),
])
def test_first_decrease(spark, counts, want):
    df = spark.createDataFrame([("r", i, c) for i, c in enumerate(counts)], "k string, i int, c int")
    assert T.first_decrease(df, "k", "c", ["i"]).first()["workers"] == want


def test_text_values(spark):
    df = spark.createDataFrame([("Test0, 1 two, 3",)], "s string")
    assert one(df.select(X.bleu_tokenize("s"))) == ["Test0", ",", "1", "two", ",", "3"]
    esc = spark.createDataFrame([("a_\\é",)], "s string")
    assert one(esc.select(X.escape_token("s", "a\\_u;0123456789"))) == "a\\u\\\\\\233;_"
    un = spark.createDataFrame([("\\u\\\\\\233;\\9999999;x",)], "s string")
    assert one(un.select(X.unescape_token("s"))) == "_\\é〓x"
    url = spark.createDataFrame([("HTTP://a.com/x%20y+z?q=1#f?g",)], "u string")
    assert one(url.select(X.normalize_url("u"))) == "a.com/x y+z#f?g"
    half = spark.createDataFrame([("abcde",)], "s string")
    assert one(half.select(X.half_bytes("s"))) == "ab"
