"""Group reducers, counters, the keyed source and the answer search on small rows."""

import math
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from feedloom.functions.hashing import mix
from feedloom.operators import answers, counters, reducers
from feedloom.session import fresh_folder
from feedloom.sources import keyed
from pyspark.sql import functions as F


def spans() -> reducers.ArrowReducer:
    """Least and largest value and how many, of any number of rows."""

    def partial(rows):
        v = [x for x in rows.column("v").to_pylist() if x is not None]
        return pa.table({"lo": pa.array([min(v, default=None)], pa.int64()), "hi": pa.array([max(v, default=None)], pa.int64()), "n": pa.array([rows.num_rows], pa.int64())})

    def merge(rows):
        lo, hi = ([x for x in rows.column(c).to_pylist() if x is not None] for c in ("lo", "hi"))
        return pa.table({"lo": pa.array([min(lo, default=None)], pa.int64()), "hi": pa.array([max(hi, default=None)], pa.int64()), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64())})

    return reducers.ArrowReducer(partial, merge, "lo bigint, hi bigint, n bigint")


def test_arrow_reducer_with_hot_and_null_keys(spark):
    rows = [("hot" if k % 3 else f"k{k % 11}", k if k % 7 else None) for k in range(3000)] + [(None, 5), (None, None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(9)
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    got = reducers.reduce_groups_arrow(df, {"key": F.col("k")}, spans()).collect()
    plain = {k: (min((x for x in v if x is not None), default=None), max((x for x in v if x is not None), default=None), len(v)) for k, v in want.items()}
    assert {r.key: (r.lo, r.hi, r.n) for r in got} == plain and len(got) == len(plain)
    assert reducers.reduce_groups_arrow(df.limit(0), {"key": F.col("k")}, spans()).count() == 0


def test_a_hot_key_reaches_the_last_step_as_few_rows(spark):
    """What crosses the shuffle is one row for each batch, not one for each row of the key."""
    seen = spark.sparkContext.accumulator(0)
    plain = spans()

    def merge(rows):
        seen.add(rows.num_rows)
        return plain.merge(rows)

    df = spark.range(200_000, numPartitions=8).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    got = reducers.reduce_groups_arrow(df, {"key": F.col("k")}, reducers.ArrowReducer(plain.partial, merge, plain.schema)).collect()
    assert [(r.lo, r.hi, r.n) for r in got] == [(0, 199_999, 200_000)]
    assert seen.value <= 2 * (8 * math.ceil(25_000 / 10_000) + 8)


def test_a_task_merges_many_windows_at_once(spark):
    """A reducer of many groups is called once for some thousand windows, and nulls are a key of their own."""
    calls = spark.sparkContext.accumulator(0)

    def partial(rows, by):
        calls.add(1)
        return rows.group_by(by).aggregate([("v", "sum")]).rename_columns([*by, "total"])

    def merge(rows, by):
        calls.add(1)
        return rows.group_by(by).aggregate([("total", "sum")]).rename_columns([*by, "total"])

    rows = [(k % 5 or None, k) for k in range(40_000)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(4)
    got = reducers.reduce_groups_arrow(df, {"key": F.col("k")}, reducers.ArrowReducer(partial, merge, "total bigint", many=True), 4, ["v"]).collect()
    want, nth = defaultdict(int), Counter()
    for k, v in rows:
        want[k, nth[k] // 4] += v
        nth[k] += 1
    assert {(r.key, r.window_id): r.total for r in got} == want and len(got) == 10_000
    assert calls.value < 200


def test_reduce_in_windows_of_a_size_by_key(spark):
    rows = [(k, k % 2) for k in range(20)]
    df = spark.createDataFrame(rows, "v long, b int")
    size = F.when(F.col("key") == 0, 3).otherwise(4)
    got = reducers.reduce_groups(df, {"key": F.col("b")}, {"all": F.array_sort(F.collect_list("v"))}, size, ["v"]).collect()
    want = {}
    for key, n in ((0, 3), (1, 4)):
        own = [v for v, b in rows if b == key]
        want |= {(key, k // n): own[k : k + n] for k in range(0, len(own), n)}
    assert {(r.key, r.window_id): r.all for r in got} == want


def test_counters_beside_a_result(spark):
    path = fresh_folder(spark, "counted")
    df = spark.range(100, numPartitions=4)

    def make(c):
        return c.at(c.at(df, "all", n=F.count(F.lit(1))).filter("id % 3 = 0"), "kept", n=F.count(F.lit(1)), top=F.max("id"))

    assert counters.write_counted(make, path) == {"all.n": 100, "kept.n": 34, "kept.top": 99}
    assert spark.read.parquet(path).count() == 34
    c = counters.Counters()
    c.at(df, "x", n=F.count(F.lit(1)))
    with pytest.raises(ValueError, match="counted already"):
        c.at(df, "x", n=F.count(F.lit(1)))


def rows_of(frame):
    return sorted((r.key, r.nth, r.value) for r in frame.collect())


def test_keyed_rows(spark):
    keyed.register(spark)
    read = lambda **o: spark.read.format("keyed_rows").options(**{"seed": 3, "per_key": 2, **o}).load()
    got = rows_of(read(first=5, last=40, partitions=4))
    want = spark.range(5, 40).select(F.col("id").alias("key"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("nth"))
    assert got == rows_of(want.withColumn("value", mix("key", F.col("nth"), 3)))
    assert got == rows_of(read(first=5, last=40, partitions=1)) and rows_of(read(first=5, last=5)) == []
    assert [(p.first, p.last) for p in keyed.split(0, 3, 8)] == [(0, 1), (1, 2), (2, 3)]
    # a partition read again, as after a lost task, has the same rows
    reader = keyed.KeyedRows({"first": "0", "last": "9", "seed": "3"}).reader(None)
    part = reader.partitions()[1]
    assert [b.to_pydict() for b in reader.read(part)] == [b.to_pydict() for b in reader.read(part)]


def test_keyed_rows_as_a_stream_that_starts_again(spark):
    keyed.register(spark)
    out, state = fresh_folder(spark, "out"), fresh_folder(spark, "state")
    for last in (25, 25, 40):  # the second start finds nothing new
        stream = spark.readStream.format("keyed_rows").options(first=0, last=last, per_key=2, seed=3, batch_keys=10, partitions=3).load()
        seen = stream.observe("read", F.count(F.lit(1)).alias("n"))
        query = seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        until = time.time() + 60
        while time.time() < until:
            query.processAllAvailable()
            if spark.read.parquet(out).count() >= 2 * last:
                break
        counted = counters.stream_counts(query, "read")
        query.stop()
        assert counted.get("n", 0) in {50, 0, 30}
    got = rows_of(spark.read.parquet(out))
    assert got == rows_of(spark.read.format("keyed_rows").options(last=40, per_key=2, seed=3).load())


def plain_search(windows, n_best, most, with_empty, threshold):
    out = {}
    by = defaultdict(list)
    for w in windows:
        by[w["qid"]].append(w)
    for qid, own in by.items():
        own.sort(key=lambda w: w["window"])
        found = []
        for w in own:
            order = lambda x: sorted(range(len(x)), key=lambda i: (-x[i], i))[:n_best]
            for a in order(w["starts"]):
                for b in order(w["ends"]):
                    size = len(w["tokens"])
                    if a < size and b < size and w["places"][a] is not None and w["places"][b] is not None and w["best"][a] and a <= b < a + most:
                        found.append((w["starts"][a] + w["ends"][b], (w["window"], a, b), " ".join(w["words"][w["places"][a] : w["places"][b] + 1])))
        none = min((w["starts"][0] + w["ends"][0], w["window"]) for w in own)[0]
        if with_empty:
            found.append((none, (math.inf,), ""))
        elif not found:
            found.append((0.0, (0,), "empty"))
        found.sort(key=lambda x: (-x[0], x[1]))
        seen, kept = set(), []
        for score, _, text in found:
            if text not in seen and len(kept) < n_best:
                seen.add(text)
                kept.append((text, score))
        if with_empty and "" not in seen:
            kept.append(("", none))
        top = max(s for _, s in kept)
        total = sum(math.exp(s - top) for _, s in kept)
        named = next(((t, s) for t, s in kept if t), None)
        answer = "" if named is None or (with_empty and none - named[1] > threshold) else named[0]
        out[qid] = ([(t, round(math.exp(s - top) / total, 9)) for t, s in kept], answer)
    return out


@pytest.mark.parametrize("with_empty", [True, False])
def test_answer_search(spark, with_empty):
    import random

    rng = random.Random(4)
    windows = []
    for qid in range(12):
        words = [rng.choice("abc") for _ in range(14)]
        for k in range(2):
            places = [None, *range(k * 6, k * 6 + 8), None]
            tokens = ["[CLS]", *[words[p] for p in places[1:-1]], "[SEP]"]
            logits = lambda: [rng.randrange(80) / 8 for _ in range(len(tokens) + 2)]  # longer than the tokens, with ties
            best = [False, *[rng.random() < 0.6 and qid != 3 for _ in range(8)], True]
            windows.append({"qid": qid, "window": k, "words": words, "tokens": tokens, "places": places, "best": best, "starts": logits(), "ends": logits()})
    df = spark.createDataFrame(
        [tuple(w.values()) for w in windows],
        "qid long, window int, words array<string>, tokens array<string>, places array<int>, best array<boolean>, starts array<double>, ends array<double>").repartition(3)
    got = answers.answer_search(df, "qid", "window", "tokens", "places", "best", "starts", "ends", "words", 5, 4, with_empty, 1.0).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.qid, r.place)):
        found[r.qid].append((r.text, round(r.probability, 9)))
    want = plain_search(windows, 5, 4, with_empty, 1.0)
    assert {q: (v, next(r.answer for r in got if r.qid == q)) for q, v in found.items()} == want
    assert Counter(r.qid for r in got).keys() == set(range(12))


def test_label_lines_do_not_meet_by_label(spark):
    """Few labels stand on all lines: the lines stay where they are."""
    from feedloom.operators.joins import label_map
    from feedloom.sources.readers import token_label_rows

    files = spark.createDataFrame([(1, "a\tB\nb\tO\n\nc\nd\tX"), (2, "e\tI\nf\tB")], "k int, text string")
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = token_label_rows(files, "k", "text", label_map(spark, ["1,B", "2,I", "3,O"]))
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)
    assert got == [(1, 0, 0, "a", 1), (1, 0, 1, "b", 3), (1, 1, 0, "c", 0), (1, 1, 1, "d", 0), (2, 0, 0, "e", 2), (2, 0, 1, "f", 1)]
