import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from feedloom.operators.reuse import replay_groups
from feedloom.plans import catalog
from feedloom.plans.pipeline import Registry, Store, reader, reuse_or_build

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# A few of each family; tools/check.py runs all of them.
SAMPLE = (
    "interleave_round_robin padded_batch scan_tsv_typed url_join_stories sweep_summary tagging_span_f1 "
    "worker_step_series best_threshold basic_tokenize pair_features hr_ndcg_at_k masked_lm qa_features "
    "em_f1 bleu match_thresholds gap reuse_by_fingerprint periodic_cache stream_trace stream_count_window"
).split()


def test_every_query_has_a_unique_name_and_known_views():
    queries, oracles = catalog.all_queries(), catalog.all_oracles()
    assert len(queries) > 200 and set(oracles) <= set(queries)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.all_queries()[name](spark, SF)
    cur = db.execute(catalog.all_oracles()[name])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert sorted(df.columns) == sorted(names) and got == want


def counted(calls):
    def step(df):
        calls.append(1)
        return df.withColumn("y", F.col("id") * 2)

    return step


def test_second_job_reads_what_the_first_kept(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    calls = []

    def job(version="1"):
        read = lambda s, paths: s.read.parquet(*paths)
        return reader([f"{tmp_path}/in"], read, version, parse=counted(calls)).mark("parsed").then("top", lambda d: d.filter("y > 10"))

    store = Store(spark, f"{tmp_path}/store")
    first = job().frame(spark, store, keep=["parsed"])
    second = job().frame(spark, store)
    assert len(calls) == 1 and sorted(first.collect()) == sorted(second.collect())
    job("2").frame(spark, store)
    assert len(calls) == 2
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/in")
    assert job().frame(spark, store).count() == first.count() and len(calls) == 3


def test_unknown_hook():
    with pytest.raises(ValueError):
        reader([], None, polish=lambda d: d)


def test_registry():
    r = Registry()
    r.register(int)(lambda c: c + 1)
    assert r.make(4) == 5
    with pytest.raises(ValueError):
        r.register(int)(lambda c: c)


def test_incomplete_table_is_built_anew(spark, tmp_path):
    path = f"{tmp_path}/t"
    reuse_or_build(spark, path, ["id"], lambda: spark.range(3))
    both = lambda: spark.range(4).withColumn("z", F.lit(1))
    assert reuse_or_build(spark, path, ["id"], both).count() == 3
    assert reuse_or_build(spark, path, ["id", "z"], both).count() == 4


def test_replay_plan():
    assert replay_groups(7, ((0, None, 3),)) == [(0, 0), (0, 1), (0, 2), (3, 3), (3, 4), (3, 5), (6, 6)]
    assert replay_groups(5, ((0, 2, 2), (2, None, 1))) == [(0, 0), (0, 1), (2, 2), (3, 3), (4, 4)]
