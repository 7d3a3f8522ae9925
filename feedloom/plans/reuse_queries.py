"""Registered queries: kept results and replayed epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.hashing import mix
from feedloom.operators import reuse as R
from feedloom.operators.dataset import shuffle_seeded
from feedloom.plans.catalog import check
from feedloom.plans.pipeline import Pipeline, Store, reuse_or_build
from feedloom.plans.tables import h_sql
from feedloom.session import fresh_folder


def order_totals(t) -> Pipeline:
    read = lambda spark, paths: spark.read.parquet(*paths)
    return (
        Pipeline([f"{t.dir}/lineitem.parquet"], read)
        .then("project", lambda df: df.select("l_orderkey", "l_quantity"), "l_orderkey, l_quantity")
        .mark("source")
        .then("total", lambda df: df.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total")), "sum of l_quantity")
        .mark("totals")
    )


TOTALS_SQL = "SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1"


@check("cache_mark", sql=TOTALS_SQL)
def _(t):
    """Marks name places in a pipeline and change nothing."""
    return order_totals(t).frame(t.spark)


@check("cache_put", sql=TOTALS_SQL)
def _(t):
    store = Store(t.spark, fresh_folder(t.spark, "store"))
    return store.put("totals", order_totals(t).frame(t.spark), compression="zstd", files=4)


@check("cache_get", sql=TOTALS_SQL)
def _(t):
    store = Store(t.spark, fresh_folder(t.spark, "store"))
    pipe = order_totals(t)
    store.put(pipe.fingerprint(t.spark), pipe.frame(t.spark))
    return store.get(pipe.fingerprint(t.spark))


@check("reuse_by_fingerprint", sql="SELECT count(*) AS orders, sum(total) AS total, min(kept) AS kept FROM (SELECT sum(l_quantity) AS total, 2::BIGINT AS kept FROM lineitem GROUP BY l_orderkey)")
def _(t):
    """A second job with the same steps reads what the first one kept."""
    folder = fresh_folder(t.spark, "store")
    order_totals(t).frame(t.spark, Store(t.spark, folder), keep=("source", "totals"))
    store, second = Store(t.spark, folder), order_totals(t)
    kept = sum(store.has(second.fingerprint(t.spark, at)) for at in second.marks.values())
    rows = second.frame(t.spark, store)
    return rows.agg(F.count("*").alias("orders"), F.sum("total").alias("total")).withColumn("kept", F.lit(kept).cast("bigint"))


@check("cache_memory", sql=f"""
SELECT event_id, row_number() OVER (ORDER BY {h_sql('event_id', '0', 3)}, event_id) - 1 AS pos FROM events WHERE event_type = 'view'""")
def _(t):
    """Rows are kept first and shuffled after, so every pass may order them anew."""
    kept = t.events.filter("event_type = 'view'").select("event_id").persist()
    return shuffle_seeded(kept, "event_id", 3)


def augment(df, version):
    return df.withColumn("noise", mix("event_id", version, 13) % 1000)


def base(t):
    return t.events.select("event_id")


PERIODIC_SQL = """SELECT event_id, epoch::INT AS epoch, version::INT AS version, {h} % 1000 AS noise FROM events, ({plan}) p"""


@check("periodic_cache", sql=PERIODIC_SQL.format(h=h_sql("event_id", "version", 13), plan="SELECT e AS epoch, e // 3 * 3 AS version FROM range(7) r(e)"))
def _(t):
    return R.periodic_cache(base(t), 7, 3, augment)


@check("adaptive_periodic_cache", sql=PERIODIC_SQL.format(h=h_sql("event_id", "version", 13), plan="""
SELECT e AS epoch, CASE WHEN e < 6 THEN e // 6 * 6 WHEN e < 10 THEN 6 + (e - 6) // 3 * 3 ELSE e END AS version FROM range(12) r(e)"""))
def _(t):
    return R.adaptive_cache(base(t), 12, augment, ((0, 6, 6), (6, 10, 3), (10, None, 1)))


@check("partial_periodic_cache", sql=f"""
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS total FROM events),
s AS (SELECT event_id, e AS epoch, CASE WHEN p < floor(total * 0.25) THEN 'cached' ELSE 'fresh' END AS source, CASE WHEN p < floor(total * 0.25) THEN e // 2 * 2 ELSE e END AS version FROM n, range(3) r(e)),
k AS (SELECT *, row_number() OVER (PARTITION BY epoch, source ORDER BY event_id) AS nth FROM s),
d AS (SELECT i AS draw, e AS epoch, CASE e WHEN 0 THEN {h_sql('i', '0', 19)} WHEN 1 THEN {h_sql('i', '0', 20)} ELSE {h_sql('i', '0', 21)} END / 2147483647.0::DOUBLE AS u FROM range((SELECT count(*) FROM events)) q(i), range(3) r(e)),
c AS (SELECT draw, epoch, CASE WHEN u < 0.5 THEN 'cached' ELSE 'fresh' END AS source FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY epoch, source ORDER BY draw) AS nth FROM c)
SELECT m.epoch::INT AS epoch, m.source, draw, event_id, version::INT AS version, {h_sql('event_id', 'version', 13)} % 1000 AS noise
FROM m JOIN k ON k.epoch = m.epoch AND k.source = m.source AND k.nth = m.nth""")
def _(t):
    return R.partial_cache(base(t), 3, 2, 0.25, (0.5, 0.5), "event_id", augment, 19)


@check("preprocessed_result_cache", sql=TOTALS_SQL)
def _(t):
    """A table without every expected column is built anew, a complete one is read."""
    path = fresh_folder(t.spark, "digest")
    build = lambda: order_totals(t).frame(t.spark)
    reuse_or_build(t.spark, path, ["l_orderkey"], lambda: build().select("l_orderkey"))
    reuse_or_build(t.spark, path, ["l_orderkey", "total"], build)

    def never():
        raise AssertionError("a complete table must be reused")

    return reuse_or_build(t.spark, path, ["l_orderkey", "total"], never)


# Steps of a supplier's pipeline, measured by its lines: line 1 is the source; storage of 4000 bytes in grains of 25.
MEASURED_SQL = """m AS (SELECT l_suppkey AS pipeline, l_linenumber - 1 AS mark, sum(l_quantity)::BIGINT AS compute, count(*) AS read, 2 * count(*) AS write,
  sum(1 + l_partkey % 40)::BIGINT AS bytes, 1 + max(l_partkey) % 4 AS uses FROM lineitem GROUP BY 1, 2)"""


def measured(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("pipeline"), (F.col("l_linenumber") - 1).alias("mark")).agg(
        F.sum("l_quantity").cast("bigint").alias("compute"), F.count("*").alias("read"), (2 * F.count("*")).alias("write"),
        F.sum(1 + F.col("l_partkey") % 40).alias("bytes"), (1 + F.max("l_partkey") % 4).alias("uses"))


@check("cache_advice", sql=f"""
WITH {MEASURED_SQL},
sub AS (SELECT p.pipeline, list_filter(p.marks, lambda v, i: (b // (1 << (i - 1)::INT)) % 2 = 1) AS kept
  FROM (SELECT pipeline, list(mark ORDER BY mark) FILTER (WHERE mark > 0) AS marks FROM m GROUP BY 1) p, range(64) r(b) WHERE b < (1 << len(p.marks)::INT)),
near AS (SELECT s.pipeline, s.kept, x.mark, x.uses, x.read, x.write, x.bytes, list_contains(s.kept, x.mark) AS own,
    coalesce(list_max(list_filter(s.kept, lambda v: v < x.mark)), 0) AS back FROM sub s JOIN m x ON x.pipeline = s.pipeline AND x.mark > 0),
reach AS (SELECT n.*, (SELECT sum(y.compute) FROM m y WHERE y.pipeline = n.pipeline AND y.mark > n.back AND y.mark <= n.mark)
    + coalesce((SELECT z.read FROM m z WHERE z.pipeline = n.pipeline AND z.mark = n.back), 0) AS here FROM near n),
cost AS (SELECT pipeline, kept, sum(CASE WHEN own THEN here + write + uses * read ELSE uses * here END)::BIGINT AS seconds,
    coalesce(sum(ceil(bytes / 25.0)) FILTER (WHERE own), 0)::BIGINT AS grains FROM reach GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY seconds, grains, len(kept), kept) AS r FROM cost WHERE grains <= 160)
SELECT b.pipeline, array_to_string(b.kept, ',') AS kept, b.seconds, b.grains, c.seconds AS plain FROM best b
JOIN cost c ON c.pipeline = b.pipeline AND len(c.kept) = 0 WHERE r = 1""")
def _(t):
    """The marks of each pipeline that are worth their storage, from measured times and sizes."""
    out = R.choose_marks(measured(t), "pipeline", 4000, 25)
    return out.withColumn("kept", F.array_join(F.col("kept").cast("array<string>"), ","))
