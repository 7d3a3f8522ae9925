"""Registered queries: aggregates and evaluation counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.text import split_alnum_runs
from feedloom.operators import aggregates as G
from feedloom.operators.dataset import dedup_keep_last
from feedloom.plans.catalog import check
from feedloom.session import spread

SUMMARY_SQL = """s AS (SELECT cache_policy, sleep_ms,
  CASE WHEN count(*) > 2 THEN avg(seconds) FILTER (WHERE epoch >= 2) ELSE avg(seconds) END AS avg,
  CASE WHEN count(*) > 2 THEN stddev_pop(seconds) FILTER (WHERE epoch >= 2) ELSE stddev_pop(seconds) END AS std,
  CASE WHEN count(*) > 2 THEN count(*) - 2 ELSE count(*) END AS num_epochs_for_avg,
  avg(seconds) AS avg_all_epochs, stddev_pop(seconds) AS std_all_epochs, count(*) AS num_epochs
  FROM sweep GROUP BY 1, 2)"""
COST_SQL = SUMMARY_SQL + """, c AS (SELECT sleep_ms, 1000 * max(avg) FILTER (WHERE cache_policy = 2) / 556 AS compute,
  1000 * max(avg) FILTER (WHERE cache_policy = 3) / 556 AS cache, 1000 * max(avg) FILTER (WHERE cache_policy = 4) / 556 AS source,
  1000 * max(avg) FILTER (WHERE cache_policy = 5) / 556 AS auto FROM s GROUP BY 1)"""
DECISION_SQL = """d AS (SELECT 200 + 50 * (event_id % 8) AS sleep_ms,
  CASE (props->>'$.k')::INT % 7 WHEN 1 THEN 'cache' WHEN 2 THEN 'cache' WHEN 3 THEN 'source' WHEN 4 THEN 'source' WHEN 5 THEN 'compute' END AS decision
  FROM events WHERE event_type = 'view' AND (props->>'$.k')::INT % 7 BETWEEN 1 AND 5),
m AS (SELECT sleep_ms, decision FROM (SELECT *, row_number() OVER (PARTITION BY sleep_ms ORDER BY n DESC, decision) AS r
  FROM (SELECT sleep_ms, decision, count(*) AS n FROM d GROUP BY 1, 2)) WHERE r = 1)"""


def costs(t):
    summary = G.sweep_summary(t.sweep, ["cache_policy", "sleep_ms"], "epoch", "seconds")
    return G.time_per_batch(summary, "sleep_ms", "cache_policy", 556)


def raw_decisions(t):
    """Decision log rows: the sweep point and the raw text of the decision."""
    names = ["PROFILE", "PUT", "GET", "PUT_SOURCE", "GET_SOURCE", "COMPUTE", "WHAT"]
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.filter("event_type = 'view'").select(
        (200 + 50 * (F.col("event_id") % 8)).alias("sleep_ms"),
        F.get(F.array(*map(F.lit, names)), k % 7).alias("decision"),
    )


def decisions(t):
    from feedloom.operators.timelines import clean_decisions

    known, _ = clean_decisions(raw_decisions(t), "decision")
    return G.group_mode(known, ["sleep_ms"], "decision", "decision")


@check("filter_min_count", "ratings", """
SELECT user_id, item_id, ts FROM ratings WHERE user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 20)""")
def _(t):
    return G.filter_min_count(t.ratings, "user_id", 20).select("user_id", "item_id", "ts")


@check("zero_index", "ratings", """
WITH f AS (SELECT *, row_number() OVER (ORDER BY ts, item_id, user_id) AS p FROM ratings)
SELECT item_id, row_number() OVER (ORDER BY min(p)) - 1 AS index FROM f GROUP BY 1""")
def _(t):
    return G.zero_index(t.ratings, "item_id", ["ts", "item_id", "user_id"])


@check("group_mode", sql=f"WITH {DECISION_SQL} SELECT sleep_ms, decision FROM m")
def _(t):
    return decisions(t)


@check("pivot_indicator", sql=f"""
WITH {DECISION_SQL} SELECT sleep_ms, (decision = 'cache')::INT AS cache, (decision = 'compute')::INT AS compute,
  (decision = 'source')::INT AS source FROM m""")
def _(t):
    return G.pivot_indicator(decisions(t), "sleep_ms", "decision", ["cache", "compute", "source"])


@check("sweep_summary", "sweep", f"""
WITH {SUMMARY_SQL} SELECT cache_policy, sleep_ms, round(avg, 6) AS avg, round(std, 6) AS std, num_epochs_for_avg,
  round(avg_all_epochs, 6) AS avg_all_epochs, round(std_all_epochs, 6) AS std_all_epochs, num_epochs FROM s""")
def _(t):
    out = G.sweep_summary(t.sweep, ["cache_policy", "sleep_ms"], "epoch", "seconds")
    for c in ("avg", "std", "avg_all_epochs", "std_all_epochs"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@check("time_per_batch", "sweep", f"""
WITH {COST_SQL} SELECT sleep_ms, round(compute, 6) AS compute, round(cache, 6) AS cache, round(source, 6) AS source,
  round(auto, 6) AS auto FROM c""")
def _(t):
    return costs(t).select("sleep_ms", *[F.round(c, 6).alias(c) for c in ("compute", "cache", "source", "auto")])


@check("decision_cost_select", "sweep", f"""
WITH {COST_SQL}, {DECISION_SQL} SELECT sleep_ms, decision, round(CASE decision WHEN 'compute' THEN compute
  WHEN 'cache' THEN cache ELSE source END, 6) AS cost FROM c JOIN m USING (sleep_ms)""")
def _(t):
    return G.decision_cost(costs(t), decisions(t), "sleep_ms", "decision").withColumn("cost", F.round("cost", 6))


@check("best_mode", "sweep", f"""
WITH {COST_SQL} SELECT sleep_ms, CASE least(compute, source, cache) WHEN compute THEN 'compute' WHEN source THEN 'source'
  ELSE 'cache' END AS best_mode, round(least(compute, source, cache), 6) AS cost FROM c""")
def _(t):
    out = G.best_mode(costs(t), "sleep_ms", ["compute", "source", "cache"])
    return out.withColumn("cost", F.round("cost", 6))


@check("throughput", "trace", """
WITH s AS (SELECT job_name, time / 1e6 AS x, row_number() OVER (PARTITION BY job_name ORDER BY time, event_id) - 1 AS step FROM trace),
g AS (SELECT job_name, max(step) AS n, max_by(x, step) AS tl, max(x) FILTER (WHERE step = 0) AS t0, max(x) FILTER (WHERE step = 5) AS tw FROM s GROUP BY 1)
SELECT job_name, round(32 * n / (tl - t0), 9) AS all_per_sec, round(32 * (n - 5) / (tl - tw), 9) AS warm_per_sec FROM g""")
def _(t):
    steps = t.trace.withColumn("x", F.col("time") / 1e6)
    out = G.throughput(steps, "job_name", "x", ["time", "event_id"], 32, 5)
    return out.select("job_name", F.round("all_per_sec", 9).alias("all_per_sec"), F.round("warm_per_sec", 9).alias("warm_per_sec"))


@check("token_counts", sql=r"""
WITH r AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS x FROM documents)
SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(x, lambda t, i: t <> ' ' OR i = 1 OR i = len(x))) AS token FROM r) GROUP BY 1""")
def _(t):
    return G.token_counts(spread(t.documents), split_alnum_runs("text"))


@check("alphabet", sql=r"""
SELECT DISTINCT unnest(string_split(text || '\_u;0123456789', '')) AS ch FROM documents""")
def _(t):
    return G.alphabet(t.documents, "text")


@check("confusion_matrix_iou", "vectors", """
WITH c AS (SELECT label AS t, predicted AS p, sum(CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS w FROM vectors GROUP BY 1, 2),
k AS (SELECT class, sum(tp) AS tp, sum(w) - sum(tp) AS un FROM (
  SELECT t AS class, CASE WHEN t = p THEN w ELSE 0 END AS tp, w FROM c UNION ALL SELECT p, 0, w FROM c) GROUP BY 1 HAVING sum(w) - sum(tp) > 0)
SELECT class, tp, un AS "union", round(tp / un, 9) AS iou FROM k
UNION ALL SELECT -1, sum(tp), sum(un), round(avg(tp / un), 9) FROM k""")
def _(t):
    valid = F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(1.0)
    return G.confusion_iou(t.vectors, "label", "predicted", valid).withColumn("iou", F.round("iou", 9))


@check("matthews_corr", sql="""
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS tn,
  count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS fn FROM labels)
SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM c""")
def _(t):
    return G.matthews(t.labels, F.col("quality") == 1, F.col("toxic") == 0).select(F.round("mcc", 9).alias("mcc"))


@check("pearson_spearman", sql="""
WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y,
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS ry FROM lineitem)
SELECT round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman, round((corr(x, y) + corr(rx, ry)) / 2, 9) AS mean FROM r""")
def _(t):
    out = G.pearson_spearman(t.lineitem, "l_quantity", "l_extendedprice")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@check("dedup_keep_last", sql="""
SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def _(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    return dedup_keep_last(rows, ["user_id"], "event_id")


@check("assert_consistent_metadata", sql="""
SELECT array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, 5 AS n FROM events""")
def _(t):
    parts = t.events.groupBy((F.col("event_id") % 4).alias("part")).agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    meta = parts.select(F.array_join("k", ",").alias("kinds"), F.size("k").alias("n"))
    return G.assert_consistent(meta)


@check("padded_accuracy", "pairs", """
WITH p AS (SELECT conv_id, turn, list_transform(string_split(a, ' '), lambda w: length(w) % 5) AS o,
  list_transform(string_split(b, ' '), lambda w: length(w) % 5) AS l FROM pairs),
x AS (SELECT conv_id, turn, unnest(l) AS l, unnest(o[1:len(l)]) AS o FROM p),
y AS (SELECT conv_id, turn, l, coalesce(o, 0) AS o, o IS NULL AS pad FROM x WHERE l IS NOT NULL AND l <> 0),
s AS (SELECT conv_id, turn, bool_and(o = l) AS ok FROM y GROUP BY 1, 2)
SELECT round((SELECT avg((o = l)::INT) FROM y), 9) AS accuracy,
  round((SELECT avg((o = l OR (NOT pad AND (o + 1) % 5 = l))::INT) FROM y), 9) AS top_k_accuracy,
  round((SELECT sum(ok::INT) + (SELECT count(*) FROM p) - count(*) FROM s) / (SELECT count(*) FROM p), 9) AS sequence_accuracy""")
def _(t):
    size = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w) % 5)
    guess = F.transform(size("a"), lambda c: F.array(c, (c + 1) % 5))
    out = G.padded_accuracy(t.pairs.select(size("b").alias("l"), guess.alias("r")), "l", "r", 2)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@check("tagging_span_f1", sql="""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'O' WHEN 'click' THEN 'B-X' WHEN 'view' THEN 'I-X' WHEN 'error' THEN 'B-Y' ELSE 'I-Y' END AS gold,
  (props->>'$.k')::INT AS k FROM events),
g AS (SELECT user_id, event_id, gold, CASE k % 10 WHEN 0 THEN 'O' WHEN 1 THEN 'B-X' ELSE gold END AS pred FROM e),
u AS (SELECT 1 AS side, user_id, event_id, gold AS tag FROM g UNION ALL SELECT 2, user_id, event_id, pred FROM g),
l AS (SELECT *, lag(tag) OVER (PARTITION BY side, user_id ORDER BY event_id) AS p FROM u),
b AS (SELECT *, sum((tag <> 'O' AND (tag[1] = 'B' OR p IS NULL OR p = 'O' OR p[3:] <> tag[3:]))::INT) OVER (PARTITION BY side, user_id ORDER BY event_id) AS span FROM l),
s AS (SELECT side, user_id, span, min(tag[3:]) AS kind, min(event_id) AS b, max(event_id) AS e FROM b WHERE tag <> 'O' GROUP BY 1, 2, 3),
f AS (SELECT user_id, kind, b, e, sum(side) AS s FROM s GROUP BY 1, 2, 3, 4),
c AS (SELECT count(*) FILTER (WHERE s = 3)::DOUBLE AS tp, count(*) FILTER (WHERE s >= 2)::DOUBLE AS np, count(*) FILTER (WHERE s IN (1, 3))::DOUBLE AS nt FROM f)
SELECT round(tp / np, 9) AS precision, round(tp / nt, 9) AS recall, round(2 * (tp / np) * (tp / nt) / (tp / np + tp / nt), 9) AS f1,
  round((SELECT avg((gold = pred)::INT) FROM g), 9) AS accuracy FROM c""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.create_map(*[F.lit(x) for x in ("signup", "O", "click", "B-X", "view", "I-X", "error", "B-Y", "purchase", "I-Y")])
    rows = t.events.select("user_id", "event_id", tags[F.col("event_type")].alias("gold"), k.alias("k"))
    guess = F.when(F.col("k") % 10 == 0, "O").when(F.col("k") % 10 == 1, "B-X").otherwise(F.col("gold"))
    out = G.tagging_span_f1(rows.withColumn("pred", guess), "user_id", "event_id", "gold", "pred")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])
