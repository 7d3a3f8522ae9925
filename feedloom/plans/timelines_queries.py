"""Registered queries: run traces, windows over sequences, log extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.text import sliding, split_words
from feedloom.operators import answers as Q
from feedloom.operators import timelines as T
from feedloom.plans.aggregates_queries import raw_decisions
from feedloom.plans.catalog import check
from feedloom.plans.dataset_queries import WORDS
from feedloom.session import fresh_folder


@check("trace_normalise_time", "trace", """
SELECT event_id, job_name, round((time - (SELECT min(time) FROM trace)) / 1e6::DOUBLE, 6) AS time FROM trace""")
def _(t):
    return T.normalise_time(t.trace).select("event_id", "job_name", F.round("time", 6).alias("time"))


@check("worker_step_series", "trace", """
SELECT job_name, event_id, time, additional::INT AS workers,
  coalesce(lead(time) OVER (PARTITION BY job_name ORDER BY time, event_id), -1) AS until
FROM trace WHERE event_type IN ('scale_up', 'scale_down', 'starting_worker_count', 'end_training')""")
def _(t):
    return T.worker_steps(t.trace).withColumn("until", F.coalesce("until", F.lit(-1)))


@check("epoch_intervals", "trace", """
SELECT job_name, event_id, start, "end", mode, trunc("end" - start)::INT AS seconds FROM (
  SELECT job_name, event_id, (time - (SELECT min(time) FROM trace)) / 1e6::DOUBLE AS start, additional AS mode,
    lead((time - (SELECT min(time) FROM trace)) / 1e6::DOUBLE) OVER (PARTITION BY job_name ORDER BY time, event_id) AS "end"
  FROM trace WHERE event_type IN ('execution_mode_change', 'end_training')) WHERE "end" IS NOT NULL""")
def _(t):
    return T.epoch_intervals(T.normalise_time(t.trace))


@check("epoch_runtime", "trace", """
SELECT job_name, event_id, nt - time AS runtime FROM (SELECT *,
  lead(time) OVER w AS nt, lead(event_type) OVER w AS nk FROM trace WHERE event_type IN ('starting_worker_count', 'end_training')
  WINDOW w AS (PARTITION BY job_name ORDER BY time, event_id)) WHERE event_type = 'starting_worker_count' AND nk = 'end_training'""")
def _(t):
    return T.epoch_runtimes(t.trace, "starting_worker_count", "end_training")


@check("epoch_times_from_log", "trace", """
WITH n AS (SELECT job_name, time / 1e6::DOUBLE AS x, row_number() OVER (PARTITION BY job_name ORDER BY time, event_id) - 1 AS k FROM trace),
p AS (SELECT job_name, k // 2 AS epoch, max(x) FILTER (WHERE k % 2 = 0) AS a, max(x) FILTER (WHERE k % 2 = 1) AS b FROM n GROUP BY 1, 2)
SELECT job_name, epoch, round(b - a, 4) AS seconds FROM p WHERE b IS NOT NULL""")
def _(t):
    whole, part = F.expr("time div 1000000").cast("string"), (F.col("time") % 1000000).cast("string")
    line = F.concat(whole, F.lit("."), F.lpad(part, 6, "0"), F.lit(","), "event_type")
    lines = t.trace.select("job_name", "time", "event_id", line.alias("line"))
    out = T.epoch_times_from_lines(lines, "job_name", "line", ["time", "event_id"])
    return out.withColumn("seconds", F.round("seconds", 4))


@check("first_decrease", "trace", """
WITH v AS (SELECT job_name || '/' || (event_id % 50) AS run, additional::INT AS w, row_number() OVER (PARTITION BY job_name, event_id % 50 ORDER BY time, event_id) AS k
  FROM trace WHERE event_type IN ('scale_up', 'scale_down')),
m AS (SELECT *, max(w) OVER (PARTITION BY run ORDER BY k) AS mx FROM v),
d AS (SELECT run, min(k) FILTER (WHERE w < mx) AS dk, max_by(w, k) AS lst, min_by(w, k) AS fst FROM m GROUP BY 1)
SELECT d.run, CASE WHEN dk IS NULL THEN lst ELSE coalesce((SELECT max(w) FROM m WHERE m.run = d.run AND m.k < dk AND m.w < (
  SELECT mx FROM m m2 WHERE m2.run = d.run AND m2.k = dk)), fst) END AS workers FROM d""")
def _(t):
    rows = t.trace.filter(F.col("event_type").isin("scale_up", "scale_down")).select(
        F.concat_ws("/", "job_name", F.col("event_id") % 50).alias("run"), "time", "event_id",
        F.col("additional").cast("int").alias("w"),
    )
    return T.first_decrease(rows, "run", "w", ["time", "event_id"])


@check("cumulative_span", "tokens", """
WITH s AS (SELECT doc_id, pos, length(token) % 3 AS l, length(token) % 4 + 1 AS r FROM tokens),
c AS (SELECT *, sum(l) OVER w + sum(r) OVER w - r AS b FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos::INT AS pos, b::BIGINT AS begin, (b + r)::BIGINT AS "end" FROM c WHERE b < 512 AND b + r <= 512""")
def _(t):
    n = F.length("token")
    out = T.cumulative_spans(t.tokens, ["doc_id"], ["pos"], n % 3, n % 4 + 1, F.lit(512))
    return out.select("doc_id", "pos", "begin", "end")


@check("duplicate_mask", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) > 1)::INT AS duplicate
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    rows = rows.withColumn("at", F.col("l_partkey") * 100000 + F.col("l_suppkey"))
    return T.duplicate_mask(rows, ["l_orderkey"], "l_linenumber", "at").drop("at")


@check("sliding_ngrams", sql=f"""
WITH g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM (
  SELECT doc_id, {WORDS} AS w FROM documents)),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2)
SELECT doc_id, sum(n)::BIGINT AS windows, count(*) AS kinds, max(n) AS most FROM c GROUP BY 1""")
def _(t):
    grams = F.transform(sliding(split_words("text"), 3), lambda g: F.array_join(g, " "))
    return T.item_tallies(t.documents.select("doc_id", grams.alias("grams")), ["doc_id"], "grams").withColumnRenamed("items", "windows")


STRIDE_SQL = f"""n AS (SELECT doc_id, len({WORDS}) AS n, 61 - doc_id % 10 AS width FROM documents),
w AS (SELECT doc_id, n, width, unnest(range(CASE WHEN n > width THEN ceil((n - width) / 24.0)::INT ELSE 0 END + 1)) AS k FROM n WHERE n > 0),
x AS (SELECT doc_id, k::INT AS "window", (k * 24)::INT AS start, least(width, n - k * 24)::INT AS length FROM w)"""


@check("doc_stride_windows", sql=f"WITH {STRIDE_SQL} SELECT * FROM x")
def _(t):
    """Windows of 64 minus 3 markers minus a query of 0 to 9 tokens, 24 apart."""
    rows = t.documents.select("doc_id", F.size(split_words("text")).alias("n"), (61 - F.col("doc_id") % 10).cast("int").alias("width"))
    windows = T.stride_windows(F.col("n"), F.col("width"), 24)
    return rows.filter("n > 0").select("doc_id", F.inline(windows))


@check("max_context", sql=f"""
WITH {STRIDE_SQL}, p AS (SELECT doc_id, "window", start + i AS pos, least(i, length - 1 - i) + 0.01::DOUBLE * length AS score
  FROM (SELECT *, unnest(range(length)) AS i FROM x))
SELECT doc_id, pos::INT AS pos, arg_max("window", (score, -"window"))::INT AS "window" FROM p GROUP BY 1, 2""")
def _(t):
    n, width = F.size(split_words("text")), (61 - F.col("doc_id") % 10).cast("int")
    rows = t.documents.select("doc_id", n.alias("n"), width.alias("width")).filter("n > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    return rows.select("doc_id", "pos", T.best_context(F.col("pos"), F.col("n"), F.col("width"), 24).alias("window"))


QA_SCORES = """sc AS (SELECT qid, has_answer, na_prob, prediction,
  CASE WHEN has_answer THEN (truth = prediction)::INT ELSE (prediction = '')::INT END AS exact FROM qa)"""


def qa_exact(t):
    same = F.when(F.col("has_answer"), F.col("truth") == F.col("prediction")).otherwise(F.col("prediction") == "")
    return t.qa.select("qid", "has_answer", "na_prob", "prediction", same.cast("int").alias("exact"))


@check("pr_threshold_curve", "qa", """
WITH s AS (SELECT qid, floor(na_prob * 200) / 200 AS na_prob, has_answer, (length(prediction) % 2)::INT AS hit FROM qa),
g AS (SELECT na_prob, sum(CASE WHEN has_answer THEN hit ELSE 0 END) AS tp, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT na_prob, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY na_prob)),
k AS (SELECT count(*) FILTER (WHERE has_answer) AS total FROM s)
SELECT na_prob, round(ctp / cn, 9) AS precision, round(ctp / total, 9) AS recall, round(ctp / cn * tp / total, 9) AS ap_part FROM c, k""")
def _(t):
    rows = t.qa.select("qid", (F.floor(F.col("na_prob") * 200) / 200).alias("na_prob"), "has_answer", (F.length("prediction") % 2).alias("hit"))
    out = Q.precision_recall_curve(rows, "hit", "na_prob", F.col("has_answer"))
    return out.select("na_prob", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "ap_part")])


@check("best_threshold", "qa", """
WITH s AS (SELECT qid, na_prob, has_answer, CASE WHEN has_answer THEN (length(prediction) % 2)::INT ELSE CASE WHEN prediction <> '' THEN -1 ELSE 0 END END AS d FROM qa),
r AS (SELECT *, sum(d) OVER (ORDER BY na_prob, qid) AS run FROM s),
b AS (SELECT max(run) AS best FROM r), n AS (SELECT count(*) FILTER (WHERE NOT has_answer) AS none, count(*) AS total FROM s)
SELECT round(100.0 * (none + greatest(best, 0)) / total, 9) AS best_score,
  CASE WHEN best > 0 THEN (SELECT min(na_prob) FROM r WHERE run = best) ELSE 0.0 END AS best_threshold FROM b, n""")
def _(t):
    rows = t.qa.withColumn("hit", (F.length("prediction") % 2).cast("double"))
    out = Q.best_threshold(rows, "qid", "hit", "na_prob", "has_answer", "prediction")
    return out.select(F.round("best_score", 9).alias("best_score"), "best_threshold")


# --- log extraction ------------------------------------------------------------------------


def decision_logs(t) -> str:
    """Decision lines as log files, one folder per sweep point."""
    folder = fresh_folder(t.spark, "logs")
    text = F.concat(F.lit("I 12:00 Caching decision for dataset_key 12ab: "), F.col("decision"))
    noise = F.concat(F.lit("I 12:00 worker heartbeat "), F.col("decision"))
    rows = raw_decisions(t).select(F.concat(F.lit("cache_policy:5,sleep_time_msec:"), "sleep_ms").alias("point"), F.explode(F.array(text, noise)).alias("value"))
    rows.write.partitionBy("point").text(folder)
    return folder


@check("extract_decisions", sql="""
SELECT (200 + 50 * (event_id % 8))::INT AS sleep_time_msec, ['PROFILE', 'PUT', 'GET', 'PUT_SOURCE', 'GET_SOURCE', 'COMPUTE', 'WHAT'][(props->>'$.k')::INT % 7 + 1] AS decision
FROM events WHERE event_type = 'view'""")
def _(t):
    return T.extract_decisions(T.read_log_lines(t.spark, decision_logs(t)))


@check("extract_epoch_times", sql="""
SELECT (user_id % 6 + 1)::INT AS workers, value AS epoch_time FROM events WHERE event_type = 'click' AND user_id % 6 <> 0""")
def _(t):
    folder = fresh_folder(t.spark, "logs")
    name = F.when(F.col("user_id") % 6 == 0, F.lit("autoscale")).otherwise(F.concat((F.col("user_id") % 6 + 1).cast("string"), F.lit("_workers")))
    rows = t.events.filter("event_type = 'click'").select(name.alias("d"), F.concat(F.lit("x TimeHistory: "), F.col("value").cast("string"), F.lit(" seconds")).alias("value"))
    for d in [r[0] for r in rows.select("d").distinct().collect()]:
        rows.filter(F.col("d") == d).select("value").write.text(f"{folder}/{d}")
    return T.extract_epoch_times(T.read_log_lines(t.spark, folder), "autoscale")


@check("extract_requests", sql="""
SELECT (user_id % 6 + 1)::INT AS workers, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1""")
def _(t):
    folder = fresh_folder(t.spark, "logs")
    t.events.select(F.when(F.col("event_type") == "error", F.concat(F.lit("scaler request: "), (F.col("user_id") % 6 + 1).cast("string"))).otherwise("idle").alias("value")).write.text(folder)
    return T.extract_requests(T.read_log_lines(t.spark, folder)).groupBy("workers").agg(F.count("*").alias("n"))


@check("decision_clean", sql="""
SELECT 200 + 50 * (event_id % 8) AS sleep_ms, ['cache', 'cache', 'source', 'source', 'compute'][(props->>'$.k')::INT % 7] AS decision
FROM events WHERE event_type = 'view' AND (props->>'$.k')::INT % 7 BETWEEN 1 AND 5""")
def _(t):
    return T.clean_decisions(raw_decisions(t), "decision")[0]


@check("decision_unknown", sql="""
SELECT count(*) AS unknown FROM events WHERE event_type = 'view' AND (props->>'$.k')::INT % 7 = 6""")
def _(t):
    return T.clean_decisions(raw_decisions(t), "decision")[1]
