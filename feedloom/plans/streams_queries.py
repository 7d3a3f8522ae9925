"""Registered queries: streaming jobs, each compared with its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators.aggregates import confusion_iou
from feedloom.plans.catalog import check
from feedloom.plans.tables import h_sql
from feedloom.session import fresh_folder
from feedloom.streaming import jobs as S

PARTS = 4


def feed(t, df, order: str, run):
    """Let the rows arrive in ``PARTS`` steps, by ranges of the order key, and run the job after
    each; returns what the last run returned. ``run`` gets (stream, folder)."""
    folder = fresh_folder(t.spark, "stream")
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - low) * PARTS / (high - low + 1)), F.lit(PARTS - 1))
    result = None
    for i in range(PARTS):
        df.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        result = run(S.file_stream(t.spark, f"{folder}/in", df.schema), folder)
    return result


@check("stream_trace", "trace", """
SELECT job_name, (arg_max(additional, (time, event_id)) FILTER (WHERE event_type <> 'execution_mode_change'))::INT AS workers,
  arg_max(additional, (time, event_id)) FILTER (WHERE event_type = 'execution_mode_change') AS mode, count(*) FILTER (WHERE event_type = 'execution_mode_change') AS epochs
FROM trace GROUP BY 1""")
def _(t):
    run = lambda stream, folder: S.latest_result(S.trace_state(stream), f"{folder}/out", f"{folder}/checkpoint")
    return feed(t, t.trace, "time", run)


@check("stream_file_append", sql="SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    """A first run sees half of the files; a second run goes on with those added since."""
    folder = fresh_folder(t.spark, "stream")
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    half = rows.agg(F.max("event_id")).first()[0] // 2
    for part in (rows.filter(F.col("event_id") <= half), rows.filter(F.col("event_id") > half)):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = S.file_stream(t.spark, f"{folder}/in", rows.schema, 2)
        S.append_rows(stream, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.schema(rows.schema).parquet(f"{folder}/out")


@check("stream_metric_accumulate", "vectors", """
WITH c AS (SELECT label AS t, predicted AS p, count(*)::DOUBLE AS w FROM vectors GROUP BY 1, 2),
k AS (SELECT class, sum(tp) AS tp, sum(w) - sum(tp) AS un FROM (SELECT t AS class, CASE WHEN t = p THEN w ELSE 0 END AS tp, w FROM c UNION ALL SELECT p, 0, w FROM c) GROUP BY 1)
SELECT class, round(tp / un, 9) AS iou FROM k UNION ALL SELECT -1, round(avg(tp / un), 9) FROM k""")
def _(t):
    def run(stream, folder):
        counts = stream.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
        return S.latest_result(counts, f"{folder}/out", f"{folder}/checkpoint")

    cells = feed(t, t.vectors.select("vec_id", "label", "predicted"), "vec_id", run)
    out = confusion_iou(cells, "label", "predicted", F.col("n").cast("double"))
    return out.select("class", F.round("iou", 9).alias("iou"))


@check("stream_count_window", sql="""
WITH n AS (SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 16 AS window_id, count(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT event_id, event_type, window_id FROM n WHERE window_id < total // 16""")
def _(t):
    def run(stream, folder):
        last = S.count_windows(stream, "event_type", "event_id", 16, f"{folder}/out", f"{folder}/checkpoint")
        return S.emitted_windows(t.spark, f"{folder}/out", "event_type", 16, last)

    return feed(t, t.events.select("event_id", "event_type"), "event_id", run)


@check("stream_bounded_buffer_shuffle", sql=f"""
WITH b AS (SELECT event_id, least(floor((event_id - lo) * 4 / (hi - lo + 1)), 3)::INT AS buffer FROM events, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events))
SELECT event_id, buffer, row_number() OVER (PARTITION BY buffer ORDER BY {h_sql('event_id', '0', 6)}, event_id) - 1 AS pos_in_buffer FROM b""")
def _(t):
    def run(stream, folder):
        S.shuffled_buffers(stream, "event_id", 6, f"{folder}/out", f"{folder}/checkpoint")
        return t.spark.read.parquet(f"{folder}/out").select("event_id", "buffer", "pos_in_buffer")

    return feed(t, t.events.select("event_id"), "event_id", run)
