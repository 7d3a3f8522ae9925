"""Structured Streaming jobs over growing folders of record files.

Sources are file streams; each job has its own checkpoint folder, so it goes on where it stopped.
State that must survive between micro-batches is either Spark's own aggregation state or a table
written per batch number, which makes a repeated batch overwrite itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.hashing import mix
from feedloom.operators.ordered import with_position
from feedloom.operators.timelines import STEP_EVENTS


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Rows of record files in the order in which the files appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(stream: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Work off everything that is there now, batch by batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def append_rows(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Copy new rows to a growing table; exactly once per source file."""
    query = (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).format("parquet").start(out)
    )
    query.awaitTermination()


def trace_state(events: DataFrame) -> DataFrame:
    """Per job: workers held now, last mode, epochs begun. Works on streams and on tables.

    The state is one row per job. (Dropping the state of ended jobs would need a watermark; that
    would be an extension.)
    """
    at = F.struct("time", "event_id")
    step = F.col("event_type").isin(*STEP_EVENTS)
    mode = F.col("event_type") == "execution_mode_change"
    return events.groupBy("job_name").agg(
        F.max(F.when(step, F.struct(at.alias("at"), F.col("additional").try_cast("int").alias("v"))))["v"].alias("workers"),
        F.max(F.when(mode, F.struct(at.alias("at"), F.col("additional").alias("v"))))["v"].alias("mode"),
        F.count_if(mode).alias("epochs"),
    )


def latest_result(aggregated: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a streaming aggregation to the end of its input and return its last result.

    Each batch writes its own folder; the highest batch number is the current state.
    """
    spark = aggregated.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:010d}")

    drain(aggregated, checkpoint, "complete", write)
    last = last_batch(spark, out)
    if last is None:
        return spark.createDataFrame([], aggregated.schema)
    return spark.read.parquet(f"{out}/batch={last:010d}")


def last_batch(spark: SparkSession, out: str) -> int | None:
    """The highest batch written below a folder, now or by an earlier run; None before the first."""
    try:
        return spark.read.parquet(out).agg(F.max("batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def count_windows(stream: DataFrame, key: str, order_by: str, size: int, out: str, checkpoint: str) -> int | None:
    """Number every row within its key across batches and assign it to a window of ``size``.

    Carries one number per key from batch to batch. Rows are numbered by ranges, so a key that
    fills a whole batch does not end up in one task. Returns the last batch number, if any.
    """
    spark = stream.sparkSession
    empty = f"{key} {stream.schema[key].dataType.simpleString()}, seen bigint"

    def write(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema(empty).parquet(f"{out}/state/{number - 1}") if number else spark.createDataFrame([], empty)
        rows = with_position(batch, [order_by], [key], "_nth").join(seen, key, "left")
        nth = F.coalesce("seen", F.lit(0)) + F.col("_nth")
        rows = rows.withColumn("window_id", F.floor(nth / size)).drop("_nth", "seen")
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("more")).join(seen, key, "full")
        counts = counts.select(key, (F.coalesce("seen", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("seen"))
        counts.write.mode("overwrite").parquet(f"{out}/state/{number}")

    drain(stream, checkpoint, "append", write)
    return last_batch(spark, f"{out}/rows")


def emitted_windows(spark: SparkSession, out: str, key: str, size: int, last_batch: int, flush: bool = False) -> DataFrame:
    """Rows of the windows that are full by now; with ``flush`` also the unfinished ones."""
    rows = spark.read.parquet(f"{out}/rows").drop("batch")
    if flush:
        return rows
    seen = spark.read.parquet(f"{out}/state/{last_batch}")
    return rows.join(seen, key).filter(F.col("window_id") < F.floor(F.col("seen") / size)).drop("seen")


def shuffled_buffers(stream: DataFrame, key: str, seed: int, out: str, checkpoint: str) -> None:
    """Each micro-batch is one shuffle buffer: rows get a seeded position inside it."""

    def write(batch: DataFrame, number: int) -> None:
        rows = with_position(batch, [mix(key, 0, seed), key], name="pos_in_buffer")
        rows.withColumn("buffer", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    drain(stream, checkpoint, "append", write)
