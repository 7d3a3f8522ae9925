"""Analysis of run traces: steps, intervals, epochs, decisions and log extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.arrays import let
from feedloom.operators.joins import by_repetition
from feedloom.operators.ordered import with_neighbour, with_position, with_running

# Event types of a trace.
STEP_EVENTS = ("scale_up", "scale_down", "starting_worker_count", "end_training")
EPOCH_EVENTS = ("execution_mode_change", "extended_epoch", "end_training")


def normalise_time(trace: DataFrame, time: str = "time") -> DataFrame:
    """Microseconds to seconds since the first event of the whole trace."""
    start = trace.agg(F.min(time)).first()[0]
    return trace.withColumn(time, (F.col(time) - F.lit(start)) / 1e6)


def worker_steps(trace: DataFrame) -> DataFrame:
    """Per job: worker count from each step event until the next one."""
    steps = trace.filter(F.col("event_type").isin(*STEP_EVENTS)).select(
        "job_name", "event_id", "time", F.col("additional").try_cast("int").alias("workers")
    )
    return with_neighbour(steps, ["time", "event_id"], {"until": "time"}, ["job_name"])


def epoch_intervals(trace: DataFrame) -> DataFrame:
    """Per job: [start, end) between consecutive epoch boundaries, with the mode at the start."""
    marks = trace.filter(F.col("event_type").isin(*EPOCH_EVENTS)).select(
        "job_name", "event_id", F.col("time").alias("start"), F.col("additional").alias("mode")
    )
    out = with_neighbour(marks, ["start", "event_id"], {"end": "start"}, ["job_name"])
    return out.filter(F.col("end").isNotNull()).withColumn(
        "seconds", (F.col("end") - F.col("start")).cast("int")
    )


def epoch_runtimes(events: DataFrame, begin: str, end: str) -> DataFrame:
    """Wall time of each begin event that is followed by an end event."""
    marks = events.filter(F.col("event_type").isin(begin, end))
    out = with_neighbour(
        marks, ["time", "event_id"], {"_kind": "event_type", "finished": "time"}, ["job_name"]
    )
    out = out.filter((F.col("event_type") == begin) & (F.col("_kind") == end))
    return out.select("job_name", "event_id", (F.col("finished") - F.col("time")).alias("runtime"))


def epoch_times_from_lines(lines: DataFrame, job: str, line: str, order_by) -> DataFrame:
    """Log lines alternate start and finish; the time is the text before the first comma."""
    stamped = lines.withColumn("_t", F.substring_index(line, ",", 1).cast("double"))
    nth = with_position(stamped, order_by, [job], "_nth")
    at = lambda odd: F.max(F.when(F.col("_nth") % 2 == odd, F.col("_t")))
    pairs = nth.groupBy(job, F.floor(F.col("_nth") / 2).alias("epoch")).agg(
        at(0).alias("_a"), at(1).alias("_b")
    )
    return pairs.filter(F.col("_b").isNotNull()).select(job, "epoch", (F.col("_b") - F.col("_a")).alias("seconds"))


def first_decrease(df: DataFrame, key: str, value: str, order_by) -> DataFrame:
    """The last distinct maximum before the first drop; the last value when none drops.

    Up to the first drop the values never fall, so the answer is the largest value below the
    maximum reached by then, or the first value when there is none.
    """
    nth = with_position(df, order_by, [key], "_nth")
    run = with_running(nth, ["_nth"], {"_max": ("max", F.col(value))}, [key])
    drop = F.when(F.col(value) < F.col("_max"), F.struct("_nth", "_max"))
    ends = run.groupBy(key).agg(F.min(drop).alias("_d"), F.max_by(value, "_nth").alias("_last"),
                                F.min_by(value, "_nth").alias("_first"))
    before = run.join(ends, key).filter(
        (F.col("_nth") < F.col("_d._nth")) & (F.col(value) < F.col("_d._max"))
    )
    prior = before.groupBy(key).agg(F.max(value).alias("_prior"))
    out = ends.join(prior, key, "left")
    answer = F.when(F.col("_d").isNull(), F.col("_last")).otherwise(F.coalesce("_prior", "_first"))
    return out.select(key, answer.alias("workers"))


def cumulative_spans(df: DataFrame, group: Sequence[str], order_by, left: Column, right: Column, limit: Column) -> DataFrame:
    """Spans laid out one after another: ``left`` gap, then ``right`` length.

    begin = running left + earlier right; spans that start or end past ``limit`` are dropped.
    """
    run = with_running(df, order_by, {"_l": ("sum", left), "_r": ("sum", right)}, group)
    out = run.withColumn("begin", F.col("_l") + F.col("_r") - right).withColumn("end", F.col("begin") + right)
    return out.filter((F.col("begin") < limit) & (F.col("end") <= limit)).drop("_l", "_r")


def duplicate_mask(df: DataFrame, row: Sequence[str], value: str, order_by, out: str = "duplicate") -> DataFrame:
    """1 where the value already occurred earlier in the row.

    Earlier copies are found through the first position per (row, value), a map-side minimum.
    """
    first = df.groupBy(*row, value).agg(F.min(order_by).alias("_first"))
    return df.join(first, [*row, value]).withColumn(
        out, (F.col(order_by) > F.col("_first")).cast("int")
    ).drop("_first")


def stride_windows(n: Column, width, stride: int) -> Column:
    """Array of (window, start, length) covering n items; the last window ends at n."""
    width = width if isinstance(width, Column) else F.lit(width)
    step = F.least(width, F.lit(stride))
    last = F.when(n > width, F.ceil((n - width) / step)).otherwise(0).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(
            k.alias("window"), (k * step).cast("int").alias("start"),
            F.least(width, n - k * step).cast("int").alias("length"),
        ),
    )


def best_context(pos: Column, n: Column, width, stride: int) -> Column:
    """Window in which the item has the most context; the earliest on ties.

    Only the windows that contain the item are looked at: about width / stride of them.
    """
    width = width if isinstance(width, Column) else F.lit(width)
    step = F.least(width, F.lit(stride))
    last = F.when(n > width, F.ceil((n - width) / step)).otherwise(0).cast("int")
    low = F.greatest(F.ceil((pos - width + 1) / step), F.lit(0)).cast("int")
    high = F.least(F.floor(pos / step).cast("int"), last)

    def score(k):
        start = k * step
        length = F.least(width, n - start)
        context = F.least(pos - start, start + length - 1 - pos)
        return F.struct((context + 0.01 * length).alias("s"), (-k).alias("k"))

    return -F.array_max(F.transform(F.sequence(low, high), score))["k"]


# Raw decision -> reported decision.
DECISIONS = {
    "GET_SOURCE": "source", "PUT_SOURCE": "source", "GET": "cache", "PUT": "cache", "COMPUTE": "compute",
}


def clean_decisions(df: DataFrame, decision: str) -> tuple[DataFrame, DataFrame]:
    """Known decisions under their reported names, and a one-row count of the unknown ones.

    Profiling rows are dropped before either.
    """
    table = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    mapped = df.filter(F.col(decision) != "PROFILE").withColumn("_d", F.try_element_at(table, F.col(decision)))
    unknown = mapped.agg(F.count_if(F.col("_d").isNull()).alias("unknown"))
    known = mapped.filter(F.col("_d").isNotNull()).withColumn(decision, F.col("_d")).drop("_d")
    return known, unknown


# What the log lines look like.
DECISION_LINE, DECISION_TEXT = "Caching decision", r"for dataset_key [^:]*: (.*)$"
EPOCH_LINE, EPOCH_TEXT = "TimeHistory: ", r"TimeHistory: ([0-9.]+)"
REQUEST_LINE, REQUEST_TEXT = "request: ", r"request: ([0-9]+)"


def read_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line) of every text file below a folder."""
    return spark.read.option("recursiveFileLookup", True).text(folder).select(
        F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))).alias("path"),
        F.col("value").alias("line"),
    )


def extract_decisions(lines: DataFrame) -> DataFrame:
    """(sleep_time_msec, decision) from the path and the text of decision lines."""
    found = lines.filter(F.contains("line", F.lit(DECISION_LINE)))
    return found.select(
        F.regexp_extract("path", r"sleep_time_msec(?::|%3A)([0-9]+)", 1).cast("int").alias("sleep_time_msec"),
        F.regexp_extract("line", DECISION_TEXT, 1).alias("decision"),
    )


def extract_epoch_times(lines: DataFrame, exclude: str) -> DataFrame:
    """(workers, epoch_time) from the folder name and the timing lines."""
    found = lines.filter(F.contains("line", F.lit(EPOCH_LINE)) & ~F.contains("path", F.lit(exclude)))
    return found.select(
        F.regexp_extract("path", r"/([0-9]+)_workers", 1).cast("int").alias("workers"),
        F.regexp_extract("line", EPOCH_TEXT, 1).cast("double").alias("epoch_time"),
    )


def extract_requests(lines: DataFrame) -> DataFrame:
    """Requested worker count of every request line."""
    found = lines.filter(F.contains("line", F.lit(REQUEST_LINE)))
    return found.select("path", F.regexp_extract("line", REQUEST_TEXT, 1).cast("int").alias("workers"))


def item_tallies(df: DataFrame, keys: Sequence[str], items: str) -> DataFrame:
    """(keys, items, kinds, most): how many items the rows of a key list, how many differ, the most of one kind.

    A row is counted where it is; only the items of rows under one key are brought together. Keys
    without items are dropped.
    """
    tally = lambda whole, kinds, most: [whole.cast("bigint").alias("items"), kinds.cast("bigint").alias("kinds"), most.cast("bigint").alias("most")]

    def longest(ordered):
        """The longest run of equal items."""
        def step(state, i):
            run = F.when(F.get(ordered, i) == F.get(ordered, i - 1), state["run"] + 1).otherwise(1)
            return let(run, lambda r: F.struct(r.alias("run"), F.greatest(state["most"], r).alias("most")))

        start = F.struct(F.lit(1).alias("run"), F.lit(1).alias("most"))
        return F.aggregate(F.slice(F.sequence(F.lit(0), F.size(ordered)), F.lit(2), F.size(ordered) - 1), start, step)["most"]

    alone, repeated = by_repetition(df.select(*keys, items), keys)
    alone = alone.filter(F.size(items) > 0)
    out = alone.select(*keys, *tally(F.size(items), F.size(F.array_distinct(items)), let(F.sort_array(items), longest)))
    if repeated is not None:
        counts = repeated.select(*keys, F.explode(items).alias("_item")).groupBy(*keys, "_item").agg(F.count(F.lit(1)).alias("_n"))
        out = out.unionByName(counts.groupBy(*keys).agg(*tally(F.sum("_n"), F.count(F.lit(1)), F.max("_n"))))
    return out
