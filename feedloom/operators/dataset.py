"""Dataset operators: order, sampling, sharding, mixing. Order is always an explicit key."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.hashing import mix, unit
from feedloom.operators.ordered import as_columns, top_rows, with_position, with_running


def shuffle_seeded(df: DataFrame, key: str, seed: int, name: str = "pos") -> DataFrame:
    """Pseudo-random total order by a hash of a unique integer key (a full shuffle)."""
    return with_position(df, [mix(key, 0, seed), key], name=name)


def repeat_epochs(df: DataFrame, epochs: int, name: str = "epoch") -> DataFrame:
    """Finite repetition: every row once per epoch, produced in place by a generator."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias(name))


def shuffle_epochs(
    df: DataFrame, key: str, seed: int, epochs: int, cached: bool = False
) -> DataFrame:
    """A new order in each epoch, or the same order in all of them when ``cached``."""
    rows = repeat_epochs(df, epochs)
    counter = F.lit(0) if cached else F.col("epoch")
    return with_position(rows, [mix(key, counter, seed), key], ["epoch"])


def take_rows(df: DataFrame, n: int, order_by) -> DataFrame:
    return df.orderBy(*as_columns(order_by)).limit(n)


def skip_rows(df: DataFrame, n: int, order_by) -> DataFrame:
    """All but the first n rows, without sorting everything through one task."""
    return with_position(df, order_by, name="_pos").filter(F.col("_pos") >= n).drop("_pos")


def take_batch_and_repeat(df: DataFrame, batch: int, times: int, order_by) -> DataFrame:
    """One batch repeated: an upper bound for what a consumer can take in."""
    return repeat_epochs(take_rows(df, batch, order_by), times)


def shard_rows(df: DataFrame, shards: int, index: int, order_by) -> DataFrame:
    """Rows whose position modulo ``shards`` is ``index``."""
    return with_position(df, order_by).filter(F.col("pos") % shards == index)


def shard_paths(paths: Sequence[str], shards: int, index: int) -> tuple[list[str], bool]:
    """Files of one shard, and whether rows must still be sharded.

    Whole files are dealt out when there are at least as many files as shards; otherwise every
    shard reads all files and takes its rows by position.
    """
    if len(paths) > 1 and len(paths) >= shards:
        return [p for i, p in enumerate(paths) if i % shards == index], False
    return list(paths), shards > 1


def interleave(
    df: DataFrame, source: str, order_by, cycle: int, block: int = 1, name: str = "pos"
) -> DataFrame:
    """Deterministic round-robin over sources: ``cycle`` open at once, ``block`` rows a turn.

    A source keeps its slot until a turn finds it exhausted; the slot then opens the next source
    on its following turn. So a row's turn is its slot's opening turn plus rn // block, and only
    the opening turns need the source sizes (one row per source).
    """
    spark = df.sparkSession
    sizes = sorted((r[0], r[1]) for r in df.groupBy(source).count().collect())
    free = [(0, slot) for slot in range(min(cycle, len(sizes)))]
    heapq.heapify(free)
    opened = []
    for key, rows in sizes:
        turn, slot = heapq.heappop(free)
        opened.append((key, turn, slot))
        heapq.heappush(free, (turn + rows // block + 1, slot))
    kind = df.schema[source].dataType.simpleString()
    schema = f"{source} {kind}, _turn bigint, _slot int"
    starts = spark.createDataFrame(opened, schema)
    rows = with_position(df, order_by, [source], "_rn").join(starts, source)
    rows = rows.withColumn("_turn", F.col("_turn") + F.floor(F.col("_rn") / block))
    out = with_position(rows, ["_turn", "_slot", "_rn"], name=name)
    return out.drop("_turn", "_slot", "_rn")


def concat_datasets(parts: Sequence[DataFrame], order_by, name: str = "pos") -> DataFrame:
    """All rows of the first part, then of the second, ..."""
    tagged = [p.withColumn("src", F.lit(i)) for i, p in enumerate(parts)]
    return with_position(
        reduce(DataFrame.unionByName, tagged), ["src", *as_columns(order_by)], name=name
    )


def combine_sources(parts: dict[str, DataFrame], merge: Callable | None = None) -> DataFrame:
    """Named sources read apart and merged (default: union with a ``source`` column)."""
    if merge:
        return merge(parts)
    tagged = [p.withColumn("source", F.lit(name)) for name, p in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def zip_datasets(a: DataFrame, b: DataFrame, order_a, order_b) -> DataFrame:
    """Pair rows by position; ends with the shorter side. Column names must not clash."""
    return with_position(a, order_a).join(with_position(b, order_b), "pos")


def batch_sizes(total: int, ratio: float) -> tuple[int, int]:
    """(labelled, pseudo-labelled) rows of a batch; Python rounds halves to even."""
    if total < 0 or ratio < 0:
        raise ValueError("batch size and ratio must not be negative")
    pseudo = round(total * ratio / (1.0 + ratio))
    return total - pseudo, pseudo


def mix_ratio_batches(
    labelled: DataFrame, pseudo: DataFrame, total: int, ratio: float, order_by
) -> DataFrame:
    """Batches with a fixed share of both sources; ends with the shorter one."""
    sizes = batch_sizes(total, ratio)
    if not sizes[0]:
        raise ValueError("one source would get no rows")
    parts, batches = [], []
    for name, df, size in zip(("labelled", "pseudo"), (labelled, pseudo), sizes):
        if size:
            rows = with_position(df, order_by)
            batches.append(df.count() // size)
            parts.append(
                rows.withColumn("batch_id", F.floor(F.col("pos") / size))
                .withColumn("source", F.lit(name))
                .drop("pos")
            )
    return reduce(DataFrame.unionByName, parts).filter(F.col("batch_id") < min(batches))


def sample_mixture(
    df: DataFrame, source: str, weights: dict[str, float], draws: int, order_by, seed: int
) -> DataFrame:
    """``draws`` picks of a source by weight, each taking that source's next row.

    A pick from a source that has run out yields nothing.
    """
    spark = df.sparkSession
    u, edge, chosen = unit(F.col("draw"), 0, seed), 0.0, None
    for name, weight in weights.items():
        edge += weight
        hit = F.when(u < edge, F.lit(name))
        chosen = hit if chosen is None else F.coalesce(chosen, hit)
    picks = spark.range(draws).withColumnRenamed("id", "draw").withColumn(source, chosen)
    picks = with_position(picks.filter(F.col(source).isNotNull()), ["draw"], [source], "_nth")
    rows = with_position(df.filter(F.col(source).isin(*weights)), order_by, [source], "_nth")
    return picks.join(rows, [source, "_nth"]).drop("_nth")


def balanced_sample(
    df: DataFrame, label: Column, n: int, positive_fraction: float, key: str, seed: int
) -> DataFrame:
    """At most n rows, at most the given fraction of them positive, the rest negative."""
    marked = df.withColumn("positive", label)
    counts = {r[0]: r[1] for r in marked.groupBy("positive").count().collect()}
    n_pos = min(counts.get(True, 0), int(n * positive_fraction))
    n_neg = min(counts.get(False, 0), n - n_pos)
    best = top_rows(marked, max(n_pos, n_neg, 1), [mix(key, 0, seed), key], ["positive"])
    keep = F.when(F.col("positive"), F.lit(n_pos)).otherwise(F.lit(n_neg))
    return best.filter(F.col("rank") <= keep).drop("rank")


def sample_bytes(df: DataFrame, text: str, budget: int, order_by) -> DataFrame:
    """Leading rows until the character budget is passed; each row also counts a newline."""
    if budget <= 0:
        return df
    size = F.length(text) + 1
    run = with_running(df, order_by, {"_used": ("sum", size)})
    return run.filter(F.col("_used") - size <= budget).drop("_used")


def sort_by_length_desc(df: DataFrame, text: str, order_by) -> DataFrame:
    """Rows by token count, longest first; ``pos`` is the input order to restore later."""
    numbered = with_position(df, order_by).withColumn(
        "n_tokens", F.size(F.split(F.trim(F.col(text)), r"\s+"))
    )
    return with_position(numbered, [-F.col("n_tokens"), "pos"], name="sorted_pos")


def dedup_keep_last(df: DataFrame, key: Sequence[str], order_by) -> DataFrame:
    """One row per key, the last in order; partial maxima before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*as_columns(order_by))).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*")


def split_by_time(df: DataFrame, order_by, valid: int, test: int) -> DataFrame:
    """Oldest rows train, then ``valid`` rows, then the last ``test`` rows."""
    rows = df.count()
    out = with_position(df, order_by)
    split = (
        F.when(F.col("pos") >= rows - test, "test")
        .when(F.col("pos") >= rows - test - valid, "validation")
        .otherwise("train")
    )
    return out.withColumn("split", split)


def window_within(keys: Sequence[str], order_by):
    """Window over a group whose size is fixed by configuration (a batch, a candidate list)."""
    return Window.partitionBy(*keys).orderBy(*as_columns(order_by))
