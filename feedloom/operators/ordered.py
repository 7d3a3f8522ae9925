"""Order-dependent operators that never put a whole group into one task.

A plain window over (group, order) sends each group to a single task. Here the rows are first
cut into ranges of (group, order) by sampled split points, so a group of any size is spread over
many tasks; each range is solved locally and the ranges of a group are stitched together with one
small per-range table, which holds the groups at split points only. Split points come from a seeded hash sample, and the range number is an
ordinary deterministic column, so a recomputed task always agrees with its neighbours.

Order keys must be total within a group (add a tie-break) and group keys must not be null.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.arrays import let
from feedloom.session import staged

RANGE = "_range"
EDGE = "_edge_group"  # whether the row's group may lie in several ranges
SMALL_ROWS = 4096  # one range suffices up to here
SAMPLES_PER_RANGE = 64


def as_columns(keys) -> list[Column]:
    if isinstance(keys, (str, Column)):
        keys = [keys]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _plain_keys(df: DataFrame, order_by) -> tuple[list[Column], T.StructType]:
    """Order keys as JSON-safe values (timestamps become microseconds)."""
    cols = [c.alias(f"k{i}") for i, c in enumerate(as_columns(order_by))]
    out = []
    for i, field in enumerate(df.select(*cols).schema.fields):
        col = as_columns(order_by)[i]
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.unix_micros(col.cast("timestamp"))
        elif isinstance(field.dataType, T.DateType):
            col = F.unix_date(col)
        out.append(col.alias(f"k{i}"))
    return out, df.select(*out).schema


def split_points(df: DataFrame, order_by, ranges: int | None = None) -> list[tuple]:
    """At most ``ranges - 1`` sorted split points of the order key; [] for small inputs.

    Reads only the key columns. The sample holds about SAMPLES_PER_RANGE keys per range, so
    what reaches the driver is bounded by the number of ranges, not by the data.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, _ = _plain_keys(df, order_by)
    keyed = df.select(*keys)
    rows = keyed.count()
    if rows <= SMALL_ROWS or ranges < 2:
        return []
    every = max(1, rows // (ranges * SAMPLES_PER_RANGE))
    sample = (
        keyed.filter(F.pmod(F.xxhash64(*keyed.columns), F.lit(every)) == 0).distinct().collect()
    )
    none_first = lambda row: tuple((v is not None, v) for v in row)
    points = sorted((tuple(r) for r in sample), key=none_first)
    step = len(points) / ranges
    picked = [points[int(i * step)] for i in range(1, ranges)] if points else []
    return list(dict.fromkeys(picked))


def range_number(df: DataFrame, order_by, points: list[tuple]) -> Column:
    """Number of split points at or below the row's key (binary search, JVM side)."""
    if not points:
        return F.lit(0)
    keys, schema = _plain_keys(df, order_by)
    text = json.dumps([{f"k{i}": v for i, v in enumerate(p)} for p in points])
    table = F.from_json(F.lit(text), T.ArrayType(schema))
    n = len(points)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])

    def advance(found, step, key):
        probe = found + step
        below = (probe <= n) & (F.get(table, probe - 1) <= key)
        return F.when(below, probe).otherwise(found)

    return let(F.struct(*keys), lambda key: F.aggregate(steps, F.lit(0), lambda found, step: advance(found, step, key)))


def with_range(
    df: DataFrame, order_by, ranges: int | None = None, partition_by: Sequence[str] = ()
) -> tuple[DataFrame, bool]:
    """``df`` plus its order range, and whether there is more than one range.

    Ranges run over (hash of the group, order): most groups lie in one range, and only those at a
    split point (column ``EDGE``) have rows in several, so what ranges hand on is as small as
    their number.

    The rows are read once more for the per-range table. Counts over exploded arrays are written
    out first: they are costly to repeat, and Spark 4.1 does not resolve a self-join of such a
    plan on an expression with a lambda.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if "Generate " in plan and "Aggregate " in plan:
        df = staged(df, "ordered")
    keys = [F.xxhash64(*partition_by), *as_columns(order_by)] if partition_by else as_columns(order_by)
    points = split_points(df, keys, ranges)
    out = df.withColumn(RANGE, range_number(df, keys, points))
    if not partition_by:
        return out.withColumn(EDGE, F.lit(True)), bool(points)
    table = F.array(*[F.lit(p[0]) for p in points]) if points else F.array(F.lit(0))
    near = [F.get(table, F.col(RANGE) - 1), F.get(table, F.col(RANGE))]  # the points on both sides of a row
    edge = F.coalesce(near[0] == keys[0], F.lit(False)) | F.coalesce(near[1] == keys[0], F.lit(False))
    return out.withColumn(EDGE, edge), bool(points)


def _handed_on(rows: DataFrame, table: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` with what their range was handed by others of its group; nulls where there is nothing."""
    marked = F.broadcast(table.withColumnsRenamed({g: f"_of_{g}" for g in group}).withColumnRenamed(RANGE, "_of"))
    same = F.col(RANGE) == F.col("_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return rows.join(marked, same, "left")


def with_position(
    df: DataFrame, order_by, partition_by: Sequence[str] = (), name: str = "pos", start: int = 0,
    cut: Column | None = None, like: DataFrame | None = None,
) -> DataFrame:
    """0-based position of each row in order, globally or within ``partition_by``.

    ``cut`` is the range of a row where that follows from the order keys by arithmetic; it ascends with
    them, so no split points are searched. The ranges are then counted on ``like``, a table with the same
    keys that is cheaper to make than ``df``, which is made only once.
    """
    group, order = list(partition_by), as_columns(order_by)
    numbered_by = lambda rows: rows.withColumn(RANGE, cut).withColumn(EDGE, F.lit(True))
    ranged, many = with_range(df, order_by, partition_by=group) if cut is None else (numbered_by(df), True)
    local = Window.partitionBy(*group, RANGE).orderBy(*order)
    numbered = ranged.withColumn(name, (F.row_number().over(local) - 1 + start).cast("bigint"))
    if not many:
        return numbered.drop(RANGE, EDGE)
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(RANGE)
    counted = ranged if cut is None or like is None else numbered_by(like)
    offsets = (
        counted.filter(EDGE)
        .groupBy(*group, RANGE)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(before) - F.col("_rows"))
        .drop("_rows")
    )
    return (
        _handed_on(numbered, offsets, group)
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def _carried(name: str) -> str:
    """Column for what the ranges before bring along; it must not meet a column of the rows."""
    return f"_carried_{name}"


def with_running(
    df: DataFrame,
    order_by,
    columns: dict[str, tuple[str, Column]],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Running aggregates up to and including each row.

    ``columns`` maps an output name to (``sum`` | ``max`` | ``min``, expression).
    """
    group, order = list(partition_by), as_columns(order_by)
    ranged, many = with_range(df, order_by, partition_by=group)
    local = (
        Window.partitionBy(*group, RANGE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = ranged.withColumns({name: _COMBINE[kind][0](expr).over(local) for name, (kind, expr) in columns.items()})
    if not many:
        return out.drop(RANGE, EDGE)
    earlier = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy(RANGE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = ranged.filter(EDGE).groupBy(*group, RANGE).agg(
        *[_COMBINE[kind][0](expr).alias(_carried(name)) for name, (kind, expr) in columns.items()]
    )
    carried = totals.select(
        *group,
        RANGE,
        *[
            _COMBINE[kind][0](F.col(_carried(name))).over(earlier).alias(_carried(name))
            for name, (kind, _) in columns.items()
        ],
    )
    out = _handed_on(out, carried, group)
    out = out.withColumns({name: _COMBINE[kind][1](F.col(_carried(name)), F.col(name)) for name, (kind, _) in columns.items()})
    return out.select(*df.columns, *columns)


def with_neighbour(
    df: DataFrame,
    order_by,
    columns: dict[str, str],
    partition_by: Sequence[str] = (),
    back: bool = False,
) -> DataFrame:
    """Values of the next row (or the previous one with ``back``) in order; null at the end.

    ``columns`` maps an output name to a source column.
    """
    group, order = list(partition_by), as_columns(order_by)
    ranged, many = with_range(df, order_by, partition_by=group)
    shift = F.lag if back else F.lead
    near = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    local = Window.partitionBy(*group, RANGE).orderBy(*order)
    out = ranged.withColumn("_near", near).withColumn("_near", shift("_near").over(local))
    if many:
        edge = F.max_by if back else F.min_by
        keys, _ = _plain_keys(df, order_by)
        edges = ranged.filter(EDGE).groupBy(*group, RANGE).agg(edge(near, F.struct(*keys)).alias("_edge"))
        across = Window.partitionBy(*(group or [F.lit(0)])).orderBy(RANGE)
        edges = edges.withColumn("_edge", shift("_edge").over(across))
        out = _handed_on(out, edges, group).withColumn(
            "_near", F.coalesce("_near", "_edge")
        )
    return out.select(*df.columns, *[F.col(f"_near.{name}").alias(name) for name in columns])


def top_rows(
    df: DataFrame, k: int, order_by, partition_by: Sequence[str], name: str = "rank"
) -> DataFrame:
    """The first k rows per group. The ``rank <= k`` filter lets Spark keep only k rows per
    group in every map task before the shuffle, so a hot group shrinks ahead of its task."""
    w = Window.partitionBy(*partition_by).orderBy(*as_columns(order_by))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def sorted_rows(df: DataFrame, order_by) -> DataFrame:
    """Total order as a distributed range sort."""
    return df.orderBy(*as_columns(order_by))
