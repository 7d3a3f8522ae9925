"""Groups by a key function, reduced as a whole or in windows of a counted size.

A group reduction has three parts, each given by the caller: the *key* of a row, the *size* of a
window (for all keys, for each key, or none: the whole group), and what *reduces* the rows of a
window. Built-in reducers are aggregate columns, which Spark combines ahead of the shuffle. An Arrow
reducer is a pair of functions over tables: ``partial`` turns some rows of a window into few, and
``merge`` turns such few rows into the same kind again; both run ahead of the shuffle and after it.
No task holds a whole group: a key with a third of all rows is reduced where its rows are, then in
``spread`` parts, then once over those, each time as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.ordered import with_position

Reduce = Callable[..., pa.Table]


@dataclass(frozen=True)
class ArrowReducer:
    """``partial`` and ``merge`` give tables of ``schema`` (a DDL string); ``merge`` takes several of them together.

    They see the rows of one group. With ``many`` they see those of many groups at once, with the key
    columns, and the names of these as a second argument, and give rows that start with the key columns.
    """

    partial: Reduce
    merge: Reduce
    schema: str
    many: bool = False


def windowed(df: DataFrame, key: dict[str, Column], size: int | Column | None, order_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its key columns and, for a size, ``window_id``; and the names that tell windows apart.

    Rows of a key are counted in the given order. A null key is a key of its own.
    """
    out = df.withColumns(key)
    if size is None:
        return out, [*key]
    numbered = with_position(out, list(order_by), list(key), "_nth")
    size = F.lit(size) if isinstance(size, int) else size
    return numbered.withColumn("window_id", F.floor(F.col("_nth") / size)).drop("_nth"), [*key, "window_id"]


def reduce_groups(df: DataFrame, key: dict[str, Column], reducers: dict[str, Column], size: int | Column | None = None,
                  order_by: Sequence[str] = ()) -> DataFrame:
    """One row for each window of each key: its key, ``window_id`` (with a size) and the reducers' columns."""
    rows, names = windowed(df, key, size, order_by)
    return rows.groupBy(*names).agg(*[c.alias(n) for n, c in reducers.items()])


def _by_group(table: pa.Table, names: list[str]) -> list[tuple[dict, pa.Table]]:
    """The rows of a table by their key values, in the order of their first rows."""
    groups: dict[tuple, list[int]] = {}
    for at, values in enumerate(zip(*[table.column(n).to_pylist() for n in names], strict=True)):
        groups.setdefault(values, []).append(at)
    return [(dict(zip(names, values, strict=True)), table.take(places).drop_columns(names)) for values, places in groups.items()]


def _reduced(table: pa.Table, names: list[str], reduce: Reduce, schema: pa.Schema, many: bool) -> pa.Table:
    if many:
        return reduce(table, names).select(schema.names).cast(schema) if table.num_rows else schema.empty_table()
    out = []
    for values, rows in _by_group(table, names):
        got = reduce(rows)
        keys = [pa.array([values[n]] * got.num_rows, schema.field(n).type) for n in names]
        out.append(pa.table([*keys, *got.columns], names=[*names, *got.column_names]).select(schema.names).cast(schema))
    return pa.concat_tables([schema.empty_table(), *out])


def _last_group(table: pa.Table, names: list[str]) -> int:
    """Where the rows that share the last row's key begin, in rows sorted by key."""
    end = table.num_rows - 1
    same = np.ones(table.num_rows, dtype=bool)
    for n in names:
        column = table.column(n)
        equal = pc.equal(column, column[end]).fill_null(False) if column[end].is_valid else column.is_null()
        same &= equal.to_numpy()
    return int(np.flatnonzero(~same).max(initial=-1)) + 1


def reduce_groups_arrow(df: DataFrame, key: dict[str, Column], reducer: ArrowReducer, size: int | Column | None = None,
                        order_by: Sequence[str] = (), spread: int = 32) -> DataFrame:
    """Like :func:`reduce_groups` with an Arrow reducer, which sees the other columns of ``df``.

    Partial results are made for each batch of rows ahead of the shuffle and merged as they come, sorted
    by window: a task holds a batch and what the last window has come to. A whole group is merged in
    ``spread`` parts by where they were made before that. The reducer must not depend on the order of
    rows; ``order_by`` only says which rows share a window.
    """
    rows, names = windowed(df, key, size, order_by)
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*names).schema}
    ddl = ", ".join([*[f"`{n}` {t}" for n, t in kinds.items()], reducer.schema])
    empty = df.sparkSession.createDataFrame([], ddl).toArrow().schema
    partial, merge, many = reducer.partial, reducer.merge, reducer.many

    def ahead(batches):
        for batch in batches:
            yield from _reduced(pa.Table.from_batches([batch]), names, partial, empty, many).to_batches()

    def merged(batches):
        held = empty.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([held, pa.Table.from_batches([batch]).select(empty.names).cast(empty)])
            begin = _last_group(table, names)
            yield from _reduced(table.slice(0, begin), names, merge, empty, many).to_batches()
            held = _reduced(table.slice(begin), names, merge, empty, many)
        yield from held.to_batches()

    def met(made: DataFrame, *part: str) -> DataFrame:
        return made.repartition(*names, *part).sortWithinPartitions(*part, *names).select(*empty.names).mapInArrow(merged, ddl)

    made = rows.mapInArrow(ahead, ddl)
    if size is None:
        made = met(made.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(spread))), "_part")
    return met(made)
