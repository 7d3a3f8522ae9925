"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import uuid
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from feedloom.session import staged

SPACE_CLASS = r"[\x20\x09-\x0D]+"


def crc_fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % folds


def fresh(name: str, taken: list[str]) -> str:
    """A column name that does not clash with ``taken`` (names compare without case)."""
    low = {t.lower() for t in taken}
    out = name
    while out.lower() in low:
        out = f"{name}_{uuid.uuid4().hex[:8]}"
    return out


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_udf(make: Callable[[], Callable[..., pa.Array]], ddl: str) -> Callable[..., Column]:
    """An Arrow function of columns. ``make`` runs once a task and gives a function of Arrow arrays.

    It is marked as not deterministic only so that the planner calls it once for each row, however
    often its result is used; equal rows give equal results.
    """

    def run(batches):
        work = make()
        for batch in batches:
            yield work(*batch) if isinstance(batch, tuple) else work(batch)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # a kind instead of type hints, as the number of columns is open
        return F.arrow_udf(run, ddl, ArrowUDFType.SCALAR_ITER).asNondeterministic()


def runs(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column a part at a time: where the part starts and its UTF-8 bytes (null is empty).

    A part holds about ``most`` bytes, or one longer text, so a task's memory follows the part and
    not the batch.
    """
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = whole.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_pylist()
    start = held = 0
    for i, n in enumerate([*sizes, most + 1]):
        if i > start and held + n > most:
            yield start, [b"" if x is None else x for x in raw.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n


def keep_rows(docs: DataFrame, keep: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose key is in ``keep``, one row for each key.

    ``keys`` maps the key columns of ``keep`` to expressions over ``docs``; null equals null. Of rows
    repeated under one key the one whose JSON text comes first stays. They become one ahead of the
    shuffle, so no key is hot, and the join uses the same partitioning, so texts move once.
    """
    names, left, right = [], docs, keep.select(*keys)
    for k, value in keys.items():  # without nulls, so that the join and the aggregate deal rows out by the same columns
        for name, part in ((fresh(f"__{k}_none", docs.columns), lambda c: c.isNull()), (fresh(f"__{k}", docs.columns), lambda c: F.coalesce(c.cast("string"), F.lit("")))):
            left, right = left.withColumn(name, part(value)), right.withColumn(name, part(F.col(k)))
            names.append(name)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row, own = F.struct(*columns), fresh("__row", docs.columns)
    single = left.groupBy(*names).agg(F.min_by(row, F.to_json(row)).alias(own))
    return single.join(right.select(*names), names, "left_semi").select(*[F.col(own)[c].alias(c) for c in docs.columns])


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """``value`` on every executor, given by calling the result there.

    It is sent with the code of its classes, so executors need no installation.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


__all__ = ["SPACE_CLASS", "crc_fold", "fresh", "keep_rows", "runs", "shared", "staged", "text_udf", "texts"]
