"""A source that generates rows from their keys, in partitions, as a table or as a stream.

``spark.read.format("keyed_rows")`` with the options ``first``, ``last`` (keys, ``last`` excluded),
``per_key``, ``seed`` and ``partitions`` gives ``per_key`` rows ``key, nth, value`` for each key. A value is an
arithmetic hash of key and number, so a partition that is read again after a lost task has the same
rows, and any engine can work them out. As a stream the offset is the next key; a batch holds at most
``batch_keys`` of them, in partitions as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from feedloom.functions.hashing import MODULUS

#: Rows of an Arrow batch.
ROWS = 1 << 16


def values_of(keys: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    """The same number as :func:`feedloom.functions.hashing.mix` gives."""
    a, b = keys % MODULUS, nth % MODULUS
    linear = (a * 48271 + b * 69621 + (seed % MODULUS) * 16807 + 12345) % MODULUS
    return (((linear * linear) % MODULUS) * 48271 + linear + 11) % MODULUS


class KeyRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def split(first: int, last: int, parts: int) -> list[KeyRange]:
    """The keys in at most ``parts`` ranges that are equal up to one key."""
    count = max(0, last - first)
    edges = [first + count * k // parts for k in range(parts + 1)]
    return [KeyRange(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


class _Rows:
    def __init__(self, options):
        self.first, self.last = int(options.get("first", 0)), int(options["last"])
        self.per_key, self.seed = int(options.get("per_key", 1)), int(options.get("seed", 0))
        self.parts, self.step = int(options.get("partitions", 8)), int(options.get("batch_keys", 1 << 20))
        if self.per_key < 1 or self.parts < 1 or self.step < 1:
            raise ValueError("per_key, partitions and batch_keys must be at least 1")

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        start, stop = partition.first * self.per_key, partition.last * self.per_key
        for at in range(start, stop, ROWS):
            row = np.arange(at, min(at + ROWS, stop), dtype=np.int64)
            key, nth = row // self.per_key, row % self.per_key
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nth), pa.array(values_of(key, nth, self.seed))], ["key", "nth", "value"])


class _Reader(_Rows, DataSourceReader):
    def partitions(self):
        return split(self.first, self.last, self.parts) or [KeyRange(0, 0)]


class _Stream(_Rows, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.sent = self.first

    def initialOffset(self) -> dict:
        return {"key": self.first}

    def latestOffset(self) -> dict:
        self.sent = min(self.last, self.sent + self.step)
        return {"key": self.sent}

    def partitions(self, start: dict, end: dict):
        self.sent = max(self.sent, end["key"])
        return split(start["key"], end["key"], self.parts)

    def commit(self, end: dict) -> None:
        """Nothing is kept: rows can always be made again."""


class KeyedRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_rows"

    def schema(self) -> str:
        return "key bigint, nth bigint, value bigint"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeyedRows)
