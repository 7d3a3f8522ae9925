"""A set of numbered shards under a common name, written by a data source with its own commit.

A set of N shards is N folders ``prefix-00001-of-000NN`` to ``prefix-000NN-of-000NN`` of Parquet parts,
all of them there (a shard without rows holds one part without rows), and a list of the parts with
their row counts, ``prefix-of-000NN.json``. Tasks write parts to a folder of the job; when all have ended
the parts are moved to their shards and the list comes last, so a set either is whole or has no list.
A task that is still running when its job fails may leave a folder that begins with ``_``; no reader looks into it.
A shard may be written by any number of tasks: its parts, in the order of their names, are its rows in order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from feedloom.functions.hashing import mix
from feedloom.operators.ordered import with_position

#: The column that says which shard a row goes to, counted from 0. It is not written.
SHARD = "shard"


def shard_name(prefix: str, index: int, shards: int) -> str:
    """``prefix-00001-of-00016``; the index counts from 0, the name from 1."""
    return f"{prefix}-{index + 1:05d}-of-{shards:05d}"


def set_name(prefix: str, shards: int) -> str:
    return f"{prefix}-of-{shards:05d}.json"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    elif path.startswith("s3a:"):
        path = "s3:" + path.removeprefix("s3a:")
    fs, found = pafs.FileSystem.from_uri(path)
    return fs, found.rstrip("/")


@dataclass
class Parts(WriterCommitMessage):
    """(shard, file, rows) of what a task has written."""

    parts: list[tuple[int, str, int]]


class _SetWriter(DataSourceArrowWriter):
    def __init__(self, options, schema):
        self.path, self.prefix = options["path"], options["prefix"]
        self.shards, self.job = int(options["shards"]), uuid.uuid4().hex
        if self.shards < 1:
            raise ValueError("shards must be at least 1")
        self.names = [n for n in schema.names if n != SHARD]
        if len(self.names) == len(schema.names):
            raise ValueError(f"rows need a column {SHARD}")
        self.arrow = to_arrow_schema(type(schema)([f for f in schema.fields if f.name != SHARD]))

    def _work(self, root: str) -> str:
        return f"{root}/_{self.prefix}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        """One part for each run of rows of one shard, so one file is open at a time."""
        fs, root = file_system(self.path)
        task = TaskContext.get()
        # A task that is tried again, or twice at once, has files of its own; only committed ones are moved.
        folder = f"{self._work(root)}/{task.partitionId():06d}-{task.taskAttemptId()}"
        parts, now, out = [], None, None

        def close():
            if out is not None:
                out.close()

        try:
            for batch in iterator:
                column = batch.column(SHARD).cast(pa.int64())
                if column.null_count or (batch.num_rows and not 0 <= pc.min(column).as_py() <= pc.max(column).as_py() < self.shards):
                    raise ValueError(f"{SHARD} must be from 0 to {self.shards - 1}")
                rows = pa.Table.from_batches([batch.select(self.names)]).cast(self.arrow)
                runs = pc.run_end_encode(column, run_end_type=pa.int64())
                start = 0
                for shard, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if shard != now:
                        close()
                        if out is None:
                            fs.create_dir(folder, recursive=True)
                        name = f"{folder}/part-{task.partitionId():06d}-{len(parts):05d}.parquet"
                        out, now = pq.ParquetWriter(name, self.arrow, filesystem=fs), shard
                        parts.append((shard, name, 0))
                    out.write_table(rows.slice(start, end - start))
                    parts[-1] = (shard, name, parts[-1][2] + end - start)
                    start = end
        finally:
            close()
        return Parts(parts)

    def commit(self, messages: list[Parts | None]) -> None:
        """Shards of a job that ended half-way are taken away, parts are moved, the list is written last."""
        fs, root = file_system(self.path)
        parts: list[list[tuple[str, int]]] = [[] for _ in range(self.shards)]
        for message in messages:
            for shard, name, rows in message.parts if message else []:
                parts[shard].append((name, rows))
        listed = {}
        for shard, files in enumerate(parts):
            name = shard_name(self.prefix, shard, self.shards)
            if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                fs.delete_dir(f"{root}/{name}")
            fs.create_dir(f"{root}/{name}", recursive=True)
            if not files:
                pq.write_table(self.arrow.empty_table(), f"{root}/{name}/part-000000-00000.parquet", filesystem=fs)
                files = [("part-000000-00000.parquet", 0)]
            else:
                for file, _ in files:
                    fs.move(file, f"{root}/{name}/{file.rpartition('/')[2]}")
            listed[name] = {file.rpartition("/")[2]: rows for file, rows in sorted(files)}
        listing = f"{self._work(root)}.json"
        with fs.open_output_stream(listing) as out:
            out.write(json.dumps(listed).encode())
        fs.move(listing, f"{root}/{set_name(self.prefix, self.shards)}")
        self._clear(fs, root)

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(self._work(root)).type != pafs.FileType.NotFound:
            fs.delete_dir(self._work(root))


class ShardSet(DataSource):
    """``df.write.format("shard_set")`` with the options ``path``, ``prefix`` and ``shards``."""

    @classmethod
    def name(cls) -> str:
        return "shard_set"

    def writer(self, schema, overwrite):
        return _SetWriter(self.options, schema)


def parts_of(path: str, prefix: str, shards: int) -> dict[str, dict[str, int]] | None:
    """Rows of every part by shard name, or None where the set is not there or lacks a part."""
    fs, root = file_system(path)
    listing = f"{root}/{set_name(prefix, shards)}"
    if fs.get_file_info(listing).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(listing) as file:
        listed = json.loads(file.read())
    for name, files in listed.items():
        there = {i.base_name for i in fs.get_file_info(pafs.FileSelector(f"{root}/{name}", allow_not_found=True))}
        if not set(files) <= there:
            return None
    return listed


def write_set(df: DataFrame, path: str, prefix: str, shards: int, order_by, shuffle_key: str | None = None, seed: int = 0, tasks: int | None = None) -> bool:
    """Row i in order goes to shard i mod ``shards``; False where the whole set is there and is kept.

    Rows are dealt out by ranges of (shard, place), so a shard is written by as many tasks as its size
    asks for. With ``shuffle_key`` the rows of a shard are in a pseudo-random order instead. Null
    values are written as they are; an empty table gives a set of empty shards; a column named
    ``shard`` or ``_place`` is refused.
    """
    taken = {SHARD, "_place"} & set(df.columns)
    if taken:
        raise ValueError(f"rows may not have the columns {sorted(taken)}")
    if parts_of(path, prefix, shards) is not None:
        return False
    spark = df.sparkSession
    spark.dataSource.register(ShardSet)
    rows = with_position(df, order_by, name="_place").withColumn(SHARD, (F.col("_place") % shards).cast("int"))
    if shuffle_key:
        rows = rows.withColumn("_place", mix(shuffle_key, 0, seed) * F.lit(1 << 31) + F.col("_place") % (1 << 31))
    count = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(count, SHARD, "_place").sortWithinPartitions(SHARD, "_place").drop("_place")
    rows.write.format("shard_set").options(path=path, prefix=prefix, shards=shards).mode("append").save()
    return True


def read_set(spark: SparkSession, path: str, prefix: str, shards: int, name: str | None = None) -> DataFrame:
    """The rows of a whole set, with the shard's name in the column ``name`` if one is given."""
    if parts_of(path, prefix, shards) is None:
        raise FileNotFoundError(f"{path}: no whole set {set_name(prefix, shards)}")
    rows = spark.read.parquet(f"{path.rstrip('/')}/{prefix}-*-of-{shards:05d}")
    return rows.withColumn(name, F.element_at(F.split("_metadata.file_path", "/"), -2)) if name else rows
