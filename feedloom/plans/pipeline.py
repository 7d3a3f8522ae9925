"""A named chain of DataFrame steps with marks, hooks and reusable results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Step = Callable[[DataFrame], DataFrame]

#: Order in which a reader's hooks are applied.
HOOKS = ("decode", "combine", "sample", "parse", "batch", "post")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def file_listing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """``path size time`` of every input file, sorted: changes when the input changes."""
    out = []
    for path in paths:
        p, fs = _path(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            status = files.next()
            out.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return sorted(out)


class Store:
    """Finished results under a shared folder, one sub-folder per fingerprint."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def has(self, key: str) -> bool:
        p, fs = _path(self.spark, f"{self.folder}/{key}/data/_SUCCESS")
        return fs.exists(p)

    def put(self, key: str, df: DataFrame, compression: str = "snappy", files: int | None = None) -> DataFrame:
        """Write rows with their schema beside them and return them as read back.

        A result that is already there is kept: the same fingerprint means the same rows.
        """
        if not self.has(key):
            rows = df.repartition(files) if files else df
            schema = self.spark.createDataFrame([(df.schema.json(),)], "value string")
            schema.coalesce(1).write.mode("overwrite").text(f"{self.folder}/{key}/schema")
            rows.write.mode("overwrite").option("compression", compression).parquet(f"{self.folder}/{key}/data")
        return self.get(key)

    def get(self, key: str) -> DataFrame:
        if not self.has(key):
            raise KeyError(key)
        text = self.spark.read.text(f"{self.folder}/{key}/schema").first()[0]
        schema = T.StructType.fromJson(json.loads(text))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{key}/data")


@dataclass
class Pipeline:
    """Input paths, a reader and named steps.

    ``describe`` text of a step should hold everything that changes its result (parameters,
    version); the fingerprint is a SHA-256 over these texts and the input file listing.
    """

    paths: Sequence[str]
    read: Callable[[SparkSession, Sequence[str]], DataFrame]
    steps: list[tuple[str, str, Step]] = field(default_factory=list)
    marks: dict[str, int] = field(default_factory=dict)

    def then(self, name: str, step: Step, describe: str = "") -> "Pipeline":
        """A new pipeline with one more step."""
        return Pipeline(self.paths, self.read, [*self.steps, (name, describe, step)], dict(self.marks))

    def mark(self, name: str) -> "Pipeline":
        """Name the result so far as a place where it may be kept. No effect on the data."""
        return Pipeline(self.paths, self.read, list(self.steps), {**self.marks, name: len(self.steps)})

    def fingerprint(self, spark: SparkSession, upto: int | None = None) -> str:
        steps = [[n, d] for n, d, _ in self.steps[:upto]]
        text = json.dumps({"inputs": file_listing(spark, self.paths), "steps": steps})
        return hashlib.sha256(text.encode()).hexdigest()

    def frame(self, spark: SparkSession, store: Store | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """The result, built on the last kept mark if the store has one.

        Marks named in ``keep`` are written to the store on the way.
        """
        start, df = 0, None
        if store:
            for name, at in sorted(self.marks.items(), key=lambda m: -m[1]):
                key = self.fingerprint(spark, at)
                if store.has(key):
                    start, df = at, store.get(key)
                    break
        if df is None:
            df = self.read(spark, self.paths)
        wanted = {at for name, at in self.marks.items() if name in keep}
        for i in range(start, len(self.steps) + 1):
            if store and i in wanted and not (i == start and start > 0):
                df = store.put(self.fingerprint(spark, i), df)
            if i < len(self.steps):
                df = df.transform(self.steps[i][2])
        return df


def reader(paths: Sequence[str], read, describe: str = "", **hooks: Step) -> Pipeline:
    """A pipeline whose hooks run in the fixed reader order."""
    unknown = set(hooks) - set(HOOKS)
    if unknown:
        raise ValueError(f"unknown hooks {sorted(unknown)}")
    out = Pipeline(paths, read)
    for name in HOOKS:
        if name in hooks:
            out = out.then(name, hooks[name], describe)
    return out


class Registry:
    """Pipelines by the class of their configuration."""

    def __init__(self):
        self._makers: dict[type, Callable] = {}

    def register(self, config: type):
        def keep(maker):
            if config in self._makers:
                raise ValueError(f"{config.__name__} is registered twice")
            self._makers[config] = maker
            return maker

        return keep

    def make(self, config) -> Pipeline:
        return self._makers[type(config)](config)


def reuse_or_build(spark: SparkSession, path: str, columns: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The finished table at ``path`` if it has every expected column, else build it anew."""
    p, fs = _path(spark, f"{path}/_SUCCESS")
    if fs.exists(p):
        old = spark.read.parquet(path)
        if set(columns) <= set(old.columns):
            return old
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
