"""Quality scores: random Fourier features of document statistics, ridge weights, isotonic calibration.

The statistics of a text are computed in one pass over its bytes. Random Fourier features of them
approximate a Gaussian kernel; the normal equations of ridge regression are sums over rows, so each
task adds its rows up, Spark adds the tasks up, and the driver solves one small system. Scores are
calibrated on labelled rows that the weights have not seen, by isotonic regression over score bins.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import crc_fold, runs, staged, text_udf

#: Features, kernel width (of standardised statistics), ridge weight and bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 6.0, 1e-3, 2000, 7
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other symbols
for _at, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:'\"-()!?",
                              bytes(range(128, 256)), b"!", b"#$%&*+=<>@^_|~\\/{}[]`", b"\t\x0b\x0c"), 1):
    _CLASS[list(_bytes)] = _at
_CLASSES = 11
STATISTICS = 28


def statistics(text: bytes) -> list[float]:
    """What the text looks like: shares of byte classes, word and line shapes, repetition, entropy.

    The empty text has all zeros.
    """
    n = len(text)
    if not n:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=_CLASSES) / n
    p = counts[counts > 0] / n
    words = text.split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split(b"\n")
    upper = sum(map(bytes.isupper, words))
    alpha = sum(map(bytes.isalnum, words))
    return [
        np.log1p(n), *shares, -float((p * np.log2(p)).sum()), float(p.max()),
        np.log1p(len(words)), float(sizes.mean()), float(sizes.std()), np.log1p(float(sizes.max())),
        distinct / m, np.log1p(m) - np.log1p(distinct), repeats / m, pairs / m, upper / m, alpha / m,
        np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines) / 1000.0, float((sizes <= 2).mean()),
    ]


def statistics_column(text: Column) -> Column:
    def make():
        return lambda column: pa.array([statistics(t) for _, data in runs(column) for t in data], type=pa.list_(pa.float64()))

    return text_udf(make, "array<double>")(text)


@dataclass(frozen=True)
class QualityModel:
    """Bounded by its parameters, whatever the corpus: a few arrays of ``FEATURES`` numbers."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        wave = np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([wave, z, np.ones(len(z))])

    def decide(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher where label 1 is likelier; never falls as the raw score rises."""
        return np.interp(self.decide(stats), self.raw, self.level)

    def score_column(self, text: Column) -> Column:
        """The score of a text; null and empty texts are scored too."""

        def make():
            def work(column):
                rows = [statistics(t) for _, data in runs(column) for t in data]
                return pa.array(self.score(np.array(rows).reshape(-1, STATISTICS)))

            return work

        return text_udf(make, "double")(text)


def _isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-falling sequence: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        folds: int = 5, held_out: int = 0, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> QualityModel:
    """Learn from all labelled documents whose ``crc32(id) mod folds`` is not ``held_out``.

    Fold ``folds - 1`` calibrates, the rest give the weights. Several labels of a document are
    averaged; null ids, null labels and labels without a document teach nothing; without any
    labelled document every score is 0.5. Texts are reduced to statistics before they meet labels.
    """
    fold = crc_fold(id_col, folds)
    rows = docs.select(F.col(id_col).alias("id"), fold.alias("fold"), F.col(text_col).alias("t")).filter(F.col("fold") != held_out)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).groupBy("id").agg(F.avg("y").alias("y"))
    seen = staged(rows.select("id", "fold", statistics_column(F.col("t")).alias("x")).join(known.na.drop(), "id").select("fold", "x", "y"), "quality-rows")
    teach = seen.filter(F.col("fold") != folds - 1)
    moments = teach.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(STATISTICS, features)) / width
    phases = rng.uniform(0, 2 * np.pi, size=features)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(STATISTICS)])
    scale = np.array([max(moments[f"s{i}"] or 1.0, 1e-9) for i in range(STATISTICS)])
    blank = QualityModel(mean, scale, directions, phases, np.zeros(features + STATISTICS + 1), np.zeros(1), np.array([0.5]))
    size = features + STATISTICS + 1
    upper = np.triu_indices(size)

    def add_up(batches):
        gram, target = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            f, y = blank.features(_stack(batch)), batch.column("y").to_numpy()
            gram += f.T @ f
            target += f.T @ y
        for i in range(size):  # a row of the sums at a time
            if target.any() or gram.any():
                yield pa.RecordBatch.from_pylist([{"i": i, "j": -1, "v": target[i]}, *({"i": i, "j": j, "v": gram[i, j]} for j in range(i, size))])

    sums = teach.mapInArrow(add_up, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (sums.column(c).to_numpy() for c in ("i", "j", "v"))
    gram, target = np.zeros((size, size)), np.zeros(size)
    target[i[j < 0]] = v[j < 0]
    gram[i[j >= 0], j[j >= 0]] = v[j >= 0]
    gram[upper[1], upper[0]] = gram[upper]
    rows_seen = max(gram[-1, -1], 1.0)
    weights = np.linalg.lstsq(gram / rows_seen + ridge * np.eye(size), target / rows_seen, rcond=None)[0]
    ready = QualityModel(mean, scale, directions, phases, weights, np.zeros(1), np.array([0.5]))

    def bins(batches):
        total = np.zeros((BINS + 1, 2))
        for batch in batches:
            at = np.clip((ready.decide(_stack(batch)) + 0.5) * BINS / 2, 0, BINS).astype(int)
            np.add.at(total, at, np.column_stack([batch.column("y").to_numpy(), np.ones(len(at))]))
        at = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], ["bin", "y", "n"])

    found = seen.filter(F.col("fold") == folds - 1).mapInArrow(bins, "bin long, y double, n double")
    table = found.groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("bin").toPandas()
    if not len(table):
        return ready if rows_seen <= 1 else QualityModel(mean, scale, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    raw = (table["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5
    level = _isotonic((table["y"] / table["n"]).to_numpy(), table["n"].to_numpy())
    return QualityModel(mean, scale, directions, phases, weights, raw, np.clip(level, 0.0, 1.0))
