"""Column functions on arrays: padding, encoding, scaling and sequence sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that refers to an outer expression evaluates it again for every element; bound
    through a one-element array it is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def totals_before(sizes: Column) -> Column:
    """What lies before each item, and the total at the end: [2, 5] gives [0, 2, 7]."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def offsets_before(sizes: pd.Series) -> pd.Series:
    """What lies before each item: [2, 5] gives [0, 2]. One pass, for arrays of any length."""
    return sizes.map(lambda x: None if x is None else np.concatenate(([0], np.cumsum(x)))[: len(x)])


def visited(count: Column, kind: str, visit) -> Column:
    """The rows of the places reached from place 0 by following ``next``, in order.

    ``visit(place)`` is a struct of type ``kind`` for a place below ``count``, with an int field
    ``next`` that is larger than the place; it is only worked out for places that are reached.
    """
    none = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("rows"))

    def step(state, place):
        def move(row):
            return F.struct(row["next"].alias("at"), F.concat(state["rows"], F.array(row)).alias("rows"))

        return F.when(state["at"] == place, let(visit(place).cast(kind), move)).otherwise(state)

    places = F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), F.lit(1), count)
    return F.aggregate(places, none, step, lambda state: state["rows"])


def pad_or_clip(a, size, value=0) -> Column:
    """Array of exactly ``size`` items: cut at the end or filled with ``value``."""
    a = _c(a)
    size = size if isinstance(size, Column) else F.lit(size)
    fill = value if isinstance(value, Column) else F.lit(value)
    missing = F.greatest(size - F.size(a), F.lit(0))
    return F.concat(F.slice(a, F.lit(1), size), F.array_repeat(fill, missing))


def one_hot(labels, size: int) -> Column:
    """Dense 0/1 vector of an array of label indices (or one index)."""
    index = F.sequence(F.lit(0), F.lit(size - 1))
    return let(_c(labels), lambda l: F.transform(index, lambda i: F.array_contains(l, i).cast("int")))


def multi_hot(text, vocabulary: Sequence[str], separator: str = "|", rename=None) -> Column:
    """0/1 vector of a separated word list over a fixed ordered vocabulary.

    ``rename`` optionally maps a (from, to) spelling first; it is off by default.
    """
    text = _c(text)
    if rename:
        text = F.replace(text, F.lit(rename[0]), F.lit(rename[1]))
    words = F.split(text, "[" + separator + "]")
    return F.array(*[F.array_contains(words, w).cast("int") for w in vocabulary])


def dequantise(a, low: float, high: float) -> Column:
    """8-bit codes back to floats in [low, high], at the middle of each step."""
    span = float(high - low)
    return F.transform(_c(a), lambda q: q * (span / 255.0) + (span / 512.0 + low))


def normalise(a, offsets: Sequence[float], scales: Sequence[float]) -> Column:
    """(x - offset) / scale with per-channel constants repeating along the array."""
    n = len(offsets)
    off, sc = F.array(*map(F.lit, offsets)), F.array(*map(F.lit, scales))
    return F.transform(_c(a), lambda x, i: (x - F.get(off, i % n)) / F.get(sc, i % n))


def concat_features(*matrices) -> Column:
    """Join several (frame x feature) matrices of equal frame count along the features."""
    out = _c(matrices[0])
    for m in matrices[1:]:
        out = F.zip_with(out, _c(m), lambda x, y: F.concat(x, y))
    return out


def sample_sequence(a, steps: int, stride: int = 1, offset=None) -> Column:
    """``steps`` items every ``stride`` from ``offset`` (default: centred); short arrays repeat."""
    a = _c(a)
    if offset is None:
        offset = F.greatest(F.floor((F.size(a) - steps * stride) / 2), F.lit(0))
    elif not isinstance(offset, Column):
        offset = F.lit(offset)
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: (offset + i * stride).cast("int")
    )
    return let(a, lambda v: F.transform(picks, lambda i: F.get(v, F.pmod(i, F.size(v)))))


def sample_linspace(a, windows: int, steps: int, stride: int = 1) -> Column:
    """``windows`` samples at evenly spaced whole offsets, concatenated."""
    a = _c(a)
    room = F.greatest(F.size(a) - steps * stride, F.lit(0))
    parts = [
        sample_sequence(
            a, steps, stride, F.floor(room * F.lit(w) / F.lit(max(windows - 1, 1))).cast("int")
        )
        for w in range(windows)
    ]
    return F.concat(*parts)


def unbatch_arrays(*columns: str) -> Column:
    """Parallel arrays of one pre-batched row as an array of structs, for ``explode``."""
    return F.arrays_zip(*columns)


def truncate_with_eos(a, limit: int, eos: int = 1) -> Column:
    """Arrays over ``limit`` keep limit - 1 items and end with the end marker."""
    a = _c(a)
    cut = F.concat(F.slice(a, 1, limit - 1), F.array(F.lit(eos)))
    return F.when(F.size(a) > limit, cut).otherwise(a)


def mask_trim(a, pad=0, hidden_pad=-1) -> Column:
    """Drop padding, then turn the stand-in for real zeros back into the padding value."""
    kept = F.filter(_c(a), lambda x: x != pad)
    return F.transform(kept, lambda x: F.when(x == hidden_pad, F.lit(pad)).otherwise(x))
