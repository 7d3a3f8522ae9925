"""Small numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def log_dense(x) -> Column:
    """ln(x + 1) of a dense feature; missing and negative count as 0."""
    return F.log1p(F.greatest(F.coalesce(_c(x), F.lit(0.0)), F.lit(0.0)))


def bucketise(x, buckets: int) -> Column:
    """Integer id folded into a vocabulary of fixed size."""
    return F.pmod(_c(x), F.lit(buckets))


def batches_needed(rows: Column, size: int, per_step: int = 1) -> Column:
    """ceil(rows / size), rounded up to a multiple of ``per_step``."""
    batches = F.ceil(rows / size)
    return F.ceil(batches / per_step) * per_step


def f_score(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).otherwise(0.0)
