"""Deterministic pseudo-randomness from integer arithmetic.

Every random choice in this package is a function of (key, counter, seed), so any run, any
partitioning and any SQL engine give the same draw. The distribution is what the random
generators it stands for would give; the single draws are our own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def mix(a, b=0, seed: int = 0) -> Column:
    """Hash of two integers and a seed, in [0, MODULUS), as BIGINT."""
    m = F.lit(MODULUS).cast("bigint")
    a = F.pmod(_col(a).cast("bigint"), m)
    b = F.pmod(_col(b).cast("bigint"), m)
    linear = (a * 48271 + b * 69621 + (seed % MODULUS) * 16807 + 12345) % m
    return (((linear * linear) % m) * 48271 + linear + 11) % m


def mix_base(a, seed: int = 0) -> Column:
    """What ``mix`` takes from its first integer and the seed, for many second integers of a row."""
    a = F.pmod(_col(a).cast("bigint"), F.lit(MODULUS).cast("bigint"))
    return a * 48271 + (seed % MODULUS) * 16807 + 12345


def mix_on(base: Column, b: Column) -> Column:
    """``mix`` from its :func:`mix_base` and a second integer in [0, MODULUS)."""
    m = F.lit(MODULUS).cast("bigint")
    linear = (base + b.cast("bigint") * 69621) % m
    return (((linear * linear) % m) * 48271 + linear + 11) % m


def unit(a, b=0, seed: int = 0) -> Column:
    """Uniform fraction in [0, 1)."""
    return mix(a, b, seed) / F.lit(float(MODULUS))


def draw(n, a, b=0, seed: int = 0) -> Column:
    """Uniform integer in [0, n)."""
    return mix(a, b, seed) % _col(n).cast("bigint")
