"""Counters of a running job, taken beside its result without a second pass.

A counter is an aggregate column over the rows that pass a place of the plan. Spark adds the counts
up with the tasks' results, so rows are read once; a task that is run again counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQuery


class Counters:
    """Named places of a plan and what is counted there."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def at(self, df: DataFrame, place: str, **counts: Column) -> DataFrame:
        """``df``, whose rows are counted as they pass; a place can be used once."""
        if place in self._seen:
            raise ValueError(f"{place} is counted already")
        self._seen[place] = Observation(place)
        return df.observe(self._seen[place], *[c.alias(n) for n, c in counts.items()])

    def values(self) -> dict[str, int]:
        """``place.counter`` of the job that has run; waits for none that was never started."""
        return {f"{place}.{n}": v for place, seen in self._seen.items() for n, v in seen.get.items()}


def write_counted(make: Callable[[Counters], DataFrame], path: str) -> dict[str, int]:
    """Write what ``make`` gives and return its counters, which are complete once the result is."""
    counters = Counters()
    make(counters).write.parquet(path)
    return counters.values()


def stream_counts(query: StreamingQuery, place: str) -> dict[str, int]:
    """The counters of a place summed over the batches that a streaming query still remembers."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        row = (progress["observedMetrics"] or {}).get(place)
        for n, v in (row.asDict() if hasattr(row, "asDict") else row or {}).items():
            total[n] = total.get(n, 0) + (v or 0)
    return total
