"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans.tables import VIEW_SQL, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

_MODULES = (
    "dataset", "scans", "joins", "aggregates", "timelines", "text", "recommender",
    "corpus", "answers", "detection", "reuse", "streams", "mechanisms",
)


def check(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB statement for the same result; the views it names in ``views``
    are put in front of it as common table expressions.
    """

    def keep(fn):
        assert name not in _QUERIES, name
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = _with_views(views.split(), sql.strip())
        return fn

    return keep


def _with_views(views: list[str], sql: str) -> str:
    if not views:
        return sql
    heads = ",\n".join(VIEW_SQL[v] for v in views)
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{sql[14:].lstrip()}"
    if sql[:4].upper() == "WITH":
        return f"WITH {heads},\n{sql[4:].lstrip()}"
    return f"WITH {heads}\n{sql}"


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"feedloom.plans.{module}_queries")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
