"""All registered queries, each beside the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("features", "ranks", "portfolios", "vendor", "contracts", "research", "pairs", "forecasts", "quality_reports", "recommendations", "live")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the DuckDB SQL for the same rows if there is one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return query

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["g5_sort_return"](spark, sf_dir)
