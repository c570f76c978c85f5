"""All queries of the library proper, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query, and the SQL that gives the same rows."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return query

    return add


def sql_of(name: str) -> str:
    """The SQL of a query registered before."""
    return _SQL[name]


def _load() -> None:
    """Imports the modules that register queries."""
    for module in ("relational", "statistics", "streams", "learning"):
        importlib.import_module(f"tidemark.plans.{module}")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["flagship"](spark, folder)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
