"""Every registered query of the message engine, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        assert key not in _QUERIES, key
        _QUERIES[key] = function
        if sql:
            _SQL[key] = sql
        return function

    return add


def _load() -> None:
    """Import the modules that register queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"lettermill.plans.{module}")


#: Modules of registered queries.
MODULES: list[str] = ["search_queries", "engine_queries", "parsing_queries", "archive_queries"]


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
