"""All registered queries of the engine, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_FLAGSHIP: list[Query] = []


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its oracle where SQL has one."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(function: Query) -> Query:
    """Mark the query that stands for the whole engine."""
    _FLAGSHIP.append(function)
    return function


def run_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FLAGSHIP[-1](spark, sf_dir)
