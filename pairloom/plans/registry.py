"""Named queries, the operators each exercises, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(operators: str, sql: str | None = None):
    """Register a query by its function's name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        OPERATORS[function.__name__] = operators
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add
