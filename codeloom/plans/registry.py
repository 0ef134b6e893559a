"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name; ``sql`` is its check, if SQL can state it."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            CHECK_SQL[function.__name__] = sql
        return function

    return add
