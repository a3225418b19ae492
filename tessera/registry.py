"""All registered queries and their SQL.

A query is a function (spark, sf_dir) -> DataFrame; the decorator notes the equivalent SQL where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from tessera.plans import aggregations, filters, joins, jsons, matching, numbers, scans, sets, sorting, streams, strings, times, windowed  # noqa: F401


load()
