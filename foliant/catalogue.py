"""The registered queries of the core: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under `name`, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register
