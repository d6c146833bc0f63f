"""Registry of runnable queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefmine.datasets import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "interactions"):
    """Register a query. ``sql`` is a SELECT, or ``, cte AS (...) SELECT ...`` after the named views."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            heads = [VIEWS[v] for v in views.split()]
            body = sql.strip()
            if not heads:
                ORACLES[name] = body
            else:
                ORACLES[name] = "WITH " + ",\n".join(heads) + "\n" + body
        return fn

    return add
