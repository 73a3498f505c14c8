"""Named queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) under a name; sql may use the fixture views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            from .fixtures import with_views

            ORACLES[name] = with_views(sql)
        return f

    return add
