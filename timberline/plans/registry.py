"""Where queries are registered, with the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key], SQL[key] = f, oracle
        return f

    return add
