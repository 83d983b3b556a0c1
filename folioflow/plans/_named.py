"""Collects a module's queries by name, each with its SQL if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def collector() -> tuple[dict[str, tuple[Query, str | None]], Callable[..., Callable[[Query], Query]]]:
    every: dict[str, tuple[Query, str | None]] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            every[f.__name__] = (f, sql)
            return f

        return put

    return every, query
