"""Aggregations of the service (A4-A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.store import group_names


def count_by(rows: DataFrame, column: str) -> DataFrame:
    """Rows of every value (A4)."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def sorted_counts(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Of every key a map from value to count, sorted by value (A4)."""
    c = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("counts"))


def flags(rows: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Rows of a key that meet each condition."""
    out = [F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()]]
    return rows.groupBy(*keys).agg(*out) if keys else rows.agg(*out)


def cache_summary(cache: DataFrame) -> DataFrame:
    """Of every book: cached chapters, bytes and the newest update."""
    return cache.groupBy("book_url").agg(F.count("*").alias("chapters"), F.sum("size_bytes").alias("bytes"), F.max("updated_at").alias("updated_at"))


def distinct_group_names(rows: DataFrame, column: str) -> DataFrame:
    """Group names of delimited lists (A10)."""
    return rows.select(F.explode(group_names(F.col(column))).alias("name")).distinct()
