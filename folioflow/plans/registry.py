"""Names of all queries with their plans and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans import display, documents, knowledge, search, shelf, sequences

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (search, shelf, sequences, documents, knowledge, display):
    for _name, (_query, _sql) in _module.ALL.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLES[_name] = _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity merge over all hits of all sources."""
    return QUERIES["search_merge_entities"](spark, sf_dir)
