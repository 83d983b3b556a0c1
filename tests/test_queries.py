"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from folioflow.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_finds_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir.replace("0.001", "0.01")).count() > 0


def test_flagship_reads_only_the_columns_it_needs(spark, sf_dir):
    plan = registry.flagship(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "query_text" not in plan.split("ReadSchema")[-1]
