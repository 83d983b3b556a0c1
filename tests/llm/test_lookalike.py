"""Look-alike normalisation against the Unicode data."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.llm import lookalike

DIRTY = ["Ｂeneaｔh", "⽉殿", "été", "ab​c", "a b", "Тhе Lantern", "Α Mirror", "ΤΧΤ下载", "３０年", "ﬁne", "Дыминкa", "星　河", "Ⅷ"]
CLEAN = ["Beneath", "月殿", "été", "《星河》（全本）：续", "Дыминка Белира", "Росник [Complete]", "東屐散", "cœur", "", "生研…", "A级", "O’Neil"]


def test_dirty_and_clean(spark):
    d = spark.createDataFrame([(x,) for x in DIRTY + CLEAN], "v string")
    got = {r["v"]: r["x"] for r in d.select("v", lookalike.is_dirty(F.col("v")).alias("x")).collect()}
    assert [v for v in DIRTY if not got[v]] == [] and [v for v in CLEAN if got[v]] == []


def test_visible_is_compatibility_composition(spark):
    values = ["Ｂeneaｔh", "été", "ﬁne Ⅷ", "３０年", "⽉殿"]
    d = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    assert [r["x"] for r in d.orderBy("n").select(lookalike.visible(F.col("v")).alias("x")).collect()] == [unicodedata.normalize("NFKC", v) for v in values]


def test_canonical_member_is_the_most_used_clean_one(spark):
    d = spark.createDataFrame([(1, "Lantern", "x"), (2, "LANTERN", None), (3, "Lantern", ""), (4, "L​antern", "x"), (5, "Lаntеrn", "é"), (6, None, "é")], "hit_id bigint, name string, author string")
    values = lookalike.values_of(d, "t", "hit_id", ["name", "author"])
    forms = {(r["row_id"], r["field_name"]): r["canonical"] for r in lookalike.canonical_forms(values).collect()}
    assert {forms[k, "name"] for k in range(1, 6)} == {"Lantern"} and (6, "name") not in forms and (2, "author") not in forms
    assert forms[6, "author"] == forms[5, "author"] == "é"
    assert sorted((r["row_id"], r["field_name"]) for r in lookalike.lookalike_rows(values).collect()) == [(4, "name"), (5, "name"), (6, "author")]
    assert lookalike.lookalike_rows(values.limit(0)).count() == 0


@pytest.mark.parametrize("value", ["x" * 100_000 + "​"])
def test_very_long_values(spark, value):
    d = spark.createDataFrame([(1, value)], "hit_id bigint, name string")
    assert lookalike.lookalike_rows(lookalike.values_of(d, "t", "hit_id", ["name"])).first()["canonical"] == "x" * 100_000
