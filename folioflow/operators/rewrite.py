"""Ordered, scoped rewrite rules and snippet search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text


def in_scope(scope: str | None, origin: Column, name: Column, url: Column) -> Column:
    """Whether a rule's scope holds for a row: all, one source, one book, or a name with an optional address."""
    s = (scope or "").strip()
    if s in ("", "*"):
        return F.lit(True)
    if s.startswith("source:"):
        return F.coalesce(origin == s[7:], F.lit(False))
    if s.startswith("book:"):
        return F.coalesce(url == s[5:], F.lit(False))
    parts = s.split(";")
    held = F.lit(True) if parts[0] == "*" else F.coalesce(name == parts[0], F.lit(False))
    return held & (F.coalesce(url == parts[1], F.lit(False)) if len(parts) > 1 else F.lit(True))


def apply_rules(rows: DataFrame, rules: list[dict], column: str, origin: str = "origin", name: str = "name", url: str = "book_url") -> DataFrame:
    """Enabled rules in their order, each where its scope holds.

    Rules are a user's settings, a plan-time list: they become one nested expression.
    """
    value = F.coalesce(F.col(column), F.lit(""))
    for r in sorted((r for r in rules if r.get("is_enabled", True)), key=lambda r: r.get("order", 0)):
        scope = in_scope(r.get("scope"), F.col(origin), F.col(name), F.col(url))
        value = F.when(scope, text.rewrite(value, [(r["pattern"], r.get("replacement", ""), r.get("is_regex", False))])).otherwise(value)
    return rows.withColumn(column, value)


def search(rows: DataFrame, column: str, keyword: str, keep: list[str]) -> DataFrame:
    """(keep, pos, snippet) of every match of a keyword."""
    return rows.filter(F.contains(F.lower(F.col(column)), F.lit(keyword.lower()))).select(*keep, F.inline(text.snippets(F.col(column), keyword)))
