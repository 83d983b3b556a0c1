"""Ordered semantics: gaps, segments, look-back, look-ahead, budgets and folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text


def first_missing(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The first integer from 0 on that a key lacks, and the last processed before it."""
    present = rows.filter(F.col(index) >= 0).select(*keys, F.col(index).alias("_i")).distinct()
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("_i")) - 1
    gaps = present.withColumn("_n", n).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_i") != F.col("_n"), F.col("_n"))), F.count("*")).cast("bigint").alias("first_missing"))
    return gaps.withColumn("processed", F.when(F.col("first_missing") > 0, F.col("first_missing") - 1))


def look_back(rows: DataFrame, keys: list[str], order: list[str], value: Column, back: int, name: str) -> DataFrame:
    """The last `back` values before each row, in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, -1)
    return rows.withColumn(name, F.collect_list(value).over(w))


def look_ahead_min(rows: DataFrame, keys: list[str], order: list[str], value: Column, ahead: int, name: str) -> DataFrame:
    """The least value among the next rows."""
    return rows.withColumn(name, F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, ahead)))


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows emitted until the sizes before them reach a budget."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("used_before", before).filter(F.col("used_before") < budget)


def running_mean(values: Column) -> Column:
    """Integer running mean of an ordered array: (mean * (n - 1) + x) div n at each step."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("mean"))
    step = lambda s, x: F.struct((s["n"] + 1).alias("n"), F.call_function("div", s["mean"] * s["n"] + x.cast("bigint"), s["n"] + 1).alias("mean"))
    return F.aggregate(values, start, step)["mean"]


def running_mean_of(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """(key, mean): the integer running mean of every key's values in order.

    The truncation at each step binds the result to the order, so a key's values pass one
    task; they pass it as a sorted stream of which only the running state is kept.
    """
    kind = dict(rows.dtypes)[key]
    s = rows.select(key, *order, value.cast("bigint").alias("_v")).repartition(key).sortWithinPartitions(key, *order).select(key, "_v")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, mean, begun = None, 0, 0, False
        for batch in batches:
            out = []
            for k, v in zip(batch[key], batch["_v"]):
                if not begun or k != last:
                    if begun:
                        out.append((last, mean))
                    last, n, mean, begun = k, 0, 0, True
                total, n = mean * n + int(v), n + 1
                mean = total // n if total >= 0 else -(-total // n)
            yield pd.DataFrame(out, columns=[key, "mean"])
        if begun:
            yield pd.DataFrame([(last, mean)], columns=[key, "mean"])

    return s.filter("_v is not null").mapInPandas(fold, f"`{key}` {kind}, mean bigint")


def distinct_spellings(values: Column) -> Column:
    """Values of an array kept once by canonical key, the first spelling wins."""
    keep = lambda acc, x: F.when(F.exists(acc, lambda y: text.canonical_key(y) == text.canonical_key(x)) | (text.canonical_key(x) == ""), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(values, F.array().cast("array<string>"), keep)


def interleave(a: Column, b: Column) -> Column:
    """Two arrays merged turn by turn."""
    pairs = F.arrays_zip(F.transform(a, lambda x: F.struct(x.alias("v"))).alias("a"), F.transform(b, lambda x: F.struct(x.alias("v"))).alias("b"))
    return F.transform(F.filter(F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"]))), lambda x: x.isNotNull()), lambda x: x["v"])


def first_nonempty(*lists: Column) -> Column:
    """The first array with anything in it."""
    out = lists[-1]
    for a in reversed(lists[:-1]):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return out


def reindexed(rows: DataFrame, keys: list[str], order: list[Column], name: str = "index") -> DataFrame:
    """Consecutive numbers from 0 in an order."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def window_count(rows: DataFrame, keys: list[str], seconds: Column, span: int, name: str) -> DataFrame:
    """Rows of a key within a sliding span up to each row (T5)."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-span + 1, 0)))


def story_chapters(rows: DataFrame, keys: list[str], index: str, title: str) -> DataFrame:
    """Chapters that tell the story: without notices, and without late chapters listed first."""
    t, n = text.chapter_title(F.col(title)), text.chapter_ordinal(F.col(title))
    prologue = t.isin(*text.PROLOGUES)
    ahead = Window.partitionBy(*keys).orderBy(index).rowsBetween(1, 19)
    first_main = F.min(F.when((n == 1) & ~prologue, F.col(index))).over(Window.partitionBy(*keys))
    early = (F.col(index) <= 30) & (n >= 50) & (F.coalesce(F.col(index) < first_main, F.lit(False)) | F.coalesce(F.min(n).over(ahead) <= 10, F.lit(False)))
    keep = (t != "") & (prologue | (~t.rlike("|".join(text.NON_STORY)) & ~F.coalesce(early, F.lit(False))))
    return rows.withColumn("_keep", keep).filter("_keep").drop("_keep")
