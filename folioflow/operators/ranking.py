"""Order of hits, sources and candidates, and cuts by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import search
from folioflow.session import written


def ranks(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based place of every row in the order of its group, whatever a group's size.

    Rows are sorted by ranges; a row's place is its place within its range and group
    plus the rows of the group in earlier ranges. No group is gathered in one task. The
    order should be total: ties may come either way round.
    """
    keys = [F.col(g) for g in group] + order
    parted = rows.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id())
    parted = written(parted, "ranges")  # ranges are drawn from a sample: they must not change between the two uses
    inside = parted.withColumn("_n", F.row_number().over(Window.partitionBy("_p", *group).orderBy(*order)))
    counts = parted.groupBy("_p", *group).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    same = [inside["_p"] == before["_p"], *[inside[g].eqNullSafe(before[g]) for g in group]]
    return inside.join(before, same).select(*[inside[c] for c in rows.columns], (F.col("_n") + F.col("_b")).cast("bigint").alias(name))


def by_relevance(hits: DataFrame, query: Column | str, group: list[str]) -> DataFrame:
    """Hits with score and rank: score, then name, author and origin; arrival order where the query is blank (O1).

    hits carry their arrival order in ord; equal hits keep it.
    """
    q = F.lit(query) if isinstance(query, str) else query
    s = search.scored(hits, q).withColumn("_blank", F.when(text.utrim(F.coalesce(q, F.lit(""))) == "", F.col("ord")))
    shown = [F.when(F.col("_blank").isNull(), c) for c in (-F.col("score"), F.coalesce("name", F.lit("")), F.coalesce("author", F.lit("")), F.coalesce("origin", F.lit("")))]
    return ranks(s, group, [F.col("_blank"), *shown, F.col("ord")]).drop("_blank")


def first_distinct(hits: DataFrame, group: list[str], keys: list[str], order: str, limit: int) -> DataFrame:
    """The first `limit` distinct hits of every group, by arrival: where a search stops early."""
    one = search.distinct_first(hits, [*group, *keys], order)
    return ranks(one, group, [F.col(order)], "_n").filter(F.col("_n") <= limit).drop("_n")


def source_options(sources: DataFrame, collation: str | None = "zh") -> DataFrame:
    """Sources in the order users see: their own order (null counts as 0), then the name in its language's order."""
    name = F.collate(F.col("name"), collation) if collation else F.col("name")
    return ranks(sources, [], [F.coalesce("custom_order", F.lit(0)), name, F.col("origin")])


def from_position(rows: DataFrame, group: list[str], order: str, start: int, size: int) -> DataFrame:
    """Of every group the next `size` rows from a position on."""
    return ranks(rows.filter(F.col(order) >= start), group, [F.col(order)], "_n").filter(F.col("_n") <= size).drop("_n")


def available(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """How many sources other than its own have a target: name and author agree but for blanks and the author's label.

    targets: name, author, origin. Sources are counted by name and author before the
    join, so that no pairs of hits and targets of one name arise.
    """
    key = lambda d: d.withColumns({"_n": target_name(F.col("name")), "_a": target_author(F.col("author"))})
    have = key(hits).select("_n", "_a", "origin").distinct()
    counts = have.groupBy("_n", "_a").agg(F.count("*").alias("_c"))
    own = have.withColumn("_own", F.lit(1))
    return key(targets).join(counts, ["_n", "_a"], "left").join(own, ["_n", "_a", "origin"], "left").withColumn("sources", F.coalesce("_c", F.lit(0)) - F.coalesce("_own", F.lit(0))).select(*targets.columns, "sources")


def target_name(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), text.WS, "")


def target_author(author: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(author, F.lit("")), text.WS, ""), "^(作者)?[：:]*", "")


def with_source(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with the name and group of their source: their own, else the source's, else the origin."""
    s = sources.select("origin", F.col("name").alias("_name"), F.col("groups").alias("_groups"))
    return hits.join(s, "origin", "left").withColumns({"origin_name": F.coalesce("origin_name", "_name", "origin"), "origin_group": F.col("_groups")}).drop("_name", "_groups")
