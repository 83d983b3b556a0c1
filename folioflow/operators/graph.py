"""Relationship graphs: degrees, protagonist, ego network, layout and hierarchy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import written


def endpoints(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Every edge seen from either end; self loops are dropped."""
    e = edges.filter(F.col(source) != F.col(target))
    other = [c for c in edges.columns if c not in (source, target)]
    return e.select(F.inline(F.array(F.struct(F.col(source).alias("node"), F.col(target).alias("neighbour")), F.struct(F.col(target).alias("node"), F.col(source).alias("neighbour")))), *other)


def degrees(edges: DataFrame) -> DataFrame:
    """Edges of every node."""
    return endpoints(edges).groupBy("node").agg(F.count("*").alias("degree"))


def protagonist(nodes: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """The node of the highest 4 if important + recency + 10 per edge; ties by name."""
    recency = F.greatest(F.lit(0), 8 - F.abs(now - F.coalesce("last_seen", F.lit(-1000))))
    s = nodes.join(degrees(edges), "node", "left").withColumn("weight", F.when(F.col("importance") == "high", 4).otherwise(0) + recency + 10 * F.coalesce("degree", F.lit(0)))
    return s.orderBy(F.desc("weight"), "node").limit(1)


def ego_network(edges: DataFrame, center: str, top: int = 15) -> DataFrame:
    """Neighbours of a node by the sum of their edges' weights."""
    near = endpoints(edges).filter(F.col("node") == center)
    return near.groupBy("neighbour").agg(F.sum("weight").alias("weight"), F.count("*").alias("relations")).orderBy(F.desc("weight"), "neighbour").limit(top)


def circle(rank: Column, total: Column, radius: float) -> tuple[Column, Column]:
    """Places on a circle, rounded half up to tenths."""
    angle = F.lit(2 * math.pi) * rank / total - math.pi / 2
    rounded = lambda x: F.floor(x * 10 + 0.5) / 10
    return rounded(radius * F.cos(angle)), rounded(radius * F.sin(angle))


def hierarchy(places: DataFrame) -> DataFrame:
    """(name, depth, path) of a forest given by name and parent (the walk of K13).

    Each round joins one level to the next until a level is empty. A place has one
    parent, so none below a root is on a cycle; places on or below a cycle become roots.
    """
    p = written(places.select("name", F.col("parent").alias("parent")).dropDuplicates(["name"]), "places")
    real = p.join(p.select(F.col("name").alias("parent")), "parent", "left_semi").select("name", "parent").filter(F.col("name") != F.col("parent"))
    level = p.join(real.select("name"), "name", "left_anti").select("name", F.lit(0).alias("depth"), F.col("name").alias("path"))
    out = level
    while True:
        level = written(real.join(level.select(F.col("name").alias("parent"), "depth", "path"), "parent").select("name", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "name").alias("path")), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    circular = p.join(out.select("name"), "name", "left_anti").select("name", F.lit(0).alias("depth"), F.col("name").alias("path"))
    return out.unionByName(circular)


def closure(links: DataFrame, starts: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(root, page, depth): pages reached from each start by following links, each once (U8).

    Rounds double the reach: what is known up to n steps is joined to the links of
    exactly n steps, then those are joined to themselves. A chain of a million pages
    needs twenty rounds; it ends when nothing new is met. Meant for links of which a
    page has few, as next pages have.
    """
    jump = written(links.select("page", "next").filter("next is not null").distinct(), "jump")
    seen = written(starts.select("root", F.col("root").alias("page"), F.lit(0).alias("depth")).distinct(), "seen")
    known = seen.count()
    for k in range(most_rounds):
        further = seen.join(jump, "page").select("root", F.col("next").alias("page"), (F.col("depth") + 2**k).cast("int").alias("depth"))
        seen = written(seen.unionByName(further).groupBy("root", "page").agg(F.min("depth").alias("depth")), "seen")
        count = seen.count()
        if count == known:
            break
        known = count
        second = jump.select(F.col("page").alias("next"), F.col("next").alias("last"))
        jump = written(jump.join(second, "next").select("page", F.col("last").alias("next")).distinct(), "jump")
    return seen
