"""Keyed documents: upsert, delete, progress, groups and caches as relational operators.

Parquet has no MERGE, so every change gives the new state as a DataFrame; `swap`
writes it beside the old one and moves it into place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import utrim


def _row(df: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[c for c in df.columns if c not in keys])


def latest(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """The newest row of every key by a version expression (D1, D4, D17, D21); a later tie wins by its own fields."""
    return rows.groupBy(*keys).agg(F.max_by(_row(rows, keys), version).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.col("_v")).drop("_v")


def upsert_keeping_place(old: DataFrame, new: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """List upsert: a known key keeps its place, others follow behind in their order."""
    behind = old.agg(F.coalesce(F.max(pos), F.lit(-1)).alias("_m"))
    n = new.withColumnRenamed(pos, "_new")
    known = old.select(*keys, F.col(pos).alias("_old"))
    placed = n.join(known, keys, "left").join(F.broadcast(behind)).withColumn(pos, F.coalesce(F.col("_old"), F.col("_m") + 1 + F.col("_new"))).drop("_old", "_new", "_m")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(placed, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in a set."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_either(rows: DataFrame, gone: DataFrame, one: list[str], other: list[str], spared: Column) -> DataFrame:
    """Rows that match neither of two keys, spared ones aside from the second (D10): two equi joins, no nested loop."""
    left = rows.join(gone.select(*one).distinct(), one, "left_anti")
    return left.filter(~spared).join(gone.select(*other).distinct(), other, "left_anti").unionByName(left.filter(spared))


def copy_namespace(rows: DataFrame, source: str, target: str, keys: list[str], ns: str = "user_ns") -> DataFrame:
    """Rows of a namespace upserted into another (D3)."""
    return upsert(rows, rows.filter(F.col(ns) == source).withColumn(ns, F.lit(target)), [ns, *keys])


def filled(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Null fields of new rows taken from the old row of the key."""
    o = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return new.join(o, keys, "left").select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in new.columns])


def newest_progress(rows: DataFrame, keys: list[str], time: str, fields: list[str], place: str) -> DataFrame:
    """The fields of the latest time of every key; the last of equals wins."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(time, *[f for f in fields if f != time]), F.struct(F.coalesce(F.col(time), F.lit(0)), F.col(place))).alias("_p")).select(*keys, "_p.*")


def in_group(mask: Column, group: int) -> Column:
    """Shelf filter: -1 all, 0 those of no group, else those with the bit."""
    if group == -1:
        return F.lit(True)
    return F.coalesce(mask, F.lit(0)) == 0 if group == 0 else F.coalesce(mask, F.lit(0)).bitwiseAND(F.lit(group)) != 0


def with_group(mask: Column, group: int) -> Column:
    return F.coalesce(mask, F.lit(0)).bitwiseOR(F.lit(group))


def without_group(mask: Column, group: int) -> Column:
    return F.coalesce(mask, F.lit(0)).bitwiseAND(F.bitwise_not(F.lit(group)))


def with_marker(groups: Column, marker: str) -> Column:
    """A marker added to a delimited list of group names, names kept once and in order."""
    return F.array_join(F.array_distinct(F.array_append(group_names(groups), F.lit(marker))), ",")


def without_marker(groups: Column, marker: str) -> Column:
    return F.array_join(F.array_remove(group_names(groups), marker), ",")


def group_names(groups: Column) -> Column:
    """Names of a list delimited by , ; ； 、, trimmed and kept once (F2)."""
    parts = F.transform(F.split(F.coalesce(groups, F.lit("")), "[,;；、]"), utrim)
    return F.array_distinct(F.filter(parts, lambda g: g != ""))


def live_sessions(sessions: DataFrame, now: Column, ttl_seconds: int = 7 * 86_400, seen: str = "seen_at") -> DataFrame:
    """Sessions seen within the time to live, their end slid forward."""
    end = F.col(seen) + F.expr(f"interval {ttl_seconds} seconds")
    return sessions.withColumn("expires_at", end).filter(F.col("expires_at") > now)


def cascade(dependents: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Every dependent table without the rows of deleted keys."""
    return {name: delete(rows, gone, keys) for name, rows in dependents.items()}


def with_progress(shelf: DataFrame, moves: DataFrame, chapters: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Shelf rows moved to a chapter: index, position, time and the chapter's title; unmoved rows stay."""
    m = moves.select(*keys, F.col("chapter_index").alias("_i"), F.col("chapter_pos").alias("_p"))
    t = chapters.select(*keys, F.col("chapter_index").alias("_i"), F.col("title").alias("_t"))
    j = shelf.join(m.join(t, [*keys, "_i"], "left"), keys, "left")
    moved = F.col("_i").isNotNull()
    new = {"dur_chapter_index": F.col("_i"), "dur_chapter_pos": F.col("_p"), "dur_chapter_time": now, "dur_chapter_title": F.coalesce(F.col("_t"), F.col("dur_chapter_title"))}
    return j.select(*[F.when(moved, new[c]).otherwise(F.col(c)).cast(dict(shelf.dtypes)[c]).alias(c) if c in new else F.col(c) for c in shelf.columns])


def allocated(groups: DataFrame, new: DataFrame, key: str = "group_id", place: str = "pos", owner: str = "user_ns") -> DataFrame:
    """New groups of id 0 get the ids behind the greatest of their owner; others replace theirs.

    Each owner's few new groups are numbered by themselves.
    """
    top = groups.groupBy(owner).agg(F.max(key).alias("_m"))
    rank = F.sum((F.col(key) == 0).cast("bigint")).over(Window.partitionBy(owner).orderBy(place))
    given = new.withColumn("_r", rank).join(top, owner, "left").withColumn(key, F.when(F.col(key) == 0, F.coalesce("_m", F.lit(0)) + F.col("_r")).otherwise(F.col(key)))
    return upsert(groups, given.select(*new.columns), [owner, key])


def switched(shelf: DataFrame, moves: DataFrame, fields: list[str], keys: tuple[str, ...] = ("user_ns", "book_url")) -> DataFrame:
    """Shelf rows moved to another source: the new address, fields of the new source where it has them.

    moves: the keys, new_url, new_origin and the fields.
    """
    m = moves.select(*keys, "new_url", "new_origin", *[F.nullif(F.trim(f), F.lit("")).alias(f"_{f}") for f in fields])
    j = shelf.join(m, list(keys), "left")
    put = {"book_url": F.coalesce("new_url", "book_url"), "origin": F.coalesce("new_origin", "origin")} | {f: F.coalesce(f"_{f}", f) for f in fields}
    return j.select(*[put[c].alias(c) if c in put else F.col(c) for c in shelf.columns])


def recent(rows: DataFrame, keys: list[str], opened: str, now: Column, is_feed: Column, most: int = 100, feed_days: int = 7) -> DataFrame:
    """The newest opened rows, feed ones up to an age, a stated number of them (F16)."""
    fresh = rows.filter(F.col(opened).isNotNull() & (~is_feed | (F.col(opened) > now - F.lit(feed_days * 86_400))))
    return fresh.orderBy(F.desc(opened), *keys).limit(most)


def swap(state: DataFrame, path: str, mode: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Writes a state beside an old one and moves it into its place."""
    spark = state.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    mode(state).write.parquet(beside)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(jvm.org.apache.hadoop.fs.Path(beside), at)
    fs.delete(old, True)
