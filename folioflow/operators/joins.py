"""Look-ups of the service as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import urls
from folioflow.session import spread


def cached_counts(shelf: DataFrame, cache: DataFrame, key: str = "book_url") -> DataFrame:
    """Shelf rows with the number of their chapters in the cache (J1): the cache is counted before it is joined."""
    counts = cache.groupBy(key).agg(F.count_distinct("chapter_url").alias("cached_chapters"))
    return shelf.join(counts, key, "left").withColumn("cached_chapters", F.coalesce("cached_chapters", F.lit(0)))


def with_cache(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is cached."""
    return rows.join(cache.select(*keys), keys, "left_semi")


def without_cache(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still to be fetched."""
    return rows.join(cache.select(*keys), keys, "left_anti")


def by_prefix(links: DataFrame, shelf: DataFrame, link: str = "chapter_url", book: str = "book_url", place: str = "pos") -> DataFrame:
    """The first shelf book whose URL is a prefix of a link.

    Every prefix of a link that ends at a path separator or at its whole length is a
    key, so the prefix condition is an equi join instead of a nested loop.
    """
    l = links.select(link).distinct()
    n = F.size(F.split(link, "/"))
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.call_function("substring_index", F.col(link), F.lit("/"), k))
    keyed = l.select(link, F.explode(F.array_distinct(F.concat(prefixes, F.array(link)))).alias("_p"))
    s = shelf.groupBy(F.regexp_replace(book, "/+$", "").alias("_p")).agg(F.min(F.struct(place, book)).alias("_b"))
    first = keyed.join(s, "_p").groupBy(link).agg(F.min("_b").alias("_b"))
    return first.select(link, F.col(f"_b.{book}").alias(book))


def by_domain(links: DataFrame, sources: DataFrame, link: str = "book_url", source: str = "source_url") -> DataFrame:
    """Links with the sources of their domain (J5, F18): equal hosts, one host ending in the other, or an equal main label.

    Suffixes of a host that end at a dot are keys, so that no condition needs a nested loop.
    """
    def keys(col: str) -> Column:
        labels = F.split(urls.host(F.col(col)), r"\.")
        n = F.size(labels)
        tails = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: F.array_join(F.slice(labels, k + 1, n - k), "."))
        return tails

    h = lambda c: urls.host(F.col(c))
    l = links.select(link).distinct()
    s = sources.select(source).distinct()
    # a host meets another if it is among the other's suffixes, or their main labels agree
    down = l.select(link, F.explode(keys(link)).alias("_k")).join(s.select(source, h(source).alias("_k")), "_k")
    up = l.select(link, h(link).alias("_k")).join(s.select(source, F.explode(keys(source)).alias("_k")), "_k")
    root = l.select(link, urls.root_domain(F.col(link)).alias("_k")).join(s.select(source, urls.root_domain(F.col(source)).alias("_k")), "_k")
    return down.select(link, source).unionByName(up.select(link, source)).unionByName(root.select(link, source)).distinct()


def named(relations: DataFrame, people: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Relations with the names of both ends; the raw id where a name is missing."""
    one = people.select(F.col("id").alias(source), F.col("name").alias("source_name"))
    two = people.select(F.col("id").alias(target), F.col("name").alias("target_name"))
    return relations.join(one, source, "left").join(two, target, "left").withColumns({"source_name": F.coalesce("source_name", source), "target_name": F.coalesce("target_name", target)})


def both_ends(relations: DataFrame, allowed: DataFrame, source: str, target: str, key: str = "id") -> DataFrame:
    """Relations whose two ends are in a set."""
    a = relations.join(allowed.select(F.col(key).alias(source)), source, "left_semi")
    return a.join(allowed.select(F.col(key).alias(target)), target, "left_semi")


def resolved(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """Names with the first entity that has them as its name or an alias."""
    known = entities.select("id", "ord", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n"))
    first = known.groupBy(F.lower(F.trim("_n")).alias("_k")).agg(F.min_by("id", "ord").alias("entity_id"))
    return names.withColumn("_k", F.lower(F.trim(name))).join(first, "_k", "left").drop("_k")


def mentions(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, key_limit: int = 5000) -> DataFrame:
    """Texts with the names they mention.

    Names are a stated set. The pairs of characters they begin with are looked up
    among the pairs of each text and the whole name is then checked, so a text meets
    only names it shares a beginning with. Up to key_limit beginnings (counted) are
    looked up inside the row; more of them are joined.
    """
    keyed = names.filter(F.length(name_col) >= 2).select(name_col, F.left(F.col(name_col), F.lit(2)).alias("_k")).distinct()
    begins = keyed.select("_k").distinct()
    known = [r["_k"] for r in begins.limit(key_limit + 1).collect()]
    letters = F.split(F.col(text_col), "")
    pairs = F.array_distinct(F.zip_with(letters, F.slice(letters, F.lit(2), F.size(letters)), lambda a, b: F.concat(a, b)))
    t = spread(texts.filter(F.length(text_col) >= 2))
    if len(known) <= key_limit:
        pairs = F.array_intersect(pairs, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))
    t = t.withColumn("_k", F.explode(pairs))
    return t.join(keyed, "_k").filter(F.contains(text_col, F.col(name_col))).drop("_k")
