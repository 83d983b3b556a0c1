"""Federated search: score, filter, merge, rank and page hits of many sources.

A hit is (name, author, origin, book_url, six optional fields) with an explicit
arrival order `ord`; every result that depends on order takes it from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text

OPTIONAL = ("cover_url", "intro", "kind", "last_chapter", "update_time", "word_count")

# Categories of an explore page with their title and keywords, and words of rank and of novelty.
CATEGORIES = {
    "mixed": ("综合", ()),
    "rank": ("排行", ("排行", "榜", "热门", "点击", "推荐", "人气", "收藏", "月票")),
    "new": ("新书", ("新书", "最新", "入库", "更新")),
    "finished": ("完本", ("完本", "全本", "完结")),
    "fantasy": ("玄幻", ("玄幻", "奇幻", "魔法", "修仙", "仙侠")),
    "urban": ("都市", ("都市", "言情", "生活", "职场")),
    "history": ("历史", ("历史", "军事", "战争", "架空")),
    "sci-fi": ("科幻", ("科幻", "未来", "末世", "星际")),
    "suspense": ("悬疑", ("悬疑", "灵异", "推理", "侦探", "惊悚")),
}
HOT, COLD = CATEGORIES["rank"][1], ("新书", "最新", "更新")


def scored(hits: DataFrame, query: Column | str) -> DataFrame:
    """Adds score and strong."""
    q = F.lit(query) if isinstance(query, str) else query
    return hits.withColumn("_r", text.relevance(q, F.col("name"), F.col("author"))).withColumns({"score": F.col("_r.score"), "strong": F.col("_r.strong")}).drop("_r")


def strict(hits: DataFrame, query: Column | str) -> DataFrame:
    """Strong matches only."""
    return scored(hits, query).filter("strong")


def soft(hits: DataFrame, query: Column | str, group: list[str]) -> DataFrame:
    """Strong matches of each group of hits; all of a group that has none.

    Whether a group has a strong match comes from an aggregation joined back, so no
    group is gathered into one task.
    """
    s = scored(hits, query)
    any_strong = s.filter("strong").select(*group).distinct().withColumn("_any", F.lit(True))
    return s.join(any_strong, group, "left").filter(F.col("strong") | F.col("_any").isNull()).drop("_any")


def merged(hits: DataFrame) -> DataFrame:
    """One row per merge key: the first hit, its empty fields filled by later ones, all origins in order (A1)."""
    h = hits.withColumn("merge_key", text.merge_key(F.col("name"), F.col("author")))
    # per origin first: origins of a key are few, its hits may be many
    per_origin = h.groupBy("merge_key", "origin").agg(
        F.min("ord").alias("o"), F.min_by(F.struct("name", "author", "book_url"), "ord").alias("first"),
        *[F.min(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v")))).alias(c) for c in OPTIONAL],
    )
    return per_origin.groupBy("merge_key").agg(
        F.min("o").alias("ord"), F.min_by("first", "o").alias("first"), F.min_by("origin", "o").alias("origin"),
        *[F.min(c)["v"].alias(c) for c in OPTIONAL],
        F.array_sort(F.collect_list(F.struct("o", "origin"))).alias("origins"),
    ).select("merge_key", "ord", "first.*", "origin", *OPTIONAL, F.transform("origins", lambda x: x["origin"]).alias("book_source_urls"))


def explore_merged(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits of category pages merged by key and ranked: sources, score, position, name (A2, O2)."""
    h = hits.filter(text.utrim(F.coalesce("name", F.lit(""))) != "").withColumn("merge_key", text.merge_key(F.col("name"), F.col("author")))
    first = F.col("category_score") + F.lit(100) - F.least("position", F.lit(100))
    m = h.groupBy("merge_key").agg(
        F.count("*").alias("source_count"), F.min("position").alias("best_position"), F.min_by("name", "ord").alias("name"), F.min_by("author", "ord").alias("author"),
        (F.min_by(first, "ord") + F.sum(F.col("category_score") + 20) - F.min_by(F.col("category_score") + 20, "ord")).alias("score"),
    )
    return m.orderBy(F.desc("source_count"), F.desc("score"), "best_position", "name", "merge_key").limit(limit) if limit else m


def category_score(title: Column, key: str) -> Column:
    """How well a page title fits a category; null if it doesn't."""
    name, words = CATEGORIES.get(key, CATEGORIES["mixed"])
    t = text.compact(title)
    hot = text.keyword_hits(t, HOT)
    if name == CATEGORIES["mixed"][0]:
        return F.when(hot > 0, 20 + hot * 8).otherwise(1)
    if key == "rank":
        return F.when(hot > 0, 30 + hot * 8)
    return F.when(F.contains(t, F.lit(name)) | (text.keyword_hits(t, words) > 0), 20 + hot * 8 - text.keyword_hits(t, COLD) * 5)


def best_category(pages: DataFrame, key: str, group: str) -> DataFrame:
    """The best page of each source for a category: score, then the shorter title in bytes, then the last."""
    s = pages.withColumn("cat_score", category_score(F.col("title"), key)).filter("cat_score is not null")
    return s.groupBy(group).agg(F.max_by(F.struct("title", "cat_score"), F.struct("cat_score", -F.octet_length("title"), "pos")).alias("b")).select(group, "b.title", "b.cat_score")


def page(rows: DataFrame, order: list[Column], cursor: int, size: int) -> DataFrame:
    """Rows cursor .. cursor+size in an order, with next_cursor and has_more of the page.

    Only the first cursor+size+1 rows are sorted out, in each task and then once more.
    """
    top = rows.orderBy(*order).limit(cursor + size + 1)
    numbered = top.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    total = numbered.agg(F.count("*").alias("_t"))
    return numbered.join(F.broadcast(total)).filter((F.col("_n") > cursor) & (F.col("_n") <= cursor + size)).withColumns(
        {"next_cursor": F.least(F.col("_t"), F.lit(cursor + size)).cast("bigint"), "has_more": F.col("_t") > cursor + size}
    ).drop("_n", "_t")


def distinct_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key (U5, U6, W2): one pre-aggregated row per key moves, not a sorted group."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


def distinct_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")
