"""Queries of keyed storage, caches and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import aggregates, joins, store
from folioflow.plans._named import collector
from folioflow.sources.tables import table

ALL, query = collector()
SPLIT = "TIMESTAMPTZ '2025-07-01 00:00:00+00'"


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table as it stood at a moment, and what came later."""
    then = F.expr("timestamp '2025-07-01T00:00:00Z'")
    return df.filter(F.col("loaded_at") < then), df.filter(~(F.col("loaded_at") < then))


@query("SELECT user_ns, book_url, arg_max(shelf_id, (loaded_at, shelf_id)) AS shelf_id, arg_max(name, (loaded_at, shelf_id)) AS name FROM shelf_books GROUP BY 1, 2")
def shelf_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "shelf_books").select("user_ns", "book_url", "shelf_id", "name", "loaded_at")
    return store.latest(rows, ["user_ns", "book_url"], F.struct("loaded_at", "shelf_id")).select("user_ns", "book_url", "shelf_id", "name")


@query("""
    SELECT user_ns, book_url, coalesce(dur_chapter_time, 0) AS t, dur_chapter_index AS i, dur_chapter_pos AS p
    FROM shelf_books QUALIFY row_number() OVER (PARTITION BY user_ns, book_url ORDER BY coalesce(dur_chapter_time, 0) DESC, shelf_id DESC) = 1
""")
def progress_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    p = store.newest_progress(table(spark, d, "shelf_books"), ["user_ns", "book_url"], "dur_chapter_time", ["dur_chapter_index", "dur_chapter_pos"], "shelf_id")
    return p.select("user_ns", "book_url", F.coalesce("dur_chapter_time", F.lit(0)).alias("t"), F.col("dur_chapter_index").alias("i"), F.col("dur_chapter_pos").alias("p"))


@query("""
    SELECT shelf_id, coalesce(group_mask, 0) = 0 AS ungrouped, (coalesce(group_mask, 0) & 2) != 0 AS in_two, coalesce(group_mask, 0) | 4 AS with_four, coalesce(group_mask, 0) & ~1 AS without_one FROM shelf_books
""")
def group_bitmask(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("group_mask")
    return table(spark, d, "shelf_books").select("shelf_id", store.in_group(m, 0).alias("ungrouped"), store.in_group(m, 2).alias("in_two"), store.with_group(m, 4).cast("bigint").alias("with_four"), store.without_group(m, 1).cast("bigint").alias("without_one"))


@query(f"""
    WITH o AS (SELECT user_ns, book_url, min(ord) AS ord FROM shelf_books WHERE loaded_at < {SPLIT} GROUP BY 1, 2),
         n AS (SELECT user_ns, book_url, min(ord) AS ord FROM shelf_books WHERE NOT loaded_at < {SPLIT} GROUP BY 1, 2),
         m AS (SELECT coalesce(max(ord), -1) AS m FROM o)
    SELECT user_ns, book_url, ord AS pos FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_ns = o.user_ns AND n.book_url = o.book_url)
    UNION ALL SELECT n.user_ns, n.book_url, coalesce(o.ord, m.m + 1 + n.ord) FROM n LEFT JOIN o ON n.user_ns = o.user_ns AND n.book_url = o.book_url CROSS JOIN m
""")
def list_upsert_keep_place(spark: SparkSession, d: str) -> DataFrame:
    keys = ["user_ns", "book_url"]
    old, new = (x.groupBy(*keys).agg(F.min("ord").alias("pos")) for x in _split(table(spark, d, "shelf_books")))
    return store.upsert_keeping_place(old, new, keys)


@query("SELECT shelf_id FROM shelf_books s WHERE NOT EXISTS (SELECT 1 FROM search_hits h WHERE h.book_url = s.book_url AND h.kind IS NULL)")
def delete_anti(spark: SparkSession, d: str) -> DataFrame:
    return store.delete(table(spark, d, "shelf_books"), table(spark, d, "search_hits").filter("kind is null"), ["book_url"]).select("shelf_id")


@query(f"""
    WITH g AS (SELECT * FROM shelf_books WHERE NOT loaded_at < {SPLIT}), r AS (SELECT * FROM shelf_books WHERE loaded_at < {SPLIT})
    SELECT shelf_id FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.book_url = r.book_url)
      AND (charset IS NOT NULL OR NOT EXISTS (SELECT 1 FROM g WHERE g.name = r.name AND g.author = r.author))
""")
def delete_either_key(spark: SparkSession, d: str) -> DataFrame:
    old, new = _split(table(spark, d, "shelf_books"))
    return store.delete_either(old, new, ["book_url"], ["name", "author"], F.col("charset").isNotNull()).select("shelf_id")


@query("SELECT s.shelf_id, coalesce(s.kind, k.kind) AS kind, coalesce(s.charset, k.charset) AS charset FROM shelf_books s LEFT JOIN (SELECT book_url, max(kind) AS kind, max(charset) AS charset FROM shelf_books GROUP BY 1) k USING (book_url)")
def fill_from_existing(spark: SparkSession, d: str) -> DataFrame:
    shelf = table(spark, d, "shelf_books")
    known = shelf.groupBy("book_url").agg(F.max("kind").alias("kind"), F.max("charset").alias("charset"))
    return store.filled(shelf.select("shelf_id", "book_url", "kind", "charset"), known, ["book_url"], ["kind", "charset"]).select("shelf_id", "kind", "charset")


@query("SELECT b.book_url, count(DISTINCT c.chapter_url) AS cached_chapters FROM (SELECT DISTINCT book_url FROM shelf_books UNION SELECT DISTINCT book_url FROM chapter_cache) b LEFT JOIN chapter_cache c USING (book_url) GROUP BY 1")
def cache_count_left(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "chapter_cache")
    books = table(spark, d, "shelf_books").select("book_url").union(cache.select("book_url")).distinct()
    return joins.cached_counts(books, cache)


@query("SELECT request_id FROM summary_requests r WHERE EXISTS (SELECT 1 FROM chapter_summaries s WHERE s.user_ns = r.user_ns AND s.book_url = r.book_url AND s.chapter_url = r.chapter_url)")
def cached_semi(spark: SparkSession, d: str) -> DataFrame:
    return joins.with_cache(table(spark, d, "summary_requests"), table(spark, d, "chapter_summaries"), ["user_ns", "book_url", "chapter_url"]).select("request_id")


@query("SELECT request_id FROM summary_requests r WHERE NOT EXISTS (SELECT 1 FROM chapter_summaries s WHERE s.user_ns = r.user_ns AND s.book_url = r.book_url AND s.chapter_url = r.chapter_url)")
def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    return joins.without_cache(table(spark, d, "summary_requests"), table(spark, d, "chapter_summaries"), ["user_ns", "book_url", "chapter_url"]).select("request_id")


@query("""
    WITH b AS (SELECT book_url, min(cache_id) AS pos FROM chapter_cache GROUP BY 1), l AS (SELECT DISTINCT chapter_url FROM chapter_cache)
    SELECT chapter_url, arg_min(book_url, (pos, book_url)) AS book_url FROM l JOIN b ON chapter_url = book_url OR starts_with(chapter_url, book_url || '/') GROUP BY 1
""")
def prefix_first(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "chapter_cache")
    return joins.by_prefix(cache, cache.groupBy("book_url").agg(F.min("cache_id").alias("pos")))


@query(r"""
    WITH l AS (SELECT DISTINCT regexp_extract(url, '^([^/]*//[^/]*)', 1) AS book_url FROM fetch_responses), s AS (SELECT DISTINCT origin AS source_url FROM search_hits),
         x AS (SELECT book_url, source_url, regexp_extract(book_url, '//([^/:]+)', 1) AS h, regexp_extract(source_url, '//([^/:]+)', 1) AS g FROM l, s)
    SELECT book_url, source_url FROM x WHERE h = g OR ends_with(h, '.' || g) OR ends_with(g, '.' || h) OR string_split(h, '.')[-2] = string_split(g, '.')[-2]
""")
def domain_match(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "fetch_responses").select(F.regexp_extract("url", "^([^/]*//[^/]*)", 1).alias("book_url")).distinct()
    return joins.by_domain(links, table(spark, d, "search_hits").select(F.col("origin").alias("source_url")).distinct())


@query("SELECT book_url, count(*) AS chapters, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(updated_at) AS updated_at FROM chapter_cache GROUP BY 1")
def cache_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.cache_summary(table(spark, d, "chapter_cache"))


@query("SELECT status, count(*) AS n FROM fetch_responses GROUP BY 1")
def count_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_by(table(spark, d, "fetch_responses"), "status")


@query("SELECT content_type, string_agg(status || ':' || n, ' ' ORDER BY status) AS counts FROM (SELECT content_type, status, count(*) AS n FROM fetch_responses GROUP BY 1, 2) GROUP BY 1")
def sorted_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    c = aggregates.sorted_counts(table(spark, d, "fetch_responses"), "status", ["content_type"])
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return c.select("content_type", F.array_join(pairs, " ").alias("counts"))


@query("SELECT origin, count(*) AS total, count(*) FILTER (author IS NULL) AS no_author, count(*) FILTER (intro IS NOT NULL) AS with_intro FROM search_hits GROUP BY 1")
def stats_count_if(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.flags(table(spark, d, "search_hits"), ["origin"], no_author=F.col("author").isNull(), with_intro=F.col("intro").isNotNull())


@query(r"SELECT DISTINCT trim(g, ' ') AS name FROM (SELECT unnest(string_split_regex(coalesce(kind, '') || ';' || coalesce(origin, ''), '[,;；、]')) AS g FROM search_hits) WHERE trim(g, ' ') != ''")
def group_names_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_hits").select(F.concat_ws(";", F.coalesce("kind", F.lit("")), F.coalesce("origin", F.lit(""))).alias("groups"))
    return aggregates.distinct_group_names(rows, "groups")


@query("SELECT event_id, ts + INTERVAL 604800 SECONDS AS expires_at FROM events WHERE ts + INTERVAL 604800 SECONDS > (SELECT max(ts) FROM events)")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    return store.live_sessions(events.join(F.broadcast(now)), F.col("now"), seen="ts").select("event_id", "expires_at")


@query("""
    WITH u AS (SELECT user_ns FROM shelf_books ORDER BY shelf_id LIMIT 1), n AS (SELECT book_url, max(shelf_id) AS shelf_id, user_ns FROM shelf_books GROUP BY book_url, user_ns)
    SELECT user_ns, book_url, shelf_id FROM n WHERE user_ns != 'copied' UNION ALL SELECT 'copied', book_url, shelf_id FROM n WHERE user_ns = (SELECT user_ns FROM u)
""")
def namespace_copy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "shelf_books").groupBy("book_url", "user_ns").agg(F.max("shelf_id").alias("shelf_id"))
    owner = table(spark, d, "shelf_books").orderBy("shelf_id").select("user_ns").first()["user_ns"]
    return store.copy_namespace(rows, owner, "copied", ["book_url"])


@query("""
    WITH m AS (SELECT user_ns, book_url, max(chapter_index) AS i FROM summary_requests GROUP BY 1, 2), t AS (SELECT user_ns, book_url, chapter_index AS i, max(chapter_title) AS t FROM summary_requests GROUP BY 1, 2, 3), s AS (SELECT user_ns, book_url, max(shelf_id) AS shelf_id, max(dur_chapter_index) AS i, max(dur_chapter_title) AS t FROM shelf_books GROUP BY 1, 2)
    SELECT s.shelf_id, coalesce(m.i, s.i) AS dur_chapter_index, CASE WHEN m.i IS NULL THEN s.t ELSE coalesce(t.t, s.t) END AS dur_chapter_title FROM s LEFT JOIN m USING (user_ns, book_url) LEFT JOIN t ON t.user_ns = s.user_ns AND t.book_url = s.book_url AND t.i = m.i
""")
def progress_update(spark: SparkSession, d: str) -> DataFrame:
    """Every shelf row moved to the last chapter its user asked for."""
    keys = ["user_ns", "book_url"]
    r = table(spark, d, "summary_requests")
    moves = r.groupBy(*keys).agg(F.max("chapter_index").alias("chapter_index")).withColumn("chapter_pos", F.lit(0))
    titles = r.groupBy(*keys, "chapter_index").agg(F.max("chapter_title").alias("title"))
    shelf = table(spark, d, "shelf_books").groupBy(*keys).agg(F.max("shelf_id").alias("shelf_id"), F.max("dur_chapter_index").alias("dur_chapter_index"), F.max("dur_chapter_pos").alias("dur_chapter_pos"), F.max("dur_chapter_time").alias("dur_chapter_time"), F.max("dur_chapter_title").alias("dur_chapter_title"))
    return store.with_progress(shelf, moves, titles, keys, F.lit(0)).select("shelf_id", "dur_chapter_index", "dur_chapter_title")
