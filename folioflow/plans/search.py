"""Queries of federated search, ranking, paging and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import search
from folioflow.plans._named import collector
from folioflow.sources.tables import table

ALL, query = collector()

SPACE = r"[\t-\r\x{85}\p{Z}]"


def _norm(x: str) -> str:
    """search_text in SQL."""
    return f"lower(regexp_replace(translate({x}, '{text.SEARCH_PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '{SPACE}', '', 'g'))"


#: relevance and ordered count in SQL
SCORED = f"""
    n AS (SELECT hit_id, query_text, name, author, origin, {_norm('query_text')} AS q, {_norm("coalesce(name, '')")} AS t, {_norm("coalesce(author, '')")} AS a FROM search_hits),
    c AS (SELECT *, list_filter(string_split(q, ''), lambda c: c != '') AS qc FROM n),
    o AS (SELECT *, len(list_filter(qc, lambda c: contains(t, c))) AS common,
                 list_reduce(list_prepend({{'c': '', 'n': 0, 'at': 1}}, list_transform(qc, lambda c: {{'c': c, 'n': 0, 'at': 0}})),
                     lambda s, x: {{'c': '', 'n': s.n + CASE WHEN instr(substring(t, s.at), x.c) > 0 THEN 1 ELSE 0 END,
                                    'at': CASE WHEN instr(substring(t, s.at), x.c) > 0 THEN s.at + instr(substring(t, s.at), x.c) ELSE length(t) + 1 END}}).n AS ordered FROM c),
    b AS (SELECT *, CASE WHEN t = q THEN 10000 WHEN contains(t, q) THEN 8000 WHEN contains(q, t) AND length(t) >= 2 THEN 3000
                         WHEN length(q) >= 2 AND length(t) >= 2 AND left(q, 2) = left(t, 2) AND (common * 100) // greatest(length(q), 1) >= 75 THEN 4500 ELSE 0 END AS bonus,
                 CASE WHEN a = q THEN 1000 ELSE 0 END AS by_author FROM o),
    s AS (SELECT hit_id, query_text, name, author, origin, CAST(CASE WHEN q = '' THEN 0 ELSE common * 100 + ordered * 25 + bonus + by_author END AS INTEGER) AS score,
                 q = '' OR bonus > 0 OR by_author > 0 AS strong FROM b)
"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").withColumn("arrival", F.col("hit_id")).drop("ord").withColumnRenamed("arrival", "ord")


@query(f"WITH {SCORED} SELECT hit_id, score, strong FROM s")
def search_score(spark: SparkSession, d: str) -> DataFrame:
    return search.scored(_hits(spark, d), F.col("query_text")).select("hit_id", "score", "strong")


@query(f"WITH {SCORED} SELECT hit_id, query_text, score FROM s WHERE strong")
def search_rank_strict(spark: SparkSession, d: str) -> DataFrame:
    return search.strict(_hits(spark, d), F.col("query_text")).select("hit_id", "query_text", "score")


@query(f"WITH {SCORED} SELECT hit_id, score FROM s JOIN (SELECT query_text, bool_or(strong) AS any_strong FROM s GROUP BY 1) g USING (query_text) WHERE strong OR NOT any_strong")
def search_rank_soft(spark: SparkSession, d: str) -> DataFrame:
    return search.soft(_hits(spark, d), F.col("query_text"), ["query_text"]).select("hit_id", "score")


MERGE_KEY = r"lower(regexp_replace(coalesce(name, ''), '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g')) || '|' || lower(regexp_replace(coalesce(author, ''), '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g'))"
_FIRST = ", ".join(f"arg_min({c}, hit_id) FILTER ({c} IS NOT NULL) AS {c}" for c in search.OPTIONAL)


@query(f"""
    WITH h AS (SELECT *, {MERGE_KEY} AS merge_key FROM search_hits),
         o AS (SELECT merge_key, origin, min(hit_id) AS o FROM h GROUP BY 1, 2),
         u AS (SELECT merge_key, string_agg(origin, ' ' ORDER BY o) AS origins, count(*) AS sources FROM o GROUP BY 1)
    SELECT merge_key, min(hit_id) AS ord, arg_min(name, hit_id) AS name, arg_min(author, hit_id) FILTER (hit_id = first_id) AS author, arg_min(origin, hit_id) AS origin, {_FIRST}, any_value(origins) AS origins, any_value(sources) AS sources
    FROM h JOIN u USING (merge_key) JOIN (SELECT merge_key, min(hit_id) AS first_id FROM h GROUP BY 1) f USING (merge_key) GROUP BY merge_key
""")
def search_merge_entities(spark: SparkSession, d: str) -> DataFrame:
    m = search.merged(_hits(spark, d))
    return m.select("merge_key", "ord", "name", "author", "origin", *search.OPTIONAL, F.array_join("book_source_urls", " ").alias("origins"), F.size("book_source_urls").cast("bigint").alias("sources"))


@query(rf"""
    WITH h AS (SELECT *, {MERGE_KEY} AS merge_key, CAST(20 + hit_id % 40 AS INTEGER) AS cat FROM search_hits WHERE regexp_replace(coalesce(name, ''), '{SPACE}', '', 'g') != '')
    SELECT merge_key, count(*) AS source_count, min(ord) AS best_position, arg_min(name, hit_id) AS name,
           arg_min(cat + 100 - least(ord, 100), hit_id) + sum(cat + 20) - arg_min(cat + 20, hit_id) AS score
    FROM h GROUP BY 1
""")
def explore_merge(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").select("name", "author", F.col("ord").alias("position"), F.col("hit_id").alias("ord"), (20 + F.col("hit_id") % 40).cast("int").alias("category_score"))
    return search.explore_merged(hits).select("merge_key", "source_count", "best_position", "name", "score")


@query(rf"""
    WITH h AS (SELECT *, {MERGE_KEY} AS merge_key, CAST(20 + hit_id % 40 AS INTEGER) AS cat FROM search_hits WHERE regexp_replace(coalesce(name, ''), '{SPACE}', '', 'g') != ''),
         m AS (SELECT merge_key, count(*) AS source_count, min(ord) AS best_position, arg_min(name, hit_id) AS name,
                      arg_min(cat + 100 - least(ord, 100), hit_id) + sum(cat + 20) - arg_min(cat + 20, hit_id) AS score FROM h GROUP BY 1)
    SELECT merge_key, source_count, score FROM m ORDER BY source_count DESC, score DESC, best_position, name, merge_key LIMIT 20
""")
def explore_topk(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    hits = table(spark, d, "search_hits").select("name", "author", F.col("ord").alias("position"), F.col("hit_id").alias("ord"), (20 + F.col("hit_id") % 40).cast("int").alias("category_score"))
    return search.explore_merged(hits, limit=20).select("merge_key", "source_count", "score")


def _hit_count(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words) + ")"


_COMPACT = r"lower(regexp_replace(coalesce(kind, ''), '[\t-\r\x{85}\p{Z}·\-_|/\\]', '', 'g'))"


@query(f"""
    WITH p AS (SELECT origin, hit_id, coalesce(kind, '') AS title, {_COMPACT} AS t FROM search_hits),
         s AS (SELECT *, 20 + {_hit_count(search.HOT)} * 8 - {_hit_count(search.COLD)} * 5 AS cat_score FROM p WHERE contains(t, '玄幻') OR {_hit_count(search.CATEGORIES['fantasy'][1])} > 0)
    SELECT origin, arg_max(title, (cat_score, -strlen(title), hit_id)) AS title, CAST(max(cat_score) AS INTEGER) AS cat_score FROM s GROUP BY 1
""")
def explore_best_category(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "search_hits").select("origin", F.coalesce("kind", F.lit("")).alias("title"), F.col("hit_id").alias("pos"))
    return search.best_category(pages, "fantasy", "origin")


@query("""
    WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS total FROM events)
    SELECT event_id, CAST(least(total, 151, 150) AS BIGINT) AS next_cursor, total > 150 AS has_more FROM n WHERE n > 100 AND n <= 150
""")
def page_cursor(spark: SparkSession, d: str) -> DataFrame:
    """A page of 50 rows behind a cursor: the limit is the feature."""
    return search.page(table(spark, d, "events"), [F.asc("ts"), F.asc("event_id")], 100, 50).select("event_id", "next_cursor", "has_more")


@query("SELECT origin, book_url, min(hit_id) AS hit_id, arg_min(name, hit_id) AS name FROM search_hits GROUP BY 1, 2")
def hits_distinct_address(spark: SparkSession, d: str) -> DataFrame:
    return search.distinct_first(table(spark, d, "search_hits").select("origin", "book_url", "hit_id", "name"), ["origin", "book_url"], "hit_id")


@query("SELECT query_text, origin, max(hit_id) AS hit_id, arg_max(last_chapter, hit_id) FILTER (hit_id = m) AS last_chapter FROM (SELECT *, max(hit_id) OVER (PARTITION BY query_text, origin) AS m FROM search_hits) GROUP BY 1, 2")
def hits_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return search.distinct_last(table(spark, d, "search_hits").select("query_text", "origin", "hit_id", "last_chapter"), ["query_text", "origin"], "hit_id")


@query(r"""
    SELECT hit_id, regexp_replace(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+', ''), '-+$', '') AS key FROM search_hits
""")
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", text.canonical_key(F.col("name")).alias("key"))


@query(rf"""
    SELECT hit_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 80 AND NOT contains(t, chr(10)) THEN t ELSE t END AS last_line
    FROM (SELECT hit_id, regexp_replace(last_chapter, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM search_hits)
""")
def last_chapter_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", text.last_chapter(F.col("last_chapter")).alias("last_line"))


@query(r"""
    SELECT hit_id, string_split(regexp_extract(lower(book_url), '^[a-z][a-z0-9+.\-]*://([^/?#:]+)', 1), '.')[-2] AS root, regexp_extract(lower(book_url), '^[a-z][a-z0-9+.\-]*://([^/?#:]+)', 1) AS host FROM search_hits
""")
def url_root_domain(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.functions import urls

    return table(spark, d, "search_hits").select("hit_id", urls.root_domain(F.col("book_url")).alias("root"), urls.host(F.col("book_url")).alias("host"))
