"""Queries of ranking, reading, display and knowledge beyond the single fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import urls
from folioflow.operators import knowledge, ranking, reading, sources_admin
from folioflow.plans._named import collector
from folioflow.plans.search import SCORED, SPACE, _hits
from folioflow.sources.tables import table

ALL, query = collector()


def _any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _shown(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({_trim(f'coalesce({x}, {chr(39) * 2})')}), '[·•・]', '.', 'g'), '[\t\n\x0b\f\r ]+', '', 'g')"


@query(f"WITH {SCORED} SELECT hit_id, score, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, coalesce(name, ''), coalesce(author, ''), coalesce(origin, ''), hit_id) AS rank FROM s")
def search_relevance_order(spark: SparkSession, d: str) -> DataFrame:
    return ranking.by_relevance(_hits(spark, d), F.col("query_text"), ["query_text"]).select("hit_id", "score", "rank")


@query("SELECT query_text, origin, book_url, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY hit_id) AS n FROM (SELECT query_text, origin, book_url, min(hit_id) AS hit_id FROM search_hits GROUP BY ALL)) WHERE n <= 50")
def search_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty distinct hits of every query: the limit is the feature."""
    return ranking.first_distinct(table(spark, d, "search_hits").select("query_text", "origin", "book_url", "hit_id"), ["query_text"], ["origin", "book_url"], "hit_id", 50)


_TARGET = f"regexp_replace(coalesce(name, ''), '{SPACE}', '', 'g') AS n, regexp_replace(regexp_replace(coalesce(author, ''), '{SPACE}', '', 'g'), '^(作者)?[：:]*', '') AS a"


@query(f"WITH h AS (SELECT DISTINCT origin, {_TARGET} FROM search_hits), s AS (SELECT shelf_id, origin, {_TARGET} FROM shelf_books) SELECT shelf_id, count(h.origin) FILTER (s.origin IS NULL OR h.origin != s.origin) AS sources FROM s LEFT JOIN h USING (n, a) GROUP BY shelf_id")
def sources_available(spark: SparkSession, d: str) -> DataFrame:
    """Sources other than its own that have a shelf's book."""
    targets = table(spark, d, "shelf_books").select("shelf_id", "name", "author", "origin")
    return ranking.available(table(spark, d, "search_hits").select("name", "author", "origin"), targets).select("shelf_id", "sources")


@query("""
    WITH s AS (SELECT origin, min(origin_name) AS name, max(group_mask) AS groups FROM shelf_books GROUP BY 1)
    SELECT hit_id, coalesce(s.name, h.origin) AS origin_name, CAST(groups AS VARCHAR) AS origin_group FROM search_hits h LEFT JOIN s USING (origin)
""")
def hits_with_source(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "shelf_books").groupBy("origin").agg(F.min("origin_name").alias("name"), F.max("group_mask").cast("string").alias("groups"))
    hits = table(spark, d, "search_hits").select("hit_id", "origin", F.lit(None).cast("string").alias("origin_name"))
    return ranking.with_source(hits, sources).select("hit_id", "origin_name", "origin_group")


_SOURCES = "s AS (SELECT origin, coalesce(min(origin_name), '') AS name, min(group_mask) AS custom_order, max(loaded_at) AS newest FROM shelf_books GROUP BY 1)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shelf_books").groupBy("origin").agg(F.coalesce(F.min("origin_name"), F.lit("")).alias("name"), F.min("group_mask").alias("custom_order"), F.max("loaded_at").alias("newest"))


@query(f"WITH {_SOURCES} SELECT origin, row_number() OVER (ORDER BY coalesce(custom_order, 0), name, origin) AS rank FROM s")
def source_options(spark: SparkSession, d: str) -> DataFrame:
    return ranking.source_options(_sources(spark, d), collation=None).select("origin", "rank")


@query()
def source_options_by_language(spark: SparkSession, d: str) -> DataFrame:
    return ranking.source_options(_sources(spark, d)).select("origin", "rank")


@query(f"WITH {_SOURCES} SELECT origin, row_number() OVER (ORDER BY newest DESC, origin) AS rank FROM s")
def sources_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranks(_sources(spark, d), [], [F.desc("newest"), F.col("origin")]).select("origin", "rank")


@query("SELECT chapter_id FROM (SELECT chapter_id, row_number() OVER (PARTITION BY user_ns, book_url ORDER BY chapter_index, chapter_id) AS n FROM txt_chapters WHERE chapter_index >= 3) WHERE n <= 5")
def chapters_from_position(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "txt_chapters").filter("chapter_index >= 3").select("chapter_id", "user_ns", "book_url", "chapter_index")
    return ranking.ranks(c, ["user_ns", "book_url"], [F.col("chapter_index"), F.col("chapter_id")], "n").filter("n <= 5").select("chapter_id")


@query("""
    SELECT user_ns, CAST(sum(coalesce(dur_chapter_pos, 0)) AS BIGINT) AS total_seconds, count(DISTINCT book_url) AS opened_books, count(DISTINCT CASE WHEN book_url IS NOT NULL AND dur_chapter_index IS NOT NULL THEN book_url || '#' || dur_chapter_index END) AS read_chapters,
           count(DISTINCT CASE WHEN total_chapter_num > 0 AND dur_chapter_index >= total_chapter_num - 1 THEN book_url END) AS completed_books FROM shelf_books GROUP BY 1
""")
def reading_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reading.statistics(table(spark, d, "shelf_books"))


@query("SELECT count(*) AS total, count(*) FILTER (coalesce(is_successful, false)) AS available, count(*) FILTER (NOT coalesce(is_successful, false)) AS failed, count(DISTINCT response_id // 100) AS batches FROM fetch_responses")
def batch_test_totals(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce("is_successful", F.lit(False))
    total = reading.merged_totals(reading.batch_totals(table(spark, d, "fetch_responses"), ok, F.expr("response_id div 100")))
    return total.select(*[F.col(c).cast("bigint").alias(c) for c in total.columns])


@query("""
    WITH b AS (SELECT user_ns, book_url, arg_max({'name': name, 'i': dur_chapter_index}, {'t': dur_chapter_time, 's': shelf_id}) AS b FROM shelf_books GROUP BY 1, 2), c AS (SELECT book_url, count(*) AS n, max(updated_at) AS newest FROM chapter_cache GROUP BY 1)
    SELECT user_ns, book_url, b.name AS name, b.i AS dur_chapter_index, coalesce(n, 0) AS cached_chapters, newest AS cached_at FROM b LEFT JOIN c USING (book_url)
""")
def recent_with_cache(spark: SparkSession, d: str) -> DataFrame:
    return reading.recent(table(spark, d, "shelf_books"), table(spark, d, "chapter_cache"))


@query("""
    WITH w AS (SELECT DISTINCT book_url FROM search_hits), s AS (SELECT book_url, max(kind) AS v FROM shelf_books GROUP BY 1), l AS (SELECT book_url, max(chapter_title) AS v FROM chapter_cache GROUP BY 1)
    SELECT book_url, coalesce(s.v, l.v) AS v, CASE WHEN s.v IS NOT NULL THEN 'store' WHEN l.v IS NOT NULL THEN 'legacy' ELSE 'none' END AS place FROM w LEFT JOIN s USING (book_url) LEFT JOIN l USING (book_url)
""")
def document_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "shelf_books").groupBy("book_url").agg(F.max("kind").alias("v"))
    two = table(spark, d, "chapter_cache").groupBy("book_url").agg(F.max("chapter_title").alias("v"))
    return reading.with_fallback(table(spark, d, "search_hits").select("book_url").distinct(), one, two, ["book_url"], "v")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'reader' END AS app, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN '[1]' ELSE '[]' END AS books FROM nation")
def backup_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    raw = F.when(k == 0, F.lit('{"bookshelf":{"books":[2]}}')).when(k == 1, F.lit('{"version":1,"bookshelf":{"books":[1]}}')).otherwise(F.lit('{"version":2,"bookshelf":{}}'))
    return table(spark, d, "nation").select("n_nationkey", reading.backup(raw).alias("b")).select("n_nationkey", "b.app", "b.books")


@query("""
    WITH c AS (SELECT user_ns, book_url, chapter_index, arg_max({'t': title, 'n': length(content)}, chapter_id) AS c FROM txt_chapters GROUP BY 1, 2, 3)
    SELECT user_ns, book_url, '本地导入' AS author, '本地TXT' AS kind, count(*) AS total_chapter_num, arg_max(c.t, chapter_index) AS latest_chapter_title, coalesce(CAST(sum(c.n) AS BIGINT), 0) || '字' AS word_count FROM c GROUP BY 1, 2
""")
def imported_text_books(spark: SparkSession, d: str) -> DataFrame:
    return reading.imported_books(table(spark, d, "txt_chapters"))


@query("SELECT c_custkey, '' AS c_name, coalesce(c_name, '') != '' AS has_c_name FROM customer")
def secrets_masked(spark: SparkSession, d: str) -> DataFrame:
    return reading.masked(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"])


@query("SELECT coalesce(name, '') || '_' || coalesce(author, '') AS bookmark, max(shelf_id) AS shelf_id FROM shelf_books GROUP BY 1")
def bookmarks_one_a_book(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shelf_books").groupBy(reading.bookmark_key(F.col("name"), F.col("author")).alias("bookmark")).agg(F.max("shelf_id").alias("shelf_id"))


@query(r"""
    SELECT response_id, md5(CASE WHEN body IS NULL OR regexp_matches(lower(body), '<html|<body|<head|<form|搜索|首页|广告拦截器') THEN ''
        ELSE trim(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?is)<noscript.*?</noscript>', '', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END) AS digest FROM fetch_responses
""")
def feed_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_responses").select("response_id", F.md5(reading.feed_text(F.col("body"))).alias("digest"))


@query(r"""
    WITH e AS (SELECT hit_id, lower(nullif(regexp_extract(cover_url, '^[^?#]*\.([^?#.]{1,8})(?:[?#].*)?$', 1), '')) AS ending FROM search_hits)
    SELECT hit_id, ending, CASE ending WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' WHEN 'gif' THEN 'image/gif' WHEN 'bmp' THEN 'image/bmp' WHEN 'svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS type FROM e
""")
def content_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", urls.ending(F.col("cover_url")).alias("ending"), urls.content_type(F.col("cover_url")).alias("type"))


_K = knowledge
_WORDS = "', '".join(_K.SMALL_RELATIONS)


@query(rf"""
    WITH s AS (SELECT summary_id, {_trim("coalesce(summary, '')")} AS text, coalesce(array_to_string(key_points, chr(10)), '') || chr(10) || coalesce(summary, '') AS digest FROM chapter_summaries),
         w AS (SELECT summary_id, unnest(list_distinct(string_split_regex((SELECT summary FROM chapter_summaries c WHERE c.summary_id = s.summary_id), '[\t\n\x0b\f\r ，。！？；：、“”‘’（）()《》<>\-]'))) AS name FROM s),
         n AS (SELECT DISTINCT summary_id FROM w WHERE length(name) >= 2 AND NOT regexp_matches(name, '[0-9]') AND name NOT IN (SELECT name FROM shelf_books WHERE name IS NOT NULL))
    SELECT s.summary_id, CASE WHEN text = '' THEN false WHEN {_any("digest", _K.PATCH_WORDS)} OR contains(text, '→') OR {_any("text", _K.GUARD_WORDS)} THEN true ELSE n.summary_id IS NOT NULL END AS patch FROM s LEFT JOIN n ON n.summary_id = s.summary_id
""")
def patch_needed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chapter_summaries").select("summary_id", F.lit(False).alias("flagged"), "summary", "key_points", F.col("summary").alias("text"))
    return knowledge.needs_patch(rows, table(spark, d, "shelf_books").select("name").filter("name is not null"), "summary_id").select("summary_id", "patch")


_RELATED = "CASE hit_id % 4 WHEN 0 THEN '认识' WHEN 1 THEN ' 同校 ' WHEN 2 THEN '师徒' ELSE kind END AS relation, CASE WHEN hit_id % 7 = 0 THEN 'broken' END AS status, CAST(hit_id % 3 AS INTEGER) AS rank"


@query(rf"WITH r AS (SELECT hit_id, intro AS description, {_RELATED} FROM search_hits) SELECT hit_id FROM r WHERE coalesce(status, '') != 'broken' AND NOT (rank < 2 AND {_shown('relation')} IN ('{_WORDS}') AND length({_shown('description')}) < 18)")
def relations_shown(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("hit_id") % 4
    relation = F.when(k == 0, "认识").when(k == 1, " 同校 ").when(k == 2, "师徒").otherwise(F.col("kind"))
    r = table(spark, d, "search_hits").select("hit_id", F.col("intro").alias("description"), relation.alias("relation"), F.when(F.col("hit_id") % 7 == 0, "broken").alias("status"), (F.col("hit_id") % 3).cast("int").alias("rank"))
    return knowledge.visible(r).select("hit_id")


@query(rf"SELECT shelf_id FROM shelf_books WHERE contains(regexp_replace(lower({_trim("concat_ws(' ', nullif(name, ''), nullif(author, ''), nullif(kind, ''))")}), '[\t\n\x0b\f\r ]+', '', 'g'), 'the')")
def characters_by_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shelf_books").filter(knowledge.free_text([F.col("name"), F.col("author"), F.col("kind")], " T he")).select("shelf_id")


def _place_sql() -> str:
    given = " ".join(f"WHEN key IN ({', '.join(repr(w) for w in words)}) THEN '{k}'" for k, words in _K.PLACE_KINDS.items())
    named = " ".join(f"WHEN {_any('name', words)} THEN '{k}'" for k, words in _K.PLACE_NAMES.items())
    return rf"""
        WITH p AS (SELECT hit_id, coalesce(name, '') AS name, CASE hit_id % 5 WHEN 0 THEN 'Secret_Realm' WHEN 1 THEN ' unknown ' WHEN 2 THEN kind WHEN 3 THEN 'floor' END AS kind FROM search_hits),
             r AS (SELECT *, CASE WHEN lower({_trim('kind')}) NOT IN ('', 'unknown') THEN {_trim('kind')} END AS raw FROM p), k AS (SELECT *, regexp_replace(lower(raw), '[_-]', ' ', 'g') AS key FROM r)
        SELECT hit_id, CASE {given} WHEN regexp_matches(raw, '[\x{{4e00}}-\x{{9fff}}]') THEN raw {named} ELSE '{_K.OTHER_PLACE}' END AS place_kind FROM k
    """


@query(_place_sql())
def place_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("hit_id") % 5
    kind = F.when(k == 0, "Secret_Realm").when(k == 1, " unknown ").when(k == 2, F.col("kind")).when(k == 3, "floor")
    return table(spark, d, "search_hits").select("hit_id", knowledge.place_kind(kind, F.coalesce("name", F.lit(""))).alias("place_kind"))


def _notes_sql() -> str:
    inferred = " ".join(f"WHEN {_any('x', words)} THEN '{k}'" for k, words in _K.NOTE_WORDS.items())
    place = " ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(_K.NOTE_ORDER))
    flat = _shown("concat_ws(' ', nullif(title, ''), nullif(content, ''))")
    return rf"""
        WITH n AS (SELECT hit_id AS note_id, name AS title, intro AS content, CASE WHEN hit_id % 6 = 0 THEN ' 当前事件 ' WHEN hit_id % 6 = 1 THEN kind END AS category, CASE WHEN hit_id % 5 = 0 THEN ' 低 重要性' END AS importance FROM search_hits),
             i AS (SELECT *, {flat} AS x, {_trim("coalesce(category, '')")} AS given FROM n WHERE NOT {_any(_shown('importance'), _K.UNIMPORTANT)}),
             c AS (SELECT note_id, title, CASE WHEN given != '' THEN given {inferred} ELSE '{_K.NOTE_ORDER[0]}' END AS category, {_shown('title')} AS t FROM i)
        SELECT category, min(note_id) AS note_id, arg_min(title, note_id) AS title, CASE category {place} ELSE 999 END AS place FROM c GROUP BY category, t
    """


@query(_notes_sql())
def note_groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("hit_id") % 6
    notes = table(spark, d, "search_hits").select(F.col("hit_id").alias("note_id"), F.col("name").alias("title"), F.col("intro").alias("content"), F.when(k == 0, " 当前事件 ").when(k == 1, F.col("kind")).alias("category"), F.when(F.col("hit_id") % 5 == 0, " 低 重要性").alias("importance"))
    return knowledge.note_groups(notes)


@query("SELECT s_nationkey AS target, arg_min(s_suppkey, s_suppkey) AS parent FROM supplier WHERE s_suppkey % 3 != 0 GROUP BY 1")
def place_parents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target"), F.when(F.col("s_suppkey") % 3 != 0, "contains").otherwise("adjacent").alias("kind"), F.col("s_suppkey").alias("ord"))
    return knowledge.place_parents(e)


_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+', ''), '-+$', '')"


@query(rf"WITH l AS (SELECT {_KEY} AS k, arg_max(dur_chapter_index, shelf_id) AS chapter FROM shelf_books WHERE dur_chapter_index IS NOT NULL AND name IS NOT NULL GROUP BY 1) SELECT hit_id, l.chapter FROM (SELECT hit_id, {_KEY} AS k FROM search_hits) h LEFT JOIN l USING (k)")
def people_with_states(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "shelf_books").filter("dur_chapter_index is not null and name is not null").select("name", F.col("shelf_id").alias("ord"), F.col("dur_chapter_index").alias("chapter"))
    return knowledge.with_states(table(spark, d, "search_hits").select("hit_id", "name"), states, ["chapter"]).select("hit_id", "chapter")


@query("SELECT user_ns, book_url, chapter_index, chapter_title, '' AS quote, CAST(force_flag AS VARCHAR) AS note, min(request_id) AS request_id FROM summary_requests GROUP BY ALL")
def evidence_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "summary_requests").select("user_ns", "book_url", "chapter_index", "chapter_title", F.lit(None).cast("string").alias("quote"), F.col("force_flag").cast("string").alias("note"), "request_id")
    return knowledge.distinct_evidence(e, ["user_ns", "book_url"], "request_id")


@query("""
    SELECT user_ns, book_url, chapter_url, arg_min(chapter_title, summary_id) FILTER (chapter_title IS NOT NULL) AS chapter_title, arg_max(model_name, summary_id) FILTER (model_name IS NOT NULL) AS model_name,
           arg_max(summary, {'n': length(summary), 'i': -summary_id}) FILTER (summary IS NOT NULL) AS summary, max(updated_at) AS updated_at FROM chapter_summaries GROUP BY 1, 2, 3
""")
def folded_summaries(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.folded(table(spark, d, "chapter_summaries"), ["user_ns", "book_url", "chapter_url"], "summary_id", {"chapter_title": "first", "model_name": "last", "summary": "longest", "updated_at": "most"})


_BONDS = """b AS (SELECT l_suppkey % 50 AS pair, l_orderkey * 8 + l_linenumber AS ord, CASE CAST(l_quantity AS BIGINT) % 10 WHEN 1 THEN 'alliance' WHEN 2 THEN 'affiliation' WHEN 3 THEN 'rivalry' ELSE 'other' END AS kind, CASE WHEN l_tax > 0.07 AND l_suppkey % 2 = 0 THEN 'negative' END AS polarity,
             CASE l_returnflag WHEN 'A' THEN 'strong' WHEN 'N' THEN 'weak' END AS strength, CASE WHEN CAST(l_quantity AS BIGINT) % 9 = 0 THEN '' ELSE 'q' || CAST(l_quantity AS BIGINT) % 9 END AS label FROM lineitem WHERE l_suppkey % 50 < 40 OR CAST(l_quantity AS BIGINT) % 10 != 3)"""


@query(f"""
    WITH {_BONDS}, l AS (SELECT pair, label, min(ord) AS o FROM b WHERE label != '' GROUP BY 1, 2), t AS (SELECT pair, array_to_string(list_slice(list(label ORDER BY o), 1, 3), ' / ') AS label FROM l GROUP BY 1)
    SELECT pair, CASE WHEN bool_or(kind IN ('conflict', 'rivalry') OR coalesce(polarity = 'negative', false)) THEN 'conflict' WHEN bool_or(kind IN ('alliance', 'friendship')) THEN 'ally' WHEN bool_or(kind = 'affiliation') THEN 'affiliation' ELSE 'neutral' END AS tone,
           CASE max(CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END) WHEN 3 THEN 'strong' WHEN 2 THEN 'moderate' WHEN 1 THEN 'weak' ELSE 'unknown' END AS strength, any_value(t.label) AS label FROM b JOIN t USING (pair) GROUP BY pair
""")
def pair_tones(spark: SparkSession, d: str) -> DataFrame:
    q = F.rint("l_quantity").cast("bigint")  # a cast in SQL rounds, half to even
    l = table(spark, d, "lineitem").filter((F.col("l_suppkey") % 50 < 40) | (q % 10 != 3))
    kind = F.when(q % 10 == 1, "alliance").when(q % 10 == 2, "affiliation").when(q % 10 == 3, "rivalry").otherwise("other")
    label = F.when(q % 9 == 0, "").otherwise(F.concat(F.lit("q"), (q % 9).cast("string")))
    b = l.select((F.col("l_suppkey") % 50).alias("pair"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), kind.alias("kind"), F.when((F.col("l_tax") > 0.07) & (F.col("l_suppkey") % 2 == 0), "negative").alias("polarity"), F.when(F.col("l_returnflag") == "A", "strong").when(F.col("l_returnflag") == "N", "weak").alias("strength"), label.alias("label"))
    return knowledge.pair_tone(b.filter("pair is not null"), ["pair"], "ord").filter("label != ''")


@query("SELECT user_ns, book_url, chapter_url, summary_id, lag(prompt_version) OVER w AS previous_prompt_version, prompt_version AS next_prompt_version FROM chapter_summaries WINDOW w AS (PARTITION BY user_ns, book_url, chapter_url ORDER BY summary_id)")
def change_history(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.changes(table(spark, d, "chapter_summaries"), ["user_ns", "book_url", "chapter_url"], "summary_id", ["prompt_version"])


@query("SELECT request_id, CASE WHEN coalesce(chapter_title, '') != '' AND chapter_index IS NOT NULL THEN chapter_title END AS title, CASE WHEN coalesce(chapter_title, '') != '' THEN chapter_index END AS idx FROM summary_requests")
def chapter_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = knowledge.chapter_evidence(F.col("chapter_title"), F.col("chapter_index"), F.lit("n"))
    return table(spark, d, "summary_requests").select("request_id", F.get(e, F.lit(0)).alias("e")).select("request_id", F.col("e.chapter_title").alias("title"), F.col("e.chapter_index").alias("idx"))


@query("SELECT hit_id, CASE WHEN hit_id % 3 != 0 THEN name END AS name, CASE WHEN hit_id % 3 != 0 THEN kind END AS kind FROM search_hits")
def relation_meta_back(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("hit_id") % 3 == 0, F.col("intro")).otherwise(knowledge.with_meta(["name", "kind"]))
    return table(spark, d, "search_hits").select("hit_id", knowledge.meta_of(text, "name string, kind string").alias("m")).select("hit_id", "m.name", "m.kind")


def _renames() -> str:
    seen, rows = set(), []
    for group, names in sources_admin.OLDER_RULES.items():
        for old, new in names.items():
            if (group, new) not in seen and old not in {r[0] for r in rows}:
                seen.add((group, new))
                rows.append((old, group, new))
    return ", ".join(f"('{o}', '{g}', '{n}')" for o, g, n in rows)


@query(f"SELECT origin, r.g AS rule_group, r.n AS field, r.o || '@' || origin AS rule FROM (SELECT DISTINCT origin FROM search_hits WHERE origin IS NOT NULL) s, (VALUES {_renames()}) r(o, g, n)")
def source_migration_renames(spark: SparkSession, d: str) -> DataFrame:
    """Older definitions of every source with every older rule name, brought into groups."""
    names = list(dict.fromkeys(o for group in sources_admin.OLDER_RULES.values() for o in group))
    origins = table(spark, d, "search_hits").select("origin").filter("origin is not null").distinct()
    flat = origins.select("origin", F.to_json(F.struct(*[F.concat(F.lit(f"{n}@"), F.col("origin")).alias(n) for n in names])).alias("item"))
    m = sources_admin.migrate(flat)
    groups = F.array(*[F.struct(F.lit(g).alias("rule_group"), F.from_json(F.get_json_object("item", f"$.{g}"), "map<string,string>").alias("r")) for g in sources_admin.OLDER_RULES])
    return m.select("origin", F.inline(groups)).select("origin", "rule_group", F.explode("r").alias("field", "rule"))
