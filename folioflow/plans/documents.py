"""Queries of the rule language, text functions and imports over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text, urls
from folioflow.operators import model_json, rewrite, sequence, sources_admin
from folioflow.plans._named import collector
from folioflow.rules import engine
from folioflow.sources import imports
from folioflow.sources.tables import table

ALL, query = collector()
SPACE = r"[\t-\r\x{85}\p{Z}]"
LINK = '<a href="([^"]+)">([^<]+)</a>'


@query(f"""
    WITH x AS (SELECT response_id, regexp_extract_all(body, '{LINK}', 1) AS u, regexp_extract_all(body, '{LINK}', 2) AS n FROM fetch_responses WHERE body IS NOT NULL)
    SELECT response_id, CAST(i - 1 AS INTEGER) AS pos, u[i] AS link, n[i] AS name FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM x)
""")
def rule_regex_links(spark: SparkSession, d: str) -> DataFrame:
    return engine.regex_list(table(spark, d, "fetch_responses"), LINK, "response_id", "body", {"link": "$1", "name": "$2"})


@query(f"""
    WITH x AS (SELECT response_id, regexp_extract_all(body, '{LINK}', 1) AS u FROM fetch_responses WHERE body IS NOT NULL), y AS (SELECT response_id, u[i] AS link, i FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM x))
    SELECT response_id, link, CAST(min(i) - 1 AS INTEGER) AS pos FROM y GROUP BY 1, 2
""")
def rule_links_first(spark: SparkSession, d: str) -> DataFrame:
    links = engine.regex_list(table(spark, d, "fetch_responses"), LINK, "response_id", "body", {"link": "$1"})
    return links.groupBy("response_id", "link").agg(F.min("pos").alias("pos"))


_LISTS = """x AS (SELECT response_id, regexp_extract_all(body, '<h4>([^<]*)</h4>', 1) AS a, regexp_extract_all(body, '<h3>([^<]*)</h3>', 1) AS b FROM fetch_responses WHERE body IS NOT NULL)"""


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return table(spark, d, "fetch_responses").filter(body.isNotNull()).select("response_id", F.regexp_extract_all(body, F.lit("<h4>([^<]*)</h4>"), 1).alias("a"), F.regexp_extract_all(body, F.lit("<h3>([^<]*)</h3>"), 1).alias("b"))


@query(f"WITH {_LISTS} SELECT response_id, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, '|') AS found FROM x")
def rule_first_nonempty(spark: SparkSession, d: str) -> DataFrame:
    return _two_lists(spark, d).select("response_id", F.array_join(sequence.first_nonempty(F.col("a"), F.col("b")), "|").alias("found"))


@query(f"WITH {_LISTS} SELECT response_id, array_to_string(list_concat(a, b), '|') AS found FROM x")
def rule_union_all(spark: SparkSession, d: str) -> DataFrame:
    return _two_lists(spark, d).select("response_id", F.array_join(F.concat("a", "b"), "|").alias("found"))


@query(f"WITH {_LISTS} SELECT response_id, array_to_string(list_filter(flatten(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: [a[i], b[i]])), lambda v: v IS NOT NULL), '|') AS found FROM x")
def rule_interleave(spark: SparkSession, d: str) -> DataFrame:
    return _two_lists(spark, d).select("response_id", F.array_join(sequence.interleave(F.col("a"), F.col("b")), "|").alias("found"))


@query(r"SELECT response_id, 0 AS pos, trim(replace(replace(replace(regexp_extract(body, '<h1>([^<]+)</h1>', 1), '&nbsp;', ' '), '&amp;', '&'), '&gt;', '>')) AS title FROM fetch_responses WHERE regexp_matches(body, '<body>[\s\S]*<h1>[^<]+</h1>[\s\S]*</body>')")
def rule_html_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "fetch_responses").filter(F.col("body").rlike(r"(?s)<body>.*<h1>[^<]+</h1>.*</body>"))
    return engine.extract_rows(docs, {"list": "h1.0", "title": "text"}, "response_id", "body")


@query()
def rule_html_index_slice(spark: SparkSession, d: str) -> DataFrame:
    """The second to fourth link of every list, with absolute addresses."""
    return engine.extract_rows(table(spark, d, "fetch_responses"), {"list": "tag.li[1:3]@tag.a", "name": "text", "url": "href"}, "response_id", "body", F.col("url"))


@query(r"""
    SELECT response_id, 0 AS pos, json_extract_string(body, '$.data.title') AS title, '/c/' || json_extract_string(body, '$.data.title') AS link
    FROM fetch_responses WHERE starts_with(body, '{"code":0,"data":{"title":"') AND json_valid(body)
""")
def rule_json_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "fetch_responses").filter(F.col("body").startswith('{"code":0,"data":{"title":"') & F.try_parse_json("body").isNotNull())
    return engine.extract_rows(docs, {"list": "$.data", "title": "title", "link": "/c/{{$.title}}"}, "response_id", "body")


RULES = [
    {"pattern": r"\d+", "replacement": "#", "is_regex": True, "order": 2},
    {"pattern": "（本章完）", "replacement": "", "order": 1},
    {"pattern": r"(\S+)说完便走", "replacement": "$1走了", "is_regex": True, "order": 3},
    {"pattern": "[", "replacement": "", "is_regex": True, "order": 4},
    {"pattern": "x", "replacement": "y", "is_enabled": False},
]


@query(r"SELECT cache_id, md5(regexp_replace(regexp_replace(replace(coalesce(content, ''), '（本章完）', ''), '[0-9]+', '#', 'g'), '([^\t\n\f\r \v]+)说完便走', '\1走了', 'g')) AS digest FROM chapter_cache")
def replace_rules_fold(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "chapter_cache").select("cache_id", "content", "book_url", F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("name"))
    return rewrite.apply_rules(cache, RULES, "content").select("cache_id", F.md5("content").alias("digest"))


@query(rf"""
    WITH f AS (SELECT cache_id, trim(regexp_replace(content, '{SPACE}+', ' ', 'g'), ' ') AS t FROM chapter_cache WHERE contains(lower(content), '消息')),
         p AS (SELECT *, string_split(lower(t), '消息') AS p FROM f), e AS (SELECT cache_id, t, p, unnest(range(1, len(p))) AS i FROM p),
         m AS (SELECT cache_id, t, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 2 AS INTEGER) AS pos FROM e)
    SELECT cache_id, pos, CASE WHEN pos > 18 THEN '...' ELSE '' END || trim(substring(t, greatest(pos - 18, 0) + 1, least(pos + 20, length(t)) - greatest(pos - 18, 0)), ' ') || CASE WHEN pos + 20 < length(t) THEN '...' ELSE '' END AS snippet FROM m
""")
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.search(table(spark, d, "chapter_cache"), "content", "消息", ["cache_id"])


@query(rf"SELECT hit_id, lower(regexp_replace(coalesce(author, ''), '^{SPACE}+|{SPACE}+$', '', 'g')) NOT IN ('', '0', 'false', 'null', 'none', 'no', 'off') AS truthy FROM search_hits")
def truthiness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", text.truthy(F.col("author")).alias("truthy"))


@query(rf"SELECT hit_id, trim(regexp_replace(intro, '{SPACE}+', ' ', 'g'), ' ') AS flat, CASE WHEN length(intro) <= 40 THEN intro ELSE left(intro, 40) || '…' END AS short FROM search_hits")
def text_shortened(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").select("hit_id", text.collapse(F.col("intro")).alias("flat"), text.ellipsis(F.col("intro"), 40).alias("short"))


@query("SELECT request_id, md5(CASE WHEN length(content) <= 12000 THEN content ELSE left(content, 8000) || chr(10) || chr(10) || '……中间内容已省略……' || chr(10) || chr(10) || right(content, 4000) END) AS digest FROM summary_requests")
def text_elided(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "summary_requests").select("request_id", F.md5(text.elide(F.col("content"))).alias("digest"))


@query(rf"SELECT response_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '{SPACE}+', ' ', 'g'), ' ')) AS digest FROM fetch_responses")
def text_without_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_responses").select("response_id", F.md5(text.without_tags(F.col("body"))).alias("digest"))


@query(r"""
    WITH u AS (SELECT response_id, coalesce(is_successful, false) AS ok, regexp_replace(regexp_replace(url, '[?#].*$', ''), '\.[A-Za-z0-9]{1,5}$', '') AS base FROM fetch_responses)
    SELECT response_id, regexp_replace(base, '[-_]([2-9]|[1-9][0-9]+)$', '') AS stem, ok AS follows FROM u
""")
def url_follow_page(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    base = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return table(spark, d, "fetch_responses").select("response_id", urls.page_stem(u).alias("stem"), urls.follows(u, F.when(F.col("is_successful"), F.concat(base, F.lit("_2.html"))).otherwise("https://elsewhere.example/a/b_2.html")).alias("follows"))


@query("SELECT spec_id, CASE WHEN spec_id % 3 = 0 THEN url || '/list.html' WHEN spec_id % 3 = 1 THEN url || '/list_2.html' ELSE url || '/list_2.html' END AS address FROM request_specs")
def url_page_choice(spark: SparkSession, d: str) -> DataFrame:
    template = F.concat(F.col("url"), F.lit("/list<,_2>.html"))
    return table(spark, d, "request_specs").select("spec_id", urls.page_choice(template, (F.col("spec_id") % 3 + 1).cast("int")).alias("address"))


@query("SELECT spec_id, url || '?q=' || replace(replace(url, ':', '%3A'), '/', '%2F') AS url, 'POST' AS http_method, 'a=1' AS body, 2 AS retry FROM request_specs")
def url_analyze(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "request_specs")
    template = F.concat(F.col("url"), F.lit('?q={{key}},{"method":"post","body":"a={{page}}","retry":2}'))
    r = urls.analyze_url(template, F.col("url"), F.lit(1), F.lit(""), F.lit(None).cast("string"))
    return specs.select("spec_id", r.alias("r")).select("spec_id", "r.url", "r.http_method", "r.body", "r.retry")


@query("SELECT response_id, md5(body) AS digest FROM fetch_responses WHERE body IS NOT NULL")
def charset_decode(spark: SparkSession, d: str) -> DataFrame:
    """Bodies put into bytes of a charset told by the request, by the header or by nothing, and read again."""
    docs = table(spark, d, "fetch_responses").filter(F.col("body").isNotNull())
    told, header = F.col("is_successful"), F.col("is_successful").isNull()
    data = F.when(told, F.encode("body", "UTF-16BE")).when(header, F.encode("body", "UTF-16LE")).otherwise(F.encode("body", "UTF-8"))
    charset, kind = F.when(told, "utf-16be"), F.when(header, "text/html; charset=utf-16le").when(told, F.col("content_type")).otherwise("text/html; charset=utf-8")
    return docs.select("response_id", F.md5(urls.decode_bytes(data, charset, kind)).alias("digest"))


@query("SELECT hit_id, 0 AS ord, trim(name, ' ') AS title, book_url AS link FROM search_hits")
def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hits rendered as feeds and read back."""
    hits = table(spark, d, "search_hits")
    feeds = hits.select(F.col("hit_id").alias("source_url"), F.concat(F.lit("<rss><channel><item><title>"), F.col("name"), F.lit("</title><link>"), F.col("book_url"), F.lit("</link></item></channel></rss>")).alias("body"))
    return imports.feed_items(feeds).select(F.col("source_url").alias("hit_id"), "ord", "title", "link")


@query("SELECT hit_id, 0 AS pos, origin, name FROM search_hits")
def json_import(spark: SparkSession, d: str) -> DataFrame:
    """Hits wrapped as JSON lists under a key and imported."""
    hits = table(spark, d, "search_hits").select(F.to_json(F.struct(F.array(F.struct("hit_id", "origin", "name")).alias("bookSourceList"))).alias("value"))
    items = imports.objects(hits)
    return items.select(F.get_json_object("item", "$.hit_id").cast("bigint").alias("hit_id"), "pos", F.get_json_object("item", "$.origin").alias("origin"), F.get_json_object("item", "$.name").alias("name"))


@query("""SELECT summary_id, CASE WHEN trim(coalesce(summary, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) = '' THEN NULL ELSE summary END AS text FROM chapter_summaries WHERE NOT contains(coalesce(summary, ''), '{')""")
def model_answer_text(spark: SparkSession, d: str) -> DataFrame:
    """Answers read permissively; those that hold no object are their own summary."""
    answers = table(spark, d, "chapter_summaries").filter(~F.contains(F.coalesce("summary", F.lit("")), F.lit("{")))
    return answers.select("summary_id", model_json.summary_of(F.col("summary"))["summary"].alias("text"))


@query()
def model_answer_objects(spark: SparkSession, d: str) -> DataFrame:
    """Answers that hold an object, truncated ones repaired, with their summary and points."""
    answers = table(spark, d, "chapter_summaries").filter(F.contains("summary", F.lit("{")))
    read = answers.select("summary_id", model_json.summary_of(F.col("summary")).alias("r"))
    return read.select("summary_id", "r.summary", F.array_join("r.key_points", " | ").alias("points"))


@query("SELECT hit_id, coalesce(kind, 'all') AS title, book_url AS url FROM search_hits UNION ALL SELECT hit_id, 'next' AS title, origin AS url FROM search_hits")
def explore_categories(spark: SparkSession, d: str) -> DataFrame:
    """Explore settings of title::url parts read back."""
    text_of = F.concat(F.coalesce("kind", F.lit("all")), F.lit("::"), F.col("book_url"), F.lit("&&next::"), F.col("origin"))
    return table(spark, d, "search_hits").select("hit_id", F.inline(sources_admin.categories(text_of)))


@query("SELECT hit_id, origin AS source, name AS book_rule FROM search_hits")
def source_migration(spark: SparkSession, d: str) -> DataFrame:
    """Flat definitions brought into nested form."""
    hits = table(spark, d, "search_hits")
    flat = hits.select("hit_id", F.to_json(F.struct(F.col("origin").alias("bookSourceUrl"), F.col("name").alias("ruleSearchName"))).alias("item"))
    m = sources_admin.migrate(flat)
    return m.select("hit_id", F.get_json_object("item", "$.bookSourceUrl").alias("source"), F.get_json_object("item", "$.ruleSearch.name").alias("book_rule"))


@query("SELECT origin, count(*) AS hits FROM search_hits WHERE contains(lower(coalesce(name, '')), 'the') OR contains(lower(coalesce(origin, '')), 'the') GROUP BY 1")
def source_filter(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").filter(sources_admin.matching(F.col("name"), F.col("origin"), F.lit(None).cast("string"), " The "))
    return hits.groupBy("origin").agg(F.count("*").alias("hits"))


@query()
def rule_toc(spark: SparkSession, d: str) -> DataFrame:
    """Side lists of pages read as contents pages: the last of equal addresses stays."""
    return engine.extract_toc(table(spark, d, "fetch_responses"), {"list": "-tag.a", "name": "text", "url": "href"}, "response_id", "body", F.col("url"))


@query(r"""
    SELECT response_id, regexp_replace(regexp_replace(json_extract_string(body, '$.data.content'), '\p{Nd}+', 'N', 'g'), '^[\t-\r\x1c-\x1f\x{85}\p{Z}]+|[\t-\r\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS text FROM fetch_responses WHERE starts_with(body, '{"code":0,"data":{"title":"') AND json_valid(body)
""")
def rule_content(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "fetch_responses").filter(F.col("body").startswith('{"code":0,"data":{"title":"') & F.try_parse_json("body").isNotNull())
    return engine.extract_content(docs, {"content": "$.data.content", "replace": r"##\d+##N"}, "response_id", "body", F.col("url")).select("response_id", "text")


@query("SELECT spec_id, md5(url || chr(10) || coalesce(http_method, '')) AS name, strftime(created_at, '%Y-%m-%d %H:%M') AS at FROM request_specs")
def keyed_names(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.functions import codec

    specs = table(spark, d, "request_specs")
    return specs.select("spec_id", codec.keyed_md5(F.col("url"), F.coalesce("http_method", F.lit(""))).alias("name"), codec.minutes(F.unix_timestamp("created_at")).alias("at"))


@query(r"""
    WITH p AS (SELECT hit_id, coalesce(name, '') AS name, book_url, kind IS NULL AS listed FROM search_hits WHERE name IS NULL OR NOT regexp_matches(name, '[<>&]')),
         t AS (SELECT *, regexp_replace(name, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g') AS t FROM p)
    SELECT hit_id, nullif(t, '') AS name, CASE WHEN listed THEN 'http://h/' || hit_id ELSE book_url END AS book_url FROM t WHERE listed OR t != ''
""")
def rule_search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Search pages with a list, and detail pages in the place of one: names without markup."""
    hits = table(spark, d, "search_hits").filter("name is null or not name rlike '[<>&]'")
    name = F.coalesce("name", F.lit(""))
    body = F.when(F.col("kind").isNull(), F.concat(F.lit("<ul><li><a href='/"), F.col("hit_id").cast("string"), F.lit("'>"), name, F.lit("</a></li></ul>"))).otherwise(F.concat(F.lit("<h1>"), name, F.lit("</h1>")))
    docs = hits.select("hit_id", body.alias("body"), F.when(F.col("kind").isNull(), "http://h/").otherwise(F.col("book_url")).alias("base"))
    found = engine.extract_rows(docs, {"list": "ul@li", "name": "a@text", "book_url": "a@href"}, "hit_id", "body", F.col("base"), detail={"name": "h1@text"})
    return found.select("hit_id", F.when(F.col("name") != "", F.col("name")).alias("name"), "book_url")
