"""Queries of knowledge folding and relationship graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import graph, joins, knowledge
from folioflow.plans._named import collector
from folioflow.sources.tables import table

ALL, query = collector()

RELATIONS = """r AS (SELECT event_id, 'user ' || user_id AS s, 'user ' || (user_id + 1) AS t, CASE WHEN value IS NULL THEN event_type ELSE CASE event_type WHEN 'click' THEN 'friend' WHEN 'view' THEN 'see' ELSE event_type END END AS k, props AS description, value IS NOT NULL AS has_evidence FROM events),
    p AS (SELECT DISTINCT 'user ' || user_id AS name FROM events)"""


def _relations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "events")
    kind = F.when(F.col("value").isNull(), F.col("event_type")).when(F.col("event_type") == "click", "friend").when(F.col("event_type") == "view", "see").otherwise(F.col("event_type"))
    user = lambda c: F.concat(F.lit("user "), c.cast("string"))
    r = e.select("event_id", user(F.col("user_id")).alias("source_name"), user(F.col("user_id") + 1).alias("target_name"), kind.alias("kind_raw"), F.col("props").alias("description"), F.col("value").isNotNull().alias("has_evidence"))
    people = e.select(user(F.col("user_id")).alias("name")).distinct()
    return r, people, table(spark, d, "nation").select(F.col("n_name").alias("name"))


@query(f"""
    WITH {RELATIONS}
    SELECT event_id, CASE WHEN NOT has_evidence THEN 'drop' WHEN k IN ('item', 'owns', 'purchase') THEN 'drop' WHEN k IN ('see', 'hear') THEN 'drop' WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.name = r.t) THEN 'drop' WHEN k != 'friend' THEN 'drop' ELSE 'keep' END AS action,
           CASE WHEN NOT has_evidence THEN 'missing_evidence' WHEN k IN ('item', 'owns', 'purchase') THEN 'person_item_relation' WHEN k IN ('see', 'hear') THEN 'transient_action' WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.name = r.t) THEN 'invalid_entity' WHEN k != 'friend' THEN 'invalid_relation_kind' END AS reason
    FROM r
""")
def relation_classify(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.classified(*_relations(spark, d)).select("event_id", "action", "reason")


EDGES = """e AS (SELECT s.s_nationkey AS source, c.c_nationkey AS target, l_returnflag AS kind, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Trade between nations by return flag: both small tables are joined by Catalyst's own choice."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("source")), "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("target")), "o_custkey")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy("source", "target", F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("weight"))


@query(f"WITH {EDGES} SELECT least(source, target) || '|' || greatest(source, target) AS pair, count(*) AS relations, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS kinds FROM (SELECT CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, kind FROM e) GROUP BY 1")
def relation_pair_group(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).select(F.col("source").cast("string").alias("source_name"), F.col("target").cast("string").alias("target_name"), "kind", F.concat_ws("|", "kind", F.col("source").cast("string"), F.col("target").cast("string")).alias("place"))
    g = knowledge.grouped_pairs(e, [], "place")
    return g.select("pair", "relations", F.array_join(F.array_sort("kinds"), " ").alias("kinds"))


@query(f"WITH {EDGES}, d AS (SELECT source AS node FROM e WHERE source != target UNION ALL SELECT target FROM e WHERE source != target) SELECT node, count(*) AS degree FROM d GROUP BY 1")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query(f"""
    WITH {EDGES}, d AS (SELECT target AS neighbour, weight FROM e WHERE source = 7 AND target != 7 UNION ALL SELECT source, weight FROM e WHERE target = 7 AND source != 7)
    SELECT neighbour, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS relations FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15
""")
def ego_network(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of one node, the fifteen nearest: the limit is the feature."""
    return graph.ego_network(_edges(spark, d), 7)


@query(f"""
    WITH {EDGES}, d AS (SELECT source AS node FROM e WHERE source != target UNION ALL SELECT target FROM e WHERE source != target), g AS (SELECT node, count(*) AS degree FROM d GROUP BY 1),
         w AS (SELECT n_nationkey AS node, CASE WHEN n_regionkey = 3 THEN 4 ELSE 0 END + greatest(0, 8 - abs(20 - n_nationkey)) + 10 * coalesce(degree, 0) AS weight FROM nation LEFT JOIN g ON node = n_nationkey)
    SELECT node, CAST(weight AS BIGINT) AS weight FROM w ORDER BY weight DESC, node LIMIT 1
""")
def protagonist(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_regionkey") == 3, "high").alias("importance"), F.col("n_nationkey").alias("last_seen"))
    return graph.protagonist(nodes, _edges(spark, d), F.lit(20)).select("node", F.col("weight").cast("bigint").alias("weight"))


@query("""
    SELECT book_url, arg_max(kind, shelf_id) FILTER (kind IS NOT NULL) AS kind, arg_max(charset, shelf_id) FILTER (charset IS NOT NULL) AS charset, arg_max(group_mask, shelf_id) FILTER (group_mask IS NOT NULL) AS group_mask, max(shelf_id) AS last_seen FROM shelf_books GROUP BY 1
""")
def fact_last_nonnull(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.last_known(table(spark, d, "shelf_books"), ["book_url"], "shelf_id", ["kind", "charset", "group_mask"])


@query("SELECT s.s_suppkey, n.n_name AS name, coalesce(r.r_name, 'none') AS region FROM supplier s LEFT JOIN nation n ON s_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey")
def relation_names(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")
    rel = table(spark, d, "supplier").join(nations.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    people = nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")).union(table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.col("r_name")))
    named = joins.named(rel.select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target_id")), people)
    return named.select("s_suppkey", F.col("source_name").alias("name"), F.col("target_name").alias("region"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def relation_both_ends(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = rel.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    good = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return joins.both_ends(a, good, "l_suppkey", "l_suppkey").select("o_orderkey", "l_linenumber")


THING = "([\u4e00-\u9fff]{2,3})(?:初现|失窃|重现|的主人|之谜|与旧友)$"


@query(f"""
    WITH n AS (SELECT DISTINCT regexp_extract(title, '{THING}', 1) AS thing FROM txt_chapters WHERE regexp_matches(title, '{THING}'))
    SELECT doc_id, thing FROM documents, n WHERE contains(text, thing)
""")
def mention_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Things that chapter titles name, and the documents that mention them."""
    names = table(spark, d, "txt_chapters").select(F.regexp_extract("title", THING, 1).alias("thing")).filter("thing != ''").distinct()
    return joins.mentions(table(spark, d, "documents").select("doc_id", "text"), names, "text", "thing").select("doc_id", "thing")


@query("""
    WITH d AS (SELECT DISTINCT user_ns, book_url, chapter_index FROM chapter_summaries WHERE trim(coalesce(summary, ''), ' ' || chr(9) || chr(10) || chr(12288)) != '')
    SELECT request_id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.user_ns = r.user_ns AND d.book_url = r.book_url AND d.chapter_index = r.chapter_index) THEN 'cached' ELSE 'missing' END AS status FROM summary_requests r
""")
def chapter_status(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.chapter_states(table(spark, d, "summary_requests").select("request_id", "user_ns", "book_url", "chapter_index"), table(spark, d, "chapter_summaries"), ["user_ns", "book_url"], "chapter_index").select("request_id", "status")


@query("""
    WITH RECURSIVE p AS (SELECT CAST(e.e AS BIGINT) AS name, CASE WHEN e.e = 0 THEN NULL ELSE CAST((e.e - 1) // 3 AS BIGINT) END AS parent FROM (SELECT DISTINCT n_nationkey AS e FROM nation) e),
        t AS (SELECT name, 0 AS depth, CAST(name AS VARCHAR) AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.name, t.depth + 1, t.path || '/' || p.name FROM p JOIN t ON p.parent = t.name)
    SELECT CAST(name AS VARCHAR) AS name, depth, path FROM t
""")
def place_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    places = table(spark, d, "nation").select(n.cast("string").alias("name"), F.when(n > 0, F.floor((n - 1) / 3).cast("bigint").cast("string")).alias("parent"))
    return graph.hierarchy(places)


@query("""
    WITH RECURSIVE l AS (SELECT DISTINCT user_ns || '/' || book_url AS b, chapter_index AS i FROM txt_chapters),
        e AS (SELECT b || '#' || i AS page, b || '#' || (i + 1) AS next FROM l WHERE EXISTS (SELECT 1 FROM l m WHERE m.b = l.b AND m.i = l.i + 1)),
        s AS (SELECT b || '#' || min(i) AS root FROM l GROUP BY b),
        t AS (SELECT root, root AS page, 0 AS depth FROM s UNION ALL SELECT t.root, e.next, t.depth + 1 FROM t JOIN e ON e.page = t.page)
    SELECT root, page, depth FROM t
""")
def page_closure(spark: SparkSession, d: str) -> DataFrame:
    """Next links followed from every book's first chapter as far as they lead."""
    c = table(spark, d, "txt_chapters").select(F.concat_ws("/", "user_ns", "book_url").alias("b"), F.col("chapter_index").alias("i")).distinct()
    name = lambda i: F.concat(F.col("b"), F.lit("#"), i.cast("string"))
    there = c.select("b", (F.col("i") - 1).alias("i"))
    links = c.join(there, ["b", "i"], "left_semi").select(name(F.col("i")).alias("page"), name(F.col("i") + 1).alias("next"))
    starts = c.groupBy("b").agg(F.min("i").alias("i")).select(name(F.col("i")).alias("root"))
    return graph.closure(links, starts)


@query("""
    SELECT doc_kind, doc_id FROM (SELECT coalesce(doc_kind, 'none') AS doc_kind, doc_id, row_number() OVER (PARTITION BY coalesce(doc_kind, 'none') ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 20
""")
def section_caps(spark: SparkSession, d: str) -> DataFrame:
    """The twenty longest texts of every kind: the limit is the feature."""
    rows = table(spark, d, "documents").select(F.coalesce("doc_kind", F.lit("none")).alias("doc_kind"), "doc_id", "n_chars")
    return knowledge.capped(rows, ["doc_kind"], [(-F.col("n_chars")).alias("o"), F.col("doc_id").alias("i")], 20).select("doc_kind", "doc_id")
