"""Queries of ordered data: gaps, look-back, budgets, segments, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import segment, sequence
from folioflow.plans._named import collector
from folioflow.session import ensure_checkpoint_dir
from folioflow.sources.tables import table
from folioflow.streaming import streams

ALL, query = collector()
SPACE = r"[\t-\r\x{85}\p{Z}]"


@query("""
    WITH p AS (SELECT DISTINCT user_ns, book_url, chapter_index AS i FROM summary_requests WHERE chapter_index >= 0),
         n AS (SELECT *, row_number() OVER (PARTITION BY user_ns, book_url ORDER BY i) - 1 AS n FROM p),
         g AS (SELECT user_ns, book_url, coalesce(min(n) FILTER (n != i), count(*)) AS first_missing FROM n GROUP BY 1, 2)
    SELECT user_ns, book_url, CAST(first_missing AS BIGINT) AS first_missing, CASE WHEN first_missing > 0 THEN CAST(first_missing - 1 AS BIGINT) END AS processed FROM g
""")
def gap_first_missing(spark: SparkSession, d: str) -> DataFrame:
    return sequence.first_missing(table(spark, d, "summary_requests"), ["user_ns", "book_url"], "chapter_index")


@query("""
    SELECT summary_id, coalesce(string_agg(CAST(summary_id AS VARCHAR), ' ') OVER w, '') AS before FROM chapter_summaries
    WINDOW w AS (PARTITION BY user_ns, book_url ORDER BY chapter_index NULLS FIRST, summary_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")
def asof_prev5(spark: SparkSession, d: str) -> DataFrame:
    r = sequence.look_back(table(spark, d, "chapter_summaries"), ["user_ns", "book_url"], ["chapter_index", "summary_id"], F.col("summary_id").cast("string"), 5, "b")
    return r.select("summary_id", F.array_join("b", " ").alias("before"))


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 19 FOLLOWING) AS ahead FROM events")
def lookahead_min(spark: SparkSession, d: str) -> DataFrame:
    return sequence.look_ahead_min(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value"), 19, "ahead").select("event_id", "ahead")


@query("""
    SELECT summary_id, used_before FROM (SELECT summary_id, CAST(coalesce(sum(length(coalesce(summary, ''))) OVER (PARTITION BY user_ns, book_url ORDER BY chapter_index NULLS FIRST, summary_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM chapter_summaries) WHERE used_before < 1200
""")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    size = F.length(F.coalesce("summary", F.lit("")))
    return sequence.within_budget(table(spark, d, "chapter_summaries"), ["user_ns", "book_url"], ["chapter_index", "summary_id"], size, 1200).select("summary_id", F.col("used_before").cast("bigint").alias("used_before"))


@query("""
    SELECT user_id, list_reduce(list_prepend({'n': CAST(0 AS BIGINT), 'm': CAST(0 AS BIGINT), 'x': CAST(0 AS BIGINT)}, v), lambda s, e: {'n': s.n + 1, 'm': (s.m * s.n + e.x) // (s.n + 1), 'x': CAST(0 AS BIGINT)}).m AS mean
    FROM (SELECT user_id, list({'n': CAST(0 AS BIGINT), 'm': CAST(0 AS BIGINT), 'x': CAST(event_id % 1000 AS BIGINT)} ORDER BY ts, event_id) AS v FROM events GROUP BY 1)
""")
def running_avg_int(spark: SparkSession, d: str) -> DataFrame:
    return sequence.running_mean_of(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_id") % 1000)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    return sequence.window_count(table(spark, d, "events"), ["user_id"], F.unix_timestamp("ts"), 3600, "in_hour").select("event_id", "in_hour")


@query("SELECT chapter_id, CAST(row_number() OVER (PARTITION BY user_ns, book_url ORDER BY chapter_index DESC, chapter_id) - 1 AS INTEGER) AS index FROM txt_chapters")
def reverse_reindex(spark: SparkSession, d: str) -> DataFrame:
    return sequence.reindexed(table(spark, d, "txt_chapters").select("user_ns", "book_url", "chapter_index", "chapter_id"), ["user_ns", "book_url"], [F.desc("chapter_index"), F.asc("chapter_id")]).select("chapter_id", "index")


_TITLE = rf"regexp_replace(coalesce(title, ''), '{SPACE}|[【】《》（）()]', '', 'g')"


@query(rf"SELECT chapter_id, CAST(nullif(regexp_extract({_TITLE}, '^(?:第)?(\d{{1,5}})(?:[章节回话集部卷篇.、:：]|$)', 1), '') AS INTEGER) AS ordinal FROM txt_chapters")
def chapter_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "txt_chapters").select("chapter_id", text.chapter_ordinal(F.col("title")).alias("ordinal"))


@query(rf"""
    WITH t AS (SELECT chapter_id, user_ns, book_url, chapter_index, {_TITLE} AS t,
                      CAST(nullif(regexp_extract({_TITLE}, '^(?:第)?(\d{{1,5}})(?:[章节回话集部卷篇.、:：]|$)', 1), '') AS INTEGER) AS n FROM txt_chapters),
         w AS (SELECT *, min(chapter_index) FILTER (n = 1 AND t NOT IN ('序章', '楔子', '引子', '序', '前言')) OVER (PARTITION BY user_ns, book_url) AS first_main,
                      min(n) OVER (PARTITION BY user_ns, book_url ORDER BY chapter_index, chapter_id ROWS BETWEEN 1 FOLLOWING AND 19 FOLLOWING) AS ahead FROM t)
    SELECT chapter_id FROM w WHERE t != '' AND (t IN ('序章', '楔子', '引子', '序', '前言') OR (NOT regexp_matches(t, '{'|'.join(text.NON_STORY)}')
        AND NOT coalesce(chapter_index <= 30 AND n >= 50 AND (coalesce(chapter_index < first_main, false) OR coalesce(ahead <= 10, false)), false)))
""")
def story_chapters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "txt_chapters").select("chapter_id", "user_ns", "book_url", "title", F.struct("chapter_index", "chapter_id").alias("place"), "chapter_index")
    return sequence.story_chapters(rows, ["user_ns", "book_url"], "chapter_index", "title").select("chapter_id")


@query(rf"""
    WITH l AS (SELECT chapter_id, unnest(string_split(concat_ws(chr(10), title, content), chr(10))) AS line FROM txt_chapters), t AS (SELECT chapter_id, regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM l)
    SELECT chapter_id, count(*) AS headings FROM t WHERE t != '' AND length(t) <= 80 AND regexp_matches(t, '{text.HEADING}') GROUP BY 1
""")
def segment_heading_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "txt_chapters").select("chapter_id", F.explode(F.split(F.concat_ws("\n", "title", "content"), "\n")).alias("line")).withColumn("t", text.utrim(F.col("line")))
    return lines.filter((F.col("t") != "") & text.is_heading(F.col("t"))).groupBy("chapter_id").agg(F.count("*").alias("headings"))


@query()
def segment_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Imported texts cut into chapters again: each row's title line and content is a text of its own."""
    texts = table(spark, d, "txt_chapters").select(F.concat_ws("/", "book_url", F.col("chapter_id").cast("string")).alias("book_url"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text"))
    return segment.chapters(texts)


@query("SELECT book_url, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM txt_chapters GROUP BY 1")
def segment_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Byte ranges of whole contents read back."""
    c = F.col("content")
    rows = table(spark, d, "txt_chapters").select("book_url", segment.read_range(c, F.lit(0), F.octet_length(c)).alias("t"))
    return rows.groupBy("book_url").agg(F.sum(F.octet_length("t")).cast("bigint").alias("bytes"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """An incremental union distinct, run to its end over a file stream and written to files."""
    at = _folder(spark, "stream")
    s = streams.distinct_hits(_stream(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])
    s.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.parquet(f"{at}/rows")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM (SELECT user_id, ts, max(event_type) AS event_type FROM events GROUP BY 1, 2) GROUP BY 1")
def stream_newest(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-order progress: the newest time of each key wins, as a complete streaming aggregate."""
    at = _folder(spark, "newest")
    s = _stream(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_type")).alias("m")).select("user_id", "m.event_type", "m.ts")
    streams.run_to_end(s, "newest", "complete", f"{at}/state", lambda b, n: b.write.mode("overwrite").parquet(f"{at}/rows"))
    return spark.read.parquet(f"{at}/rows")
