"""Queries of the training-data operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import boilerplate, leakage, lookalike, matching, mojibake, packing, pages, pairs, residue, split, truncation
from folioflow.session import written
from folioflow.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_hits(table(spark, d, "search_hits")).select("hit_id_a", "hit_id_b")


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_hits(table(spark, d, "search_hits"))


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    chapters = split.split_oversized(table(spark, d, "txt_chapters"), "txt_chapters", "chapter_id", "content")
    requests = split.split_oversized(table(spark, d, "summary_requests"), "summary_requests", "request_id", "content")
    return chapters.unionByName(requests)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized_rows(_oversized(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    chapters = split.split_texts(table(spark, d, "txt_chapters"), "txt_chapters", "chapter_id", "content")
    requests = split.split_texts(table(spark, d, "summary_requests"), "summary_requests", "request_id", "content")
    return chapters.unionByName(requests)


def _shown_values(spark: SparkSession, d: str) -> DataFrame:
    hits = lookalike.values_of(table(spark, d, "search_hits"), "search_hits", "hit_id", ["name", "author"])
    return hits.unionByName(lookalike.values_of(table(spark, d, "shelf_books"), "shelf_books", "shelf_id", ["name"]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_rows(_shown_values(spark, d)).select("table_name", "row_id", "field_name")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_forms(_shown_values(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "chapter_summaries"), table(spark, d, "summary_requests")).select("summary_id", "defect")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    responses, cache = table(spark, d, "fetch_responses"), table(spark, d, "chapter_cache")
    folder = F.regexp_extract("url", "^(.*)/[^/]*$", 1)  # the pages of a book share a folder
    return pages.page_rows(responses, "fetch_responses", "response_id", "body", F.col("url"), folder).unionByName(
        pages.page_rows(cache, "chapter_cache", "cache_id", "content", F.col("book_url"), F.col("book_url"), F.col("chapter_title"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_rows(written(boilerplate.classified(pages.line_segments(_pages(spark, d), detail=True)), "roles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    roles = written(boilerplate.classified(pages.line_segments(_pages(spark, d), detail=True)), "roles")
    return boilerplate.furniture_lines(roles).join(residue.residue_rows(roles), ["table_name", "row_id"], "left_anti")


def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    host = lambda url: F.regexp_extract(F.lower(url), r"^\w+://([^/?#]+)", 1)
    return mojibake.both(
        mojibake.texts_of(table(spark, d, "fetch_responses"), "fetch_responses", "response_id", "body", host("url")),
        mojibake.texts_of(table(spark, d, "chapter_cache"), "chapter_cache", "cache_id", "content", host("book_url")),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_rows(mojibake.garbled_lines(_page_texts(spark, d), rows_only=True))


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_lines(_page_texts(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "n_tokens", "text")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """What of every document lies in containers: its tokens, its parts and the greatest gap or overlap between them."""
    packed = p8_containers(spark, d)
    spans = packed.groupBy("doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).cast("bigint").alias("tokens"), F.count("*").alias("parts"), F.min("token_start").alias("first"), F.max("token_end").alias("last"))
    return spans


def p8_overfull(spark: SparkSession, d: str) -> DataFrame:
    """Containers filled beyond their length, and how many fewer containers the tokens alone would need, by a twentieth."""
    one = p8_containers(spark, d).groupBy("container_id", "container_length").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    return one.agg(F.count_if(F.col("used") > F.col("container_length")).alias("overfull"), F.sum("used").cast("bigint").alias("tokens"), (F.count("*") * 2048 <= F.sum("used") * 1.05 + 2048).alias("near_bound"))


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces without their overlaps, the longest piece and whether all overlaps are whole."""
    pieces = p2_pieces(spark, d).withColumn("piece", F.coalesce("piece", F.lit("")))
    w = Window.partitionBy("table_name", "row_id").orderBy("piece_no")
    shared = F.coalesce(F.lag("end_pos").over(w) - F.col("start_pos"), F.lit(0))
    p = pieces.withColumn("shared", shared)
    new = F.substr("piece", F.col("shared").cast("int") + 1, F.length("piece"))
    whole = p.groupBy("table_name", "row_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("t")))).alias("x"), (F.max(F.length("piece")) <= 4000).alias("within_limit"), F.bool_and((F.col("piece_no") == 0) | (F.col("shared") == 200)).alias("overlaps"))
    return whole.select("table_name", "row_id", F.md5(F.array_join(F.transform("x", lambda x: x["t"]), "")).alias("digest"), "within_limit", "overlaps")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_documents(table(spark, d, "documents")).filter("cut").select("doc_id")


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_share(truncation.cut_documents(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_confidence, p2_found, p2_pieces, p2_rebuilt, p3_found, p3_forms, p4_found, p5_found, p6_found, p7_found, p7_restored, p8_containers, p8_fill, p8_placed, p8_overfull, p9_found, p10_found, p10_share)
}

def _lookalike_sql() -> str:
    """is_dirty in SQL whose regular expressions know no look-around and no intersections."""
    def re2(pattern: str) -> str:
        return pattern.replace("\\p{Is", "\\p{").replace("[\\p{Z}&&[^ ]]", "[\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")

    wide = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
    narrow = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B)))
    letters, same = r"\p{Latin}\p{Cyrillic}\p{Greek}\p{M}", lookalike.CYRILLIC + lookalike.GREEK
    word = lambda chars: rf"(?:^|[^{letters}])[{chars}]+(?:$|[^{letters}])"
    plain = "|".join(re2(x) for x in (lookalike.INVISIBLE, lookalike.OTHER_SPACE, lookalike.COMPATIBILITY, lookalike.DECOMPOSED))
    return rf"""
        WITH v AS (SELECT 'search_hits' AS table_name, hit_id AS row_id, 'name' AS field_name, name AS value FROM search_hits
                   UNION ALL SELECT 'search_hits', hit_id, 'author', author FROM search_hits UNION ALL SELECT 'shelf_books', shelf_id, 'name', name FROM shelf_books),
             s AS (SELECT *, translate(regexp_replace(value, '{re2(lookalike.INVISIBLE)}', '', 'g'), '{wide}', '{narrow}') AS x FROM v WHERE value IS NOT NULL),
             c AS (SELECT *, len(regexp_extract_all(x, '\p{{Latin}}')) AS latin, len(regexp_extract_all(x, '[\p{{Cyrillic}}\p{{Greek}}]')) AS other,
                          len(regexp_extract_all(x, '[\p{{Cyrillic}}\p{{Greek}}]')) > len(regexp_extract_all(x, '[{same}]')) AS unlike FROM s)
        SELECT table_name, row_id, field_name FROM c
        WHERE regexp_matches(value, '{plain}') OR (other > 0 AND (regexp_matches(x, '{re2(lookalike.MIXED_WORD)}')
            OR (NOT unlike AND (latin > 0 OR regexp_matches(x, '\p{{Han}}')) AND regexp_matches(x, '{word(same)}'))))
    """


def _truncation_sql(share: bool) -> str:
    """cut_documents in SQL: the same counts, joins and verdict."""
    t = truncation
    quoted = lambda x: x.replace("'", "''")
    blanks, quotes = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(12288) || chr(160) || chr(65279)", quoted("".join(t.QUOTES))
    letter = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Hiragana}\p{Katakana}\p{Hangul}\p{M}]"
    word = rf"({letter}+(?:[’''\-]{letter}+)*|\p{{Han}}|#|\n|[^\s\p{{L}}\p{{M}}])"
    head = r"^\s*([\p{L}\p{M}]{1,3}[:：]|\p{Han}{1,3}[^\p{Han}\p{L}]?|[^\s:：#]+(?:\s[^\s:：#]+)?[:：#]?|.)"
    low = lambda x: f"regexp_replace(lower({x}), '[0-9]+', '#', 'g')"
    stem = lambda x: f"rtrim({x}, {blanks} || '{quotes}')"
    closes = lambda x: rf"(right({stem(x)}, 1) IN ({', '.join(repr(c) for c in t.CLOSERS)}) AND NOT regexp_matches(right({stem(x)}, 3), '(?:^|[^\p{{L}}\p{{M}}])\p{{Latin}}\.$'))"
    head_of = lambda x: f"regexp_extract({low(f'left({x}, {t._HEAD})')}, '{head}', 1)"
    marks = lambda words: "greatest(" + ", ".join(f"CASE WHEN ends_with(lower(right(m, 20)), '{w}') THEN {len(w)} ELSE 0 END" for w in words) + ")"
    is_end = "(d IN (" + ", ".join("chr(10)" if c == "\n" else f"'{c}'" for c in t.ENDERS) + r") AND NOT (d = '.' AND regexp_matches(c, '^\p{Latin}$')))"
    body = rf"""
        WITH r0 AS (SELECT doc_id, source, trim(text, {blanks}) AS t FROM documents),
        r1 AS (SELECT *, rtrim(CASE WHEN ends_with(t, '...') THEN rtrim(t, '.') ELSE t END, {blanks} || '…)）]】>') AS m FROM r0 WHERE t != ''),
        r2 AS (SELECT *, {marks(t.CUT_MARKS)} AS long, {marks(t.SHORT_MARKS)} AS short FROM r1), r3 AS (SELECT *, rtrim(left(m, length(m) - greatest(long, short)), {blanks}) AS y FROM r2),
        r5 AS (SELECT *, CASE WHEN long > 0 OR (short > 0 AND right(y, 1) IN ('…', '.', '(', '[', '（', '【', '<')) THEN rtrim(rtrim(y, '(（[【<'), {blanks}) ELSE t END AS u FROM r3),
        r6 AS (SELECT *, rtrim(left(u, greatest(length(u) - {t._MARKUP}, 0)) || regexp_replace(right(u, {t._MARKUP}), '{quoted(t._BROKEN)}', ''), chr(65533)) AS b FROM r5),
        r7 AS (SELECT *, rtrim(b, '….') AS s, substr(b, length(rtrim(b, '….')) + 1) AS run FROM r6),
        r8 AS (SELECT *, CASE WHEN contains(run, '…') OR contains(run, '...') THEN run ELSE '' END AS dots FROM r7),
        r9 AS (SELECT *, trim(CASE WHEN dots != '' THEN s ELSE b END, {blanks}) AS bare FROM r8),
        r AS (SELECT doc_id, source, t, bare, dots, b != t AS marked, {closes('bare')} AND dots = '' AS closed FROM r9),
        w AS (SELECT regexp_extract_all({low('CASE WHEN closed THEN t ELSE bare END')}, '{word}', 1) AS w FROM r),
        g AS (SELECT w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS d FROM (SELECT w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)),
        e AS (SELECT a, b, c, CASE WHEN {is_end} THEN 1 ELSE 0 END AS ending, CASE WHEN d = chr(10) THEN 1 ELSE 0 END AS bare FROM g),
        n AS (SELECT gram, count(*) AS n, sum(ending) AS ending, sum(bare) AS bare FROM (SELECT unnest([a || ' ' || b || ' ' || c, b || ' ' || c, c]) AS gram, ending, bare FROM e) GROUP BY 1),
        l AS (SELECT {head_of('s[i]')} AS head, i = len(s) AS at_end, len(s) > 1 AS several, {closes('s[i]')} AS closes FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT list_filter(string_split(t, chr(10)), lambda z: z != '') AS s FROM r))),
        h AS (SELECT head, count(*) FILTER (at_end AND several AND NOT closes) AS last, count(*) FILTER (NOT (at_end AND several AND NOT closes)) AS other, count(*) FILTER (NOT at_end AND NOT closes) AS open_inside, count(*) FILTER (NOT at_end AND closes) AS closed_inside FROM l GROUP BY 1),
        v AS (SELECT run AS dots, count(*) > 3 * count(*) FILTER (dots = run) AS dots_inside FROM (SELECT unnest(regexp_extract_all(t, '((?:…|\.{{3}})+)', 1)) AS run, dots FROM r) WHERE length(run) <= 6 GROUP BY 1),
        o AS (SELECT doc_id, source, marked, dots, list_filter(string_split(t, chr(10)), lambda z: z != '')[-1] AS line, contains(t, chr(10)) AS manylines, list_filter(regexp_extract_all({low('bare')}, '{word}', 1), lambda z: z != chr(10)) AS w FROM r WHERE NOT closed),
        q AS (SELECT *, {head_of('line')} AS head, CASE WHEN len(w) >= 3 THEN w[-3] || ' ' || w[-2] || ' ' || w[-1] END AS g3, CASE WHEN len(w) >= 2 THEN w[-2] || ' ' || w[-1] END AS g2, CASE WHEN len(w) >= 1 THEN w[-1] END AS g1 FROM o),
        j AS (SELECT q.*, h.last, h.other, h.open_inside, h.closed_inside, v.dots_inside, n3.n AS n3, n3.ending AS e3, n3.bare AS b3, n2.n AS n2, n2.bare AS b2, n1.n AS n1, n1.bare AS b1
              FROM q LEFT JOIN h USING (head) LEFT JOIN v USING (dots) LEFT JOIN n n3 ON n3.gram = g3 LEFT JOIN n n2 ON n2.gram = g2 LEFT JOIN n n1 ON n1.gram = g1),
        k AS (SELECT *, CASE WHEN n3 >= 4 THEN b3 / n3 WHEN n2 >= 4 THEN b2 / n2 WHEN n1 >= 4 THEN b1 / n1 ELSE 0.0 END AS spoken FROM j),
        f AS (SELECT doc_id, source, coalesce(CASE WHEN marked THEN spoken <= 0.25 WHEN manylines AND length(line) <= 80 AND ((last >= 3 AND last > 2 * other) OR (open_inside >= 4 AND open_inside > 4 * closed_inside)) THEN false
                     WHEN dots_inside THEN n3 >= 20 AND e3 / n3 <= 0.025 ELSE spoken <= 0.25 END, false) AS cut FROM k
              UNION ALL SELECT doc_id, source, false FROM r WHERE closed)
    """
    if share:
        return body + " SELECT source, count(*) AS documents, count(*) FILTER (cut) AS cut_documents, round(count(*) FILTER (cut) / count(*), 6) AS share FROM f GROUP BY 1"
    return body + " SELECT doc_id FROM f WHERE cut"


_PACKED = r"documents WHERE n_tokens >= 1 AND regexp_matches(text, '[^\s \x{3000}\x{FEFF}]')"

ORACLES: dict[str, str] = {
    "p2_rebuilt": """
        SELECT 'txt_chapters' AS table_name, chapter_id AS row_id, md5(coalesce(content, '')) AS digest, true AS within_limit, true AS overlaps FROM txt_chapters
        UNION ALL
        SELECT 'summary_requests', request_id, md5(coalesce(content, '')), true, true FROM summary_requests
    """,
    "p8_placed": f"SELECT doc_id, CAST(n_tokens AS BIGINT) AS tokens, (n_tokens + 2047) // 2048 AS parts, CAST(0 AS BIGINT) AS first, CAST(n_tokens AS BIGINT) AS last FROM {_PACKED}",
    "p8_overfull": f"SELECT 0 AS overfull, CAST(sum(n_tokens) AS BIGINT) AS tokens, true AS near_bound FROM {_PACKED}",
    "p10_found": _truncation_sql(share=False),
    "p10_share": _truncation_sql(share=True),
    "p3_found": _lookalike_sql(),
    "p2_found": """
        SELECT 'txt_chapters' AS table_name, chapter_id AS row_id FROM txt_chapters WHERE length(content) > 4000
        UNION ALL
        SELECT 'summary_requests', request_id FROM summary_requests WHERE length(content) > 4000
    """,
}
