"""Scalar functions against plain Python."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text, urls


def values(spark, column, *rows):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r["x"] for r in df.select("n", column.alias("x")).orderBy("n").collect()]


def one(spark, f, *inputs):
    return values(spark, f(F.col("c0")), *[(x,) for x in inputs])


def test_whitespace_is_unicode(spark):
    assert one(spark, text.utrim, "　a b ", None, "") == ["a b", None, ""]
    assert one(spark, text.clean, "　 ", "x") == [None, "x"]
    assert one(spark, text.collapse, " a　　b ") == ["a b"]


def test_relevance_orders_exact_before_partial(spark):
    r = values(spark, text.relevance(F.col("c0"), F.col("c1"), F.col("c2")), ("星辰变", "星辰变", "x"), ("星辰变", "星辰变后传", "x"), ("星辰变", "辰星", "x"), ("星辰变", "别的", "星辰变"), ("", "任意", ""))
    assert [x["strong"] for x in r] == [True, True, False, True, True]
    assert r[0]["score"] > r[1]["score"] >= 8000 and r[4]["score"] == 0


def ordered(q, t):
    n = at = 0
    for c in q:
        k = t.find(c, at)
        n, at = (n + 1, k + 1) if k >= 0 else (n, len(t))
    return n


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc星辰", max_size=6), st.text("abc星辰", max_size=8)), min_size=1, max_size=20))
def test_ordered_and_common_counts(spark, pairs):
    q, t = F.col("c0"), F.col("c1")
    assert values(spark, text.ordered_count(q, t), *pairs) == [ordered(a, b) for a, b in pairs]
    assert values(spark, text.common_count(q, t), *pairs) == [sum(c in b for c in a) for a, b in pairs]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aB9 -_é星。", max_size=12), min_size=1, max_size=20))
def test_canonical_key(spark, texts):
    assert one(spark, text.canonical_key, *texts) == [re.sub(r"[\W_]+", "-", t.lower()).strip("-") for t in texts]


def test_last_chapter_and_titles(spark):
    long = "x" * 90 + "\n第3章 a\n第4章 b\nend"
    assert one(spark, text.last_chapter, " 第1章 ", long, "", "y" * 90) == ["第1章", "第4章 b", None, "y" * 90]
    assert one(spark, text.chapter_ordinal, "第十二章 x", "第两千零三回", "12、y", "番外", "第 7 章") == [12, 2003, 12, None, 7]
    assert one(spark, text.is_heading, "第一章 开始", "第一章开始", "第一章他走了。", "卷二", "他说第一章") == [True, True, False, True, False]


def test_versions_truth_and_numbers(spark):
    assert values(spark, text.is_newer(F.col("c0"), F.col("c1")), ("v1.10.0", "1.9"), ("1.0", "1.0.0"), ("2.0-beta", "1.9"), ("x", "1")) == [True, False, True, False]
    assert one(spark, text.truthy, "0", " No ", "yes", None) == [False, False, True, False]
    assert one(spark, text.chinese_number, "一万零五十", "十", "百二", "abc") == [10050, 10, 102, None]


def test_rewrite_folds_in_order_and_skips_bad_patterns(spark):
    rules = [(r"(\d)(\d)", "$2$1", True), ("[", "x", True), ("b", "$1", False), (r"(a)", "$1z", True)]
    assert one(spark, lambda c: text.rewrite(c, rules), "12ab") == ["21az$1"]
    assert text.java_replacement("$1x-${1}-$9", 1) == "-$1-"


def snippets(t, k, r=18):
    t = re.sub(r"\s+", " ", t).strip()
    out = []
    for m in re.finditer(re.escape(k), t, re.I):
        a, b = max(0, m.start() - r), min(len(t), m.end() + r)
        out.append(("..." if a else "") + t[a:b].strip() + ("..." if b < len(t) else ""))
    return out


def test_snippets(spark):
    texts = ["Word and WORD, a rather long tail of text that goes on and on word", "none", "wordword", ""]
    got = one(spark, lambda c: text.snippets(c, "word"), *texts)
    assert [[s["snippet"] for s in x] for x in got] == [snippets(t, "word") for t in texts]


def test_urls(spark):
    assert one(spark, urls.cookie_domain, "https://www.a.b.example/x", "http://a.b.com.cn/", "http://10.0.0.1:80/") == ["b.example", "b.com.cn", "10.0.0.1"]
    assert values(spark, urls.follows(F.col("c0"), F.col("c1")), ("http://h/1.html", "http://h/1_2.html"), ("http://h/1.html", "http://h/2.html"), ("http://h/1_2.html", "http://h/1_3.html")) == [True, False, True]
    assert [urls.resolve("http://h/a/b.html", x) for x in ("../c", "//o/x", "", "javascript:void(0)", "data:x", "d##$##y")] == ["http://h/c", "https://o/x", "http://h/a/b.html", "", "data:x", "http://h/a/d"]


@pytest.mark.parametrize(
    ("template", "page", "url"),
    [("/s?q={{key}}&p={{page}}", 2, "http://h/s?q=%E6%98%9F&p=2"), ("/s<,_{{page}}>.html", 1, "http://h/s.html"), ("/s<,_{{page}}>.html", 3, "http://h/s_3.html"), ('/s?q={{key}},{"charset":"gbk"}', 1, "http://h/s?q=%D0%C7"), ("/p/{{page-1}}", 4, "http://h/p/3")],
)
def test_url_templates(template, page, url):
    assert urls.analyze(template, "星", page, "http://h/", None)["url"] == url


def test_url_options_and_headers():
    r = urls.analyze("/s,{'method':'post','body':'q={{key}}','headers':{'A':'1'},'retry':2}", "k", 1, "http://h/", '{"a":"0","B":"2"}')
    assert (r["http_method"], r["body"], r["retry"]) == ("POST", "q=k", 2)
    assert sorted((h["name"], h["value"]) for h in r["headers"]) == [("A", "1"), ("B", "2")]


def test_decoding_prefers_given_then_header_then_page():
    data = "<meta charset=gb2312>星".encode("gb18030")
    assert urls.decode_body(data, None, "text/html").endswith("星") and urls.decode_body("é".encode("latin-1"), None, "text/html; charset=iso-8859-1") == "é"
    assert urls.decode_body(None, None, None) is None and urls.decode_body(b"x", "no-such", None) == "x"
