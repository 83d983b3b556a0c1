"""Detail, contents and content pages; codecs; further storage operations."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from folioflow.functions import codec
from folioflow.operators import store
from folioflow.rules import engine


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_detail_contents_and_content():
    page = "<div class='b'><h1>N</h1><a class='toc' href='/t'>x</a></div><div class='b'><h1>M</h1></div>"
    assert engine.info(page, {"init": ".b.1", "name": "h1@text", "toc_url": ".toc@href"}, "http://h/1") == {"name": "M", "toc_url": "http://h/1"}
    assert engine.info('{"d":{"n":"x"}}', {"init": "$.d", "name": "n"}) == {"name": "x"}
    toc = "<a href='/1'>one</a><a href='/2'>two</a><a href='/1'>again</a>"
    assert [(c["index"], c["title"], c["url"]) for c in engine.toc(toc, {"list": "a", "name": "text", "url": "href"}, "http://h/")] == [(0, "two", "http://h/2"), (1, "again", "http://h/1")]
    listed = '{"l":[{"t":"a","u":"/1"},{"t":"b","u":"/1"},{"t":"V","v":"true"}]}'
    got = engine.toc(listed, {"list": "$.l", "name": "t", "url": "u", "is_volume": "v"}, "http://h/")
    assert [(c["title"], c["is_volume"]) for c in got] == [("a", False), ("V", True)] and got[1]["url"] == "V2"
    text, following = engine.content("<p>a 1</p><p>b 22</p><a id='n' href='2.html'>next</a>", {"content": "p@text", "replace": r"##\d+##N", "next_url": "#n@href"}, "http://h/1.html")
    assert (text, following) == ("a N\nb N", "http://h/2.html")


def test_codecs(spark):
    d = spark.createDataFrame([("a b~é'",)], "x string")
    r = d.select(codec.uri_component(F.col("x")).alias("u"), codec.minutes(F.lit(0)).alias("m"), codec.minutes(F.lit(60_000 + 1_700_000_000_000)).alias("ms"), codec.reading_time(F.lit(3_720)).alias("t"), codec.clamp(F.lit(9), 1, 5).alias("c"), codec.recency(F.lit(5), F.lit(3)).alias("r")).first()
    assert (r["u"], r["m"], r["ms"], r["t"], r["c"], r["r"]) == ("a%20b~%C3%A9'", "1970-01-01 00:00", "2023-11-14 22:14", "1小时2分钟", 5, 6)
    key, iv = "0123456789abcdef", "fedcba9876543210"
    sealed = d.select(F.expr(f"base64(substring(aes_encrypt('text', '{key}', 'CBC', 'PKCS', '{iv}'), 17))").alias("s"))
    assert sealed.select(codec.aes_cbc_text(F.col("s"), key, iv)).first()[0] == "text"
    broken = spark.createDataFrame([(base64.b64encode(b"short").decode(),), ("%",), (None,)], "s string")
    assert [r[0] for r in broken.select(codec.aes_cbc_text(F.col("s"), key, iv)).collect()] == ["", "", ""]


def test_storage(spark):
    groups = spark.createDataFrame([("u", 1, "a", 0), ("u", 3, "b", 1)], "user_ns string, group_id bigint, name string, pos int")
    new = spark.createDataFrame([("u", 0, "c", 0), ("u", 3, "B", 1), ("u", 0, "d", 2), ("v", 0, "e", 0)], "user_ns string, group_id bigint, name string, pos int")
    assert rows(store.allocated(groups, new), "user_ns", "group_id", "name") == [("u", 1, "a"), ("u", 3, "B"), ("u", 4, "c"), ("u", 5, "d"), ("v", 1, "e")]
    shelf = spark.createDataFrame([("u", "x", "o", "n", None), ("u", "y", "o", "m", "k")], "user_ns string, book_url string, origin string, name string, kind string")
    moves = spark.createDataFrame([("u", "x", "z", "p", " ", "K")], "user_ns string, book_url string, new_url string, new_origin string, name string, kind string")
    assert rows(store.switched(shelf, moves, ["name", "kind"]), "book_url", "origin", "name", "kind") == [("y", "o", "m", "k"), ("z", "p", "n", "K")]
    left = store.cascade({"c": shelf.select("book_url")}, moves, ["book_url"])
    assert rows(left["c"], "book_url") == [("y",)]
    r = spark.createDataFrame([("a", 100, False), ("b", 50, True), ("c", None, False), ("d", 900_000, True)], "k string, t bigint, feed boolean")
    assert [x["k"] for x in store.recent(r, ["k"], "t", F.lit(1_000_000), F.col("feed")).collect()] == ["d", "a"]
