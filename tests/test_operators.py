"""Operators on small tables: nulls, ties, repeats, empty tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from folioflow.operators import graph, joins, knowledge, search, segment, sequence, store
from folioflow.sources import imports
from folioflow.streaming import streams


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


HIT = "ord bigint, name string, author string, book_url string, origin string, cover_url string, intro string, kind string, last_chapter string, update_time string, word_count string"


def test_merge_fills_and_keeps_arrival_order(spark):
    hits = spark.createDataFrame([(2, "N", "A", "u2", "s2", "c", None, "k2", None, None, None), (1, " n", "a ", "u1", "s1", None, None, "k1", None, None, None), (3, "n", "a", "u3", "s1", None, "i", None, None, None, None)], HIT)
    m = search.merged(hits).collect()
    assert len(m) == 1
    r = m[0]
    assert (r["name"], r["origin"], r["cover_url"], r["kind"], r["intro"], r["book_source_urls"]) == (" n", "s1", "c", "k1", "i", ["s1", "s2"])
    assert search.merged(hits.limit(0)).count() == 0


def test_soft_keeps_a_group_without_strong_hits(spark):
    hits = spark.createDataFrame([("g", "星辰变", "x"), ("g", "别的", "y"), ("h", "别的", "y")], "g string, name string, author string")
    assert rows(search.soft(hits, "星辰变", ["g"]), "g", "name") == [("g", "星辰变"), ("h", "别的")]
    assert rows(search.strict(hits, "星辰变"), "g") == [("g",)]


def test_page_and_category(spark):
    r = spark.range(7)
    p = search.page(r, [F.desc("id")], 2, 3).orderBy(F.desc("id")).collect()
    assert [x["id"] for x in p] == [4, 3, 2] and p[0]["has_more"] and p[0]["next_cursor"] == 5
    pages = spark.createDataFrame([("s", "玄幻推荐榜", 0), ("s", "玄幻奇幻榜推荐", 1), ("s", "都市", 2)], "s string, title string, pos int")
    assert rows(search.best_category(pages, "fantasy", "s"), "title") == [("玄幻推荐榜",)]


def test_store_operations(spark):
    old = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "k string, pos int, v int")
    new = spark.createDataFrame([("b", 0, 9), ("c", 1, 3)], "k string, pos int, v int")
    assert rows(store.upsert(old, new, ["k"]), "k", "v") == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(store.upsert_keeping_place(old, new, ["k"]), "k", "pos", "v") == [("a", 0, 1), ("b", 1, 9), ("c", 3, 3)]
    assert rows(store.delete(old, new, ["k"]), "k") == [("a",)]
    assert rows(store.upsert(old.limit(0), new, ["k"]), "k") == [("b",), ("c",)]
    p = spark.createDataFrame([("u", 5, 1, 0), ("u", 5, 2, 1), ("u", None, 3, 2)], "k string, t bigint, i int, place int")
    assert rows(store.newest_progress(p, ["k"], "t", ["i"], "place"), "k", "t", "i") == [("u", 5, 2)]


def test_group_names_and_markers(spark):
    d = spark.createDataFrame([("a; b，c、a",), (None,)], "g string")
    assert [r[0] for r in d.select(store.group_names(F.col("g"))).collect()] == [["a", "b，c"], []]
    assert [r[0] for r in d.select(store.with_marker(F.col("g"), "x")).collect()] == ["a,b，c,x", "x"]


def test_swap_replaces_a_table(spark, tmp_path):
    at = str(tmp_path / "t")
    store.swap(spark.range(3), at)
    store.swap(spark.read.parquet(at).filter("id > 0"), at)
    assert spark.read.parquet(at).count() == 2


def test_first_missing_against_python(spark):
    cases = {"a": [0, 1, 3], "b": [1], "c": [0, 0, 1], "d": [-1, 0], "e": [None]}
    d = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, i int")
    assert rows(sequence.first_missing(d, ["k"], "i"), "k", "first_missing") == [("a", 2), ("b", 0), ("c", 2), ("d", 1)]


def test_segments(spark):
    text = "前言一句\n\n第一章 起\r\n甲\n乙\n\n第二章 承\n第三章 转\n丙"
    d = spark.createDataFrame([("b#", text), ("n", "没有标题\n两行"), ("e", ""), ("z", None)], "book_url string, text string")
    got = segment.chapters(d).orderBy("book_url", "index").collect()
    assert [(r["title"], r["content"]) for r in got if r["book_url"] == "b#"] == [("序章", "前言一句"), ("第一章 起", "甲\n乙"), ("第二章 承", ""), ("第三章 转", "丙")]
    raw = text.encode()
    assert all(raw[r["start_pos"] : r["end_pos"]].decode() == r["content"] for r in got if r["book_url"] == "b#")
    assert [(r["title"], r["url"]) for r in got if r["book_url"] != "b#"] == [("正文", "e#0"), ("正文", "n#0")] and got[0]["url"] == "b#0"


def test_sequence_columns(spark):
    d = spark.createDataFrame([([10, 11, 11], ["a", "b", "c"], ["x"], ["A b", "a-B", "c", ""])], "v array<int>, a array<string>, b array<string>, s array<string>")
    r = d.select(sequence.running_mean(F.col("v")).alias("m"), sequence.interleave(F.col("a"), F.col("b")).alias("i"), sequence.first_nonempty(F.filter("a", lambda x: x == "q"), F.col("b")).alias("f"), sequence.distinct_spellings(F.col("s")).alias("s")).first()
    assert (r["m"], r["i"], r["f"], r["s"]) == (10, ["a", "x", "b", "c"], ["x"], ["A b", "c"])


def test_prefix_domain_and_mentions(spark):
    links = spark.createDataFrame([("http://h/a/1",), ("http://h/ab/1",)], "chapter_url string")
    shelf = spark.createDataFrame([("http://h/a", 1), ("http://h", 2)], "book_url string, pos int")
    assert rows(joins.by_prefix(links, shelf), "chapter_url", "book_url") == [("http://h/a/1", "http://h/a"), ("http://h/ab/1", "http://h")]
    texts = spark.createDataFrame([(1, "张三见了李四"), (2, "")], "id int, t string")
    names = spark.createDataFrame([("李四",), ("王五",), ("张",)], "n string")
    assert rows(joins.mentions(texts, names, "t", "n").distinct(), "id", "n") == [(1, "李四")]


def test_relation_rules_in_order(spark):
    people, places = (spark.createDataFrame([(x,) for x in v], "name string") for v in (["甲", "乙"], ["城", "山"]))
    cases = [("甲", "乙", "friend", None, True, "keep", None), ("甲", "乙", "friend", None, False, "drop", "missing_evidence"), ("甲", "城", "friend", None, True, "drop", "person_location_relation"), ("城", "山", "包含", None, True, "redirect", "location_edge"), ("城", "山", "x", None, True, "drop", "location_edge_relation"), ("甲", "剑法", "学习", None, True, "redirect", "character_state"), ("甲", "乙", "owns", None, True, "drop", "person_item_relation"), ("甲", "乙", "friend", "路过", True, "drop", "transient_action"), ("甲", "乙", "know", None, True, "drop", "low_value_relation"), ("甲", "丙", "friend", None, True, "drop", "invalid_entity"), ("甲", "乙", "affiliation", None, True, "drop", "invalid_relation_kind"), (None, None, None, None, None, "drop", "missing_evidence")]
    d = spark.createDataFrame([(n, *c[:5]) for n, c in enumerate(cases)], "n int, source_name string, target_name string, kind_raw string, description string, has_evidence boolean")
    got = knowledge.classified(d, people, places).orderBy("n").collect()
    assert [(r["action"], r["reason"]) for r in got] == [c[5:] for c in cases]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("b", "c", 5), ("c", "c", 9)], "source string, target string, weight int")
    assert rows(graph.degrees(e), "node", "degree") == [("a", 2), ("b", 3), ("c", 1)]
    assert [(r["neighbour"], r["weight"]) for r in graph.ego_network(e, "b").collect()] == [("c", 5), ("a", 3)]
    p = spark.createDataFrame([("r", None), ("x", "r"), ("y", "x"), ("m", "n"), ("n", "m"), ("o", "gone")], "name string, parent string")
    assert rows(graph.hierarchy(p), "name", "depth", "path") == [("m", 0, "m"), ("n", 0, "n"), ("o", 0, "o"), ("r", 0, "r"), ("x", 1, "r/x"), ("y", 2, "r/x/y")]


def test_hierarchy_walks_to_the_last_level(spark):
    p = spark.createDataFrame([(f"p{k:02}", f"p{k - 1:02}" if k else None) for k in range(36)], "name string, parent string")
    assert {r["name"]: r["depth"] for r in graph.hierarchy(p).collect()} == {f"p{k:02}": k for k in range(36)}


def test_imports(spark):
    d = spark.createDataFrame([('[{"a":1},{"b":2},3]',), ('{"bookSources":[{"c":3}]}',), ('{"d":4}',), ("broken",), (None,)], "value string")
    assert sorted(json.dumps(json.loads(r["item"])) for r in imports.objects(d).collect()) == ['{"a": 1}', '{"b": 2}', '{"c": 3}', '{"d": 4}']
    bad = spark.createDataFrame([('[{"bookUrl":"1","origin":"o"}]{"bookUrl":"1","origin":"o"}{"bookUrl":"2"} {oops',), (None,)], "t string")
    assert imports.recovered(bad, "t").count() == 2
    assert imports.recovered(bad.select(F.lit("u").alias("who"), "t"), "t", row_key="who").filter("who = 'u'").count() == 2
    atom = spark.createDataFrame([("f", "<feed><entry><title>T</title><link href='u'/><updated>2024-05-01T00:00:00Z</updated></entry><entry><title><![CDATA[X]]></title></entry></feed>")], "source_url string, body string")
    got = imports.feed_items(atom).orderBy("ord").collect()
    assert [(r["title"], r["link"]) for r in got] == [("T", "u"), ("X", None)] and got[0]["published"] is not None


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿星".encode())
    (tmp_path / "b.txt").write_bytes("星辰".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes(b"")
    assert rows(imports.text_files(spark, str(tmp_path)), "text") == [("星",), ("星辰",)]


def test_gap_fold_over_two_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "k string, i int"
    for n, data in enumerate(([("a", 0), ("a", 2)], [("a", 1), ("b", 1)])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        s = streams.gap_fold(spark.readStream.schema(schema).parquet(src), "k", "i")
        streams.run_to_end(s, "fold", "update", str(tmp_path / "state"), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("k").agg(F.max("first_missing").alias("m"))
    assert rows(got, "k", "m") == [("a", 3), ("b", 0)]
