"""The rule language on its golden cases."""

from __future__ import annotations

import pytest

from folioflow.rules import dom, engine, jsonpath

HTML = '<div><a href="/1" data-id="x">A</a><a href="/2">B</a><a href="/3">C</a><a href="/4">D</a></div><ul class="mod block"><li>1<li>2</ul>'


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        ("a[1:2]@text", ["B", "C"]), ("a[!1,2]@text", ["A", "D"]), ("a[-1:0]@text", ["D", "C", "B", "A"]), ("a.0@attr[data-id]", ["x"]), ("a.0@href", ["/1"]), ("tag.a.-1@text", ["D"]),
        ("a!0:1@text", ["C", "D"]), ("class.mod block@li@text", ["1", "2"]), ("h1@text||a.1@text", ["B"]), ("a.0@text&&a.2@text", ["A", "C"]), ("a[0,1]@text%%a[2,3]@text", ["A", "C", "B", "D"]), ("text.C@text", ["C"]), ("no[", []), ("div@children@text", ["A", "B", "C", "D"]),
    ],
)
def test_chains(rule, expected):
    assert engine.css_values(dom.parse(HTML), rule) == expected


def test_combinators_inside_brackets_do_not_split():
    body = '<div data-x="a&&b">in</div><span>out</span>'
    assert engine.css_values(dom.parse(body), 'div[data-x="a&&b"]@text||span@text') == ["in"]


@pytest.mark.parametrize(("rule", "body", "mode"), [("@css:a", None, "css"), ("//a", None, "xpath"), ("$.a", None, "json"), (":a", None, "regex"), ("name", '{"a":1}', "json"), ("name", "<p>", "css"), ("<js>x</js>", None, "script")])
def test_modes(rule, body, mode):
    assert engine.mode_of(rule, body) == mode


@pytest.mark.parametrize(("posts", "expected"), [([r"\d+", "NUM"], "Hello World NUM NUM"), ([r"\d+", "NUM", "#"], "Hello World NUM 456"), ([r"\d+"], "Hello World 123 456"), ([r"\d+", ""], "Hello World  "), (["(", "x"], "Hello World 123 456")])
def test_post_replacement(posts, expected):
    assert engine.replaced("Hello World 123 456", posts) == expected


def test_rows_of_every_mode():
    fields = {"name": "text", "url": "href"}
    assert engine.rows(HTML, {"list": "a", **fields}, "http://h/b/")[0] == {"name": "A", "url": "http://h/1"}
    assert [r["name"] for r in engine.rows(HTML, {"list": "-a", **fields})] == ["D", "C", "B", "A"]
    assert engine.rows('{"d":[{"n":"x","id":3}]}', {"list": "$.d", "name": "n", "url": "/novel/{{$.id}}"}, "http://h/") == [{"name": "x", "url": "http://h/novel/3"}]
    assert engine.rows('<a href="/x">n</a>', {"list": ':<a href="([^"]+)">([^<]+)</a>', "name": "$2", "url": "$1", "other": "$0 $7"}, "http://h/") == [{"name": "n", "url": "http://h/x", "other": "$0 $7"}]
    assert engine.rows("<r><i a='1'>x</i></r>", {"list": "//i", "name": "@xpath:/@a"}) == [{"name": "1"}]


def test_variables_live_across_fields():
    r = engine.rows("<div><b class='name'>N</b></div>", {"list": "div", "put": "@put:{alias:.name@text}", "name": "Book-@get:{alias}"})
    assert r == [{"put": "", "name": "Book-N"}] or r == [{"put": None, "name": "Book-N"}]


def test_unknown_script_is_an_error_and_known_one_runs():
    with pytest.raises(engine.UnknownScript):
        engine.rows("<p>x</p>", {"list": "p", "name": "text@js:up"})
    assert engine.rows("<p>x</p>", {"list": "p", "name": "text@js:up"}, scripts={"up": lambda v, _: v.upper()})[0]["name"] == "X"


def test_tolerant_tree():
    root = dom.parse('<p>a<b>c</b><p>d<script>var x="</p>"</script><ul><li>1<li>2</ul><br>e&amp;f')
    assert [n.tag for n in dom.select(root, "li")] == ["li", "li"] and [len(list(n.texts())) for n in dom.select(root, "p")] == [2, 2]
    assert [n.tag for n in dom.select(root, "ul > li:nth-child(2)")] == ["li"] and dom.select(root, "li:not(:first-child)")[0].inner() == "2"


@pytest.mark.parametrize(
    ("path", "expected"),
    [("$.a[*].b", [1, 2]), ("$..b", [1, 2]), ("$.a[0:1]", [{"b": 1, "c": "x"}]), ("$.a[-1].b", [2]), ("$.a[?(@.b>1)].c", ["y"]), ("$['a'][0].c", ["x"]), ("$.zz", []), ("a", []), ("$.a[", [])],
)
def test_jsonpath(path, expected):
    assert jsonpath.query({"a": [{"b": 1, "c": "x"}, {"b": 2, "c": "y"}]}, path) == expected


def test_json_as_text():
    assert [jsonpath.as_text(x) for x in (None, True, 3, ["a", None, "b"], {"k": "v"})] == [None, "true", "3", "a\nb", '{"k":"v"}']


def test_extract_rows_skips_null_bodies(spark):
    docs = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "id bigint, body string")
    out = engine.extract_rows(docs, {"list": "a", "name": "text"}, "id", "body").collect()
    assert [(r["id"], r["pos"], r["name"]) for r in sorted(out, key=lambda r: r["pos"])] == [(1, k, n) for k, n in enumerate("ABCD")]


def test_search_falls_back_to_the_page_and_explore_to_search():
    rules, detail = {"list": "li", "name": "a@text", "book_url": "a@href"}, {"name": "h1@text", "author": "i@text"}
    page = "<h1>Title</h1><i>Who</i>"
    assert engine.search_rows(page, rules, detail, "http://h/b") == [{"name": "Title", "book_url": "http://h/b"}]
    assert engine.search_rows(page, rules, detail, "http://h/b", "http://h/.+") == [] and engine.search_rows("<i>x</i>", rules, detail, "http://h/b") == []
    listed = "<ul><li><a href='/1'>A</a></li></ul>"
    assert engine.explore_rows(listed, {"list": " "}, rules, "http://h/") == [{"name": "A", "book_url": "http://h/1"}]
    assert engine.explore_rows(page, None, rules, "http://h/") == [] and engine.explore_rows(listed, {"list": "ul", "name": "a@text"}, rules, "http://h/") == [{"name": "A"}]
