"""Splitting and packing on their edge cases and against brute force."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import packing, split


@settings(max_examples=200, deadline=None)
@given(st.text("ab。.\n 星", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_pieces_rebuild_the_text(text, limit, overlap):
    pieces = split.split_points(text, limit, overlap)
    assert all(b - a <= limit for a, b in pieces)
    assert text[: pieces[0][1]] + "".join(text[a + overlap : b] for a, b in pieces[1:]) == text
    assert all(c == b - overlap for (a, b), (c, d) in zip(pieces, pieces[1:]))


def test_cuts_lie_at_the_last_boundary_under_the_limit():
    text = "一句话。" * 30 + "\n" + "x" * 100
    pieces = split.split_points(text, 50, 5)
    assert all(text[b - 1] in "。\n" for a, b in pieces if b < 120)
    assert split.split_points("x" * 100, 50, 5)[0] == (0, 50)


def test_split_nulls_repeats_and_other_columns(spark):
    d = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "a" * 9, "t"), (3, "a" * 9, "t"), (4, "短", "t")], "id bigint, body string, piece string")
    out = split.split_texts(d, "t", "id", "body", limit=4, overlap=1)
    assert out.filter("row_id = 3").count() == 2 * 3 and out.filter("row_id in (1, 2, 4)").count() == 3
    assert sorted(r["row_id"] for r in split.oversized_rows(out).collect()) == [3, 3]
    assert split.split_texts(d.limit(0), "t", "id", "body").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12))
def test_patterns_use_every_item_once_and_fit(histogram):
    plan = packing.plan_patterns(histogram, (10, 20, 40))
    used = {}
    for got, repeats, length in plan:
        assert sum(s * n for s, n in got.items()) <= length and repeats > 0
        for s, n in got.items():
            used[s] = used.get(s, 0) + n * repeats
    assert used == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(r for _, r, _ in plan) <= 1 + 1.7 * total / 40


def test_packing_places_every_token(spark):
    rows = [(k, (k * 37) % 90 + 1, "t") for k in range(500)] + [(900, 250, "t"), (901, 200, "t"), (902, None, "t"), (903, 5, " "), (904, 5, None), (905, 0, "t")]
    d = spark.createDataFrame(rows, "doc_id bigint, n bigint, text string")
    out = packing.pack(d, "doc_id", "n", "text", capacity=100, lengths=(25, 50, 100), bucket_rows=10)
    fill = out.groupBy("container_id", "container_length").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("u")).collect()
    assert all(r["u"] <= r["container_length"] for r in fill) and len({r["container_id"] for r in fill}) == len(fill)
    sizes = {r["doc_id"]: r["u"] for r in out.groupBy("doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("u")).collect()}
    assert sizes == {k: n for k, n, _ in rows[:502]}
    assert out.filter("doc_id < 900").groupBy("doc_id").count().filter("count > 1").count() == 0
    assert len(fill) <= 1.1 * sum(sizes.values()) / 100 + 1
    assert packing.pack(d.limit(0), "doc_id", "n", "text").count() == 0
