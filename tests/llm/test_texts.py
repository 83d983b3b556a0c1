"""Leaks, truncation, pairs and matching on made data."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import leakage, matching, pairs, truncation
from folioflow.llm._text import gram_hashes, winnow


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=12, max_size=60), st.integers(0, 40), st.integers(2, 5), st.integers(1, 5))
def test_winnowing_meets_every_long_shared_span(ids, at, k, window):
    span = ids[at : at + k + window - 1]
    if len(span) < k + window - 1:
        return

    def prints(x):
        grams = gram_hashes(np.array(x, dtype=np.uint64), k)
        return {int(h) for h in grams[winnow(grams, window)]}

    assert prints(ids) & prints([9, 9, *span, 8, 8])


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_leaks_whole_partial_and_changed(spark):
    rng = random.Random(1)
    items = {k: words(rng, 60) for k in range(6)}
    han = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏") for _ in range(90))
    items[6] = han
    filler = lambda n: words(rng, n)
    part = items[1].split()
    changed = items[2].split()
    changed[10], changed[25] = "colour", "grey"
    docs = [(0, items[0]), (1, f"{filler(30)} {' '.join(part[5:30])} {filler(30)}"), (2, f"{filler(5)} {' '.join(changed)}"), (3, f"{' '.join(part[:12])} {filler(50)}"), (4, f"前言{han[10:35]}，中间{han[50:75]}后记"), (5, f"前言{han[10:30]}后记"), (6, filler(200)), (7, None), (8, ""), (9, items[0].upper())]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame([(k, v, "x") for k, v in items.items()] + [(7, None, "x")], "item_id bigint, text string, matched string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, e).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (4, 6), (9, 0)]
    assert leakage.find_leaks(d.limit(0), e).count() == 0 and leakage.find_leaks(d, e.limit(0)).count() == 0
    assert sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, e, broadcast_rows=1).collect()) == got


def test_leaks_in_many_documents_and_of_repeated_items(spark):
    rng = random.Random(8)
    item, again = words(rng, 80), words(rng, 60)
    part = " ".join(item.split()[20:45])
    docs = [(k, f"{words(rng, 30)} {part} {words(rng, 30)}") for k in range(12)] + [(20, f"{words(rng, 20)} {again}")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame([(0, item), (1, again), (2, again), (3, again)], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, e).collect())
    assert got == [(k, 0) for k in range(12)] + [(20, 1), (20, 2), (20, 3)]


def test_truncation(spark):
    rng = random.Random(2)
    sentence = lambda: f"The {rng.choice(['smith', 'pilot', 'baker'])} of the valley kept the {rng.choice(['silver', 'broken', 'little'])} lantern behind the door."
    whole = [" ".join(sentence() for _ in range(4)) for _ in range(80)]
    signed = [f"{w}\nPosted by {n}" for w, n in zip(whole[:6], ["Ann", "Bo", "Cy", "Di", "Ed", "Flo"])]
    cut = [w[: -rng.randint(3, 30)].rstrip(".") for w in whole[:20]]
    cut = [c if not c.endswith(".") else c[:-4] for c in cut] + [whole[0] + " The smith of the val (continue reading)"]
    rows = [(k, t, f"s{k % 2}") for k, t in enumerate(whole + signed + cut)] + [(900, None, "s0"), (901, " ", "s0")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = truncation.cut_documents(d)
    got = {r["doc_id"] for r in out.collect() if r["cut"]}
    assert got == set(range(len(whole) + len(signed), len(whole) + len(signed) + len(cut)))
    share = truncation.cut_share(out).collect()
    assert sum(r["documents"] for r in share) == len(rows) - 2 and sum(r["cut_documents"] for r in share) == len(cut)
    assert truncation.cut_documents(d.limit(0)).count() == 0


def test_broken_pairs(spark):
    rng = random.Random(4)
    people, things = ["Arden", "Bela", "Corin", "Dara", "Elin"], ["lantern", "ledger", "compass", "violin"]

    def content():
        return " ".join(f"It is said that {rng.choice(people)} carried a copy of the {rng.choice(things)} across the square at noon, and {rng.choice(people)} counted {rng.randrange(999)} lamps along the quay." for _ in range(6))

    def answer():
        return " ".join(f"{rng.choice(people)} learns that the {rng.choice(things)} is a copy and suspects the widow." for _ in range(rng.randint(1, 3)))

    requests, answers, truth = [], [], {}
    for k in range(400):
        c, a, points = content(), answer(), [f"{rng.choice(people)} holds the {rng.choice(things)}"]
        if k % 3 == 0 and k % 40 >= 5:  # other languages are learnt from the corpus itself
            who = rng.choice(["苏岚", "顾策", "洛霁"])
            c = "。".join(f"{who}数了数，一共{rng.randrange(999)}枚铜钱，把{rng.choice(['竹简', '书匣', '长枪'])}放在桌上，往临云台去了" for _ in range(6)) + "。"
            a, points = f"{who}在临云台得到{rng.choice(['竹简', '书匣', '长枪'])}，由此追查铜钱的来历。", [f"{who}持有长枪"]
        kind = ["empty", "truncated", "refusal", "copied", "other_language"][k % 40] if k % 40 < 5 else None
        if kind == "empty":
            a, points = rng.choice(["", "N/A", "null"]), []
        elif kind == "truncated":
            a = a[: rng.randint(20, 40)].rstrip(". ") + " th"
        elif kind == "refusal":
            a, points = rng.choice(["I’m sorry, but I can’t help with this text.", "As a language model, I am unable to provide a summary."]), []
        elif kind == "copied":
            a = ". ".join(c.split(". ")[:3]) + "."
        elif kind == "other_language":
            a = "他在临云台得到破旧的竹简，由此追查药方的来历。"
        requests.append((k, "u", "b", str(k), c))
        answers.append((k, "u", "b", str(k), a, points))
        truth[k] = kind
    r = spark.createDataFrame(requests + requests[:3], "request_id bigint, user_ns string, book_url string, chapter_url string, content string")
    s = spark.createDataFrame(answers + [(990, "u", "b", "none", None, None)], "summary_id bigint, user_ns string, book_url string, chapter_url string, summary string, key_points array<string>")
    got = {x["summary_id"]: x["defect"] for x in pairs.defective_pairs(s, r).collect()}
    assert got.pop(990) == "empty"
    want = {k: v for k, v in truth.items() if v}
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.9 * len(want) and len(set(got) - set(want)) <= 8, (Counter(want.values()), Counter(v for k, v in got.items() if want.get(k) != v))
    assert pairs.defective_pairs(s.limit(0), r.limit(0)).count() == 0


HITS = "hit_id bigint, name string, author string, origin string, book_url string, intro string, kind string, last_chapter string, word_count string, book_source_urls array<string>, extra string"


def hit(k, name, author, origin, chapter=None, count=None, intro=None):
    return (k, name, author, origin, f"{origin}/{k if k < 900 else 900}", intro, None, f"第{chapter}章 x" if chapter else None, count, None, "e")


def test_matching(spark):
    rows = [
        hit(1, "The Silver Lantern of Marshgate", "Corin B. Fairley", "o1", 100, "200000"), hit(2, "The Silver Lantren of Marshgate", "Fairley, Corin B.", "o2", 103, "20.4万字"), hit(3, "THE SILVER LANTERN OF MARSHGATE (Novel)", "by C. B. Fairley", "o3", 99, "201000字"),
        hit(4, "The Silver Lantern of Marshgate 2", "Corin B. Fairley", "o4", 40, "90000"), hit(5, "The Silver Lantern of Marshgate", "Dara Q. Northby", "o5", 500, "900000"),
        hit(6, "星河剑客", "北砚秋", "o1", 300, "80万字"), hit(7, "星河劍客【完结】", "作者：北砚秋", "o2", 305, None), hit(8, "星河客剑", "北砚…", "o3", 301, "802000"), hit(9, None, None, "o4"), hit(10, "", "-", "o5"),
        hit(901, "Copy Lantern Story", "Elin Faro", "o1", 10, None), hit(902, "Copy Lantern Story", "Elin Faro", "o1", 10, None), hit(11, "Copy Lantern Story", "Elin Faro", "o2", 11, None),
    ]
    d = spark.createDataFrame(rows, HITS)
    got = {(r["hit_id_a"], r["hit_id_b"]) for r in matching.match_hits(d).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (6, 7), (6, 8), (7, 8), (11, 901), (11, 902)}
    assert matching.match_hits(d.limit(0)).count() == 0
    assert {(r["hit_id_a"], r["hit_id_b"]) for r in matching.match_hits(d, block_limit=1).collect()} <= got


def test_one_to_one_factors_decide_between_rivals(spark):
    d = spark.createDataFrame([(1, 2, 10, 20, 3.0), (1, 3, 10, 20, 2.0), (4, 3, 10, 20, 2.5)], "a bigint, b bigint, oa bigint, ob bigint, prior double")
    belief = {(r["a"], r["b"]): r["belief"] for r in matching.propagate(d, iterations=20).collect()}
    assert belief[1, 2] > 0 and belief[4, 3] > 0 and belief[1, 3] < 0


def test_planted_cuts_are_found_in_real_documents(spark, sf_dir):
    """Closed documents of the table, every fifth cut within a word or sentence, some with a mark; lists and signatures stay whole."""
    from folioflow.sources.tables import table

    rng, rows, planted = random.Random(5), [], set()
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    whole = {r["doc_id"] for r in truncation.cut_documents(docs).collect() if not r["cut"]}
    for r in docs.select("doc_id", "text", "source").collect():
        if r["doc_id"] not in whole:
            continue
        t = r["text"]
        if r["doc_id"] % 5 == 0 and len(t) > 60 and t.strip()[-1] in "。.！!？?":
            at = rng.randrange(30, len(t) - 1)
            while at > 10 and not (t[at - 1].isalpha() and t[at].isalpha()):
                at -= 1
            if at > 10 and "\n" not in t[at - 10 : at + 1]:
                t = t[:at] + rng.choice(["", "", "…", "……阅读全文", " (continue reading)"])
                planted.add(r["doc_id"])
        rows.append((r["doc_id"], t, r["source"]))
    out = truncation.cut_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = {r["doc_id"] for r in out.collect() if r["cut"]}
    both = len(got & planted)
    assert len(planted) > 50 and both >= 0.95 * len(planted) and both >= 0.95 * len(got), (len(planted), len(got), both)


def test_marks_behind_long_runs_and_words_like_marks(spark):
    body = "The pilot of the valley kept the silver lantern behind the door. "
    rows = [(k, body * 3, "s") for k in range(30)] + [(100, body + "The pilot of the val" + "." * 700, "s"), (101, body + "The pilot of" + " " * 900 + "(read more)", "s"), (102, body + "He said nothing more.", "s"), (103, body + "x" * 900 + " of", "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in truncation.cut_documents(d).collect() if r["cut"]} == {100, 101, 103}


def test_splitting_hot_keys_loses_hardly_a_pair(spark, sf_dir):
    from folioflow.sources.tables import table

    hits = table(spark, sf_dir, "search_hits")
    pairs = lambda limit: {(r["hit_id_a"], r["hit_id_b"]) for r in matching.match_hits(hits, block_limit=limit).collect()}
    whole = pairs(10**9)
    assert len(whole) > 100 and len(pairs(3) & whole) >= 0.98 * len(whole)


def test_messages_that_cannot_settle_are_an_error(spark):
    import pytest

    d = spark.createDataFrame([(1, 2, 10, 20, 3.0), (1, 3, 10, 20, 2.0)], "a bigint, b bigint, oa bigint, ob bigint, prior double")
    with pytest.raises(RuntimeError):
        matching.propagate(d, iterations=1, tolerance=0.0)


def test_hot_keys_keep_every_pair(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(6), "", "", "", None, rng.choice([None, 40, 50, 90]), rng.choice([None, 1000.0, 1050.0, 9000.0]), [x for x in (101, 200, 300, 400 + 2 * (k % 9)) if rng.random() < 0.5]) for k in range(60)]
    d = spark.createDataFrame(rows, "node bigint, origin bigint, name string, family string, initial string, intro bigint, chapter int, words double, keys array<bigint>")
    want = set()
    for x in rows:
        for y in rows:
            near = sum(a is not None and b is not None and abs(a - b) <= most for a, b, most in ((x[6], y[6], 15), (x[7], y[7], 99)))
            shared = sum(1 + k % 2 for k in set(x[8]) & set(y[8]))
            if x[0] < y[0] and x[1] != y[1] and shared and shared + near >= 2:
                want.add((x[0], y[0]))
    for limit in (1, 4, 10**9):
        assert {(r["a"], r["b"]) for r in matching.candidates(d, limit).collect()} == want
    assert len(want) > 300


def test_splitting_hot_keys_changes_no_pair(spark, sf_dir):
    from folioflow.sources.tables import table

    hits = table(spark, sf_dir, "search_hits")
    pairs = lambda limit: {(r["hit_id_a"], r["hit_id_b"]) for r in matching.match_hits(hits, block_limit=limit).collect()}
    assert pairs(1) == pairs(10**9)


def test_far_last_chapters_are_weighed(spark):
    intro = "The keeper of the lantern walks the marsh road until the town is gone"
    rows = [hit(1, "The Silver Lantern of Marshgate", "Corin B. Fairley", "o1", 100, "200000", intro), hit(2, "The Silver Lantern of Marshgate", "Corin B. Fairley", "o2", 160, "201000", intro), hit(3, "The Silver Lantern of Marshgate", "Dara Q. Northby", "o3", 160, "900000")]
    assert {(r["hit_id_a"], r["hit_id_b"]) for r in matching.match_hits(spark.createDataFrame(rows, HITS)).collect()} == {(1, 2)}
