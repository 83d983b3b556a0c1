"""Evaluation texts leaking into training text (problem 9): winnowing.

Method: texts become tokens (an ideograph, a word or a number each; case, width,
accents and traditional forms flattened, punctuation dropped). Of every window of
k-gram hashes the least is kept, on both sides. The fingerprints of documents are
joined to those of the items, and each hit is extended both ways over equal tokens,
stepping over single changed words. A document shows an item if its two best
stretches hold 40 ideographs or 20 words.

There are two kinds of fingerprints. Long ones, whose window and gram together make
just 40 ideographs or 20 words, always count: every unchanged shared run of that
length is certain to be met and found, however many documents hold it. Short ones
(11 ideographs, 6 words) find shorter stretches and changed ones, and count only if
they are specific: a fingerprint is stock if items of more than two different texts
have it, or if far more documents hold it than hold the item's usual fingerprint (a
passage that leaked into many documents raises all its fingerprints alike, so it
stays specific). What this costs: two stretches each below the full length, or a
longer one with changed words, are passed over where the fingerprints in them are
mostly stock.

Every document is tokenised once for its fingerprints; of these only the ones items
have leave the scan. Counts and hits are joins and aggregations; only documents with
a hit that counts are read again to extend it. Neither fingerprints nor items are
gathered: the items' side of a join is broadcast where its counted rows allow it.

Defined results: null and blank texts show nothing; an item repeated under
another id gives a row for each; repeated documents each give rows; empty tables
give an empty result; texts are read whole whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._text import TOKEN, fold_table, folded, gram_hashes, simplified_table, token_ids, winnow
from folioflow.session import spread, written

SCHEMA = "doc_id bigint, item_id bigint, matched int, stretches int, first_token int"

#: (k, window, tokens that must agree behind a change, longest change) for ideographs and for words
CJK, WORDS = (8, 4, 6, 4), (4, 3, 4, 2)


def _is_han(ids: np.ndarray) -> np.ndarray:
    return (ids >= 0x3400) & (ids < 0x100000000)


_NONE = np.uint64(2**64 - 1)


def fingerprints(ids: np.ndarray, least_han: int = 40, least_words: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, whether long) of both families: grams of ideographs, and grams of words."""
    han = np.concatenate(([0], np.cumsum(_is_han(ids))))
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for (k, window, _, _), least, cjk in ((CJK, least_han, True), (WORDS, least_words, False)):
        long = (least * 5 // 8, least - least * 5 // 8 + 1)
        for (n, w), is_long in (((k, window), False), (long, True)):
            if len(ids) < n:
                continue
            share = han[n:] - han[:-n]
            fits = (share * 2 >= n) if cjk else (share * 2 < n)
            if not fits.any():
                continue
            h = gram_hashes(ids, n)
            at = winnow(np.where(fits, h, _NONE), w)
            at = at[fits[at]]
            out.append((h[at], at, is_long))
    if not out:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    return np.concatenate([h for h, _, _ in out]), np.concatenate([p for _, p, _ in out]), np.concatenate([np.full(len(h), x) for h, _, x in out])


def _run(a: list[int], b: list[int], i: int, j: int, step: int, anchor: int, most: int) -> tuple[int, int, list[int]]:
    """Where the run from (i, j) in the direction of step ends, and the positions in b that agree."""
    agreed: list[int] = []
    since = anchor
    while True:
        while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
            agreed.append(j)
            since += 1
            i += step
            j += step
        if since < anchor:
            return i, j, agreed
        for gap in range(1, most + 1):
            found = False
            for x, y in ((gap, gap), (gap, gap - 1), (gap - 1, gap), (gap, 0), (0, gap)):
                p, q = i + step * x, j + step * y
                if 0 <= p + step * (anchor - 1) < len(a) and 0 <= q + step * (anchor - 1) < len(b) and 0 <= p < len(a) and 0 <= q < len(b):
                    if all(a[p + step * n] == b[q + step * n] for n in range(anchor)):
                        i, j, since, found = p, q, 0, True
                        break
            if found:
                break
        else:
            return i, j, agreed


def stretches(doc: list[int], item: list[int], seeds: list[tuple[int, int]], anchor: int, most: int) -> list[tuple[int, int, int, list[int]]]:
    """(tokens that agree, first, last position in the document, agreeing positions in the item) of the separate stretches round the seeds."""
    found: list[tuple[int, int, int, list[int]]] = []
    covered: list[tuple[int, int, int, int]] = []
    for i, j in sorted(seeds):
        if any(a <= i <= b and c <= j <= d for a, b, c, d in covered):
            continue
        ri, rj, right = _run(doc, item, i, j, 1, anchor, most)
        li, lj, left = _run(doc, item, i - 1, j - 1, -1, anchor, most)
        covered.append((li + 1, ri - 1, lj + 1, rj - 1))
        found.append((len(left) + len(right), li + 1, ri - 1, left[::-1] + right))
    return found


def best_two(found: list[tuple[int, int, int, list[int]]], prints: np.ndarray, specific: np.ndarray, least_specific: float, least: int) -> list[tuple[int, int, int]]:
    """The two longest stretches that overlap neither in the document nor in the item, each with enough specific fingerprints or an unchanged run of `least` tokens.

    prints, specific: positions of the item's short fingerprints, in order, and which of them are specific.
    """
    best: list[tuple[int, int, int, int, int]] = []
    for size, first, last, at in sorted(found, key=lambda s: -s[0]):
        if any(first <= b[2] and b[1] <= last or at[0] <= b[4] and b[3] <= at[-1] for b in best):
            continue
        place = np.array(at)
        alone = len(place) >= least and bool((place[least - 1 :] - place[: len(place) - least + 1] == least - 1).any())
        held = specific[np.isin(prints, place)]
        if alone or len(held) and held.mean() >= least_specific:
            best.append((size, first, last, at[0], at[-1]))
            if len(best) == 2:
                break
    return [b[:3] for b in best]


def prints_of(texts: DataFrame, table: dict[int, str], least_han: int, least_words: int) -> DataFrame:
    """(id, gram, place, is_long, anew) of every fingerprint of (id, text); anew: the first of its text with this gram."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, parts = [], []
            for key, text in zip(batch["id"], batch["text"]):
                h, p, is_long = fingerprints(token_ids(TOKEN.findall(folded(text, table))), least_han, least_words)
                anew = np.zeros(len(h), dtype=bool)
                anew[np.unique(h, return_index=True)[1]] = True
                ids.append(np.full(len(h), key))
                parts.append((h.astype(np.int64), p, is_long, anew))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0)] * 4
            yield pd.DataFrame({"id": np.concatenate(ids) if ids else np.empty(0), "gram": columns[0], "place": columns[1], "is_long": columns[2].astype(bool), "anew": columns[3].astype(bool)}).astype({"id": "int64", "gram": "int64", "place": "int32"})

    return texts.mapInPandas(make, "id bigint, gram bigint, place int, is_long boolean, anew boolean")


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if its counted rows allow it; else its joins shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least_han: int = 40, least_words: int = 20, least_specific: float = 0.3, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, item_id, matched, stretches, first_token) of every document that shows an item."""
    spark = docs.sparkSession
    table = fold_table(simplified_table(spark))
    some = lambda df, key, text: df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).filter(F.length("text") > 0)
    corpus, asked = spread(some(docs, doc_id, doc_text)), some(items, item_id, item_text)

    own = written(prints_of(asked, table, least_han, least_words).join(asked.select("id", F.xxhash64("text").alias("copy")), "id"), "item_prints")
    grams = own.groupBy("gram").agg(F.count_distinct("copy").alias("owners"))  # an item repeated under another id owns its grams once
    known = written(prints_of(corpus, table, least_han, least_words).join(_bounded(own.select("gram").distinct(), broadcast_rows), "gram", "left_semi"), "doc_prints")
    held = known.groupBy("gram").agg(F.count_if("anew").alias("docs"))
    counted = own.join(grams, "gram").join(held, "gram", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    usual = counted.filter(~F.col("is_long")).groupBy("id").agg(F.median("docs").alias("usual"))
    counted = counted.join(usual, "id", "left").withColumn("specific", (F.col("owners") <= 2) & (F.col("docs") <= F.greatest(F.lit(3.0), 3 * F.coalesce("usual", F.lit(0.0)))))
    counted = written(counted.select("id", "gram", "place", "is_long", "specific"), "told_prints")

    telling = counted.filter("is_long or specific").select("gram", F.col("id").alias("item"), F.col("place").alias("there"))
    hits = known.select("id", "gram", "place").join(_bounded(telling, broadcast_rows), "gram")
    # one row for a document and an item: as many seeds as the document has fingerprints of this item
    seeds = written(hits.groupBy("id", "item").agg(F.collect_set(F.struct("place", "there")).alias("seeds")), "seeds")
    flags = counted.filter(~F.col("is_long")).groupBy(F.col("id").alias("item")).agg(F.array_sort(F.collect_list(F.struct("place", "specific"))).alias("prints"))
    shown = _bounded(asked.select(F.col("id").alias("item"), F.col("text").alias("item_text")), broadcast_rows // 10).join(flags, "item", "left")
    rows = corpus.join(_bounded(seeds, broadcast_rows // 10), "id").join(shown, "item")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: dict[int, tuple[np.ndarray, list[int], np.ndarray, np.ndarray]] = {}
        last: tuple[int | None, list[int]] = (None, [])
        for batch in batches:
            out = []
            for key, text, item, seeds, item_text, prints in zip(batch["id"], batch["text"], batch["item"], batch["seeds"], batch["item_text"], batch["prints"]):
                if item not in items:
                    if len(items) > 10_000:
                        items.clear()
                    t = token_ids(TOKEN.findall(folded(item_text, table)))
                    prints = [] if prints is None else prints
                    items[item] = (t, t.tolist(), np.array([p["place"] for p in prints], dtype=np.int64), np.array([p["specific"] for p in prints], dtype=bool))
                ids, tokens, places, specific = items[item]
                if last[0] != key:
                    last = (key, token_ids(TOKEN.findall(folded(text, table))).tolist())
                cjk = _mostly_han(ids)
                _, _, anchor, most = CJK if cjk else WORDS
                least = least_han if cjk else least_words
                best = best_two(stretches(last[1], tokens, [(x["place"], x["there"]) for x in seeds], anchor, most), places, specific, least_specific, least)
                total = sum(s[0] for s in best)
                if best and total >= least:
                    out.append((key, item, total, len(best), min(s[1] for s in best)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "matched", "stretches", "first_token"])

    return rows.select("id", "text", "item", "seeds", "item_text", "prints").mapInPandas(match, SCHEMA)


def _mostly_han(ids: np.ndarray) -> bool:
    return len(ids) > 0 and bool(_is_han(ids).mean() > 0.5)
