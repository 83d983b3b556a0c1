"""Filling containers of fixed capacity (problem 8): variable-capacity best fit.

Token counts are small integers, so all documents of one size are alike. The
driver sees only the histogram of sizes (at most `capacity` rows whatever the
corpus), packs it, and hands back patterns: a multiset of sizes and how many
containers use it. Opening a container considers every permitted length jointly
and takes the one of least cost (a fixed price per container plus its unused
space, so few large containers win while enough items remain); best fit fills it
with the largest size that still fits; at last each container is downsized to
the smallest permitted length that holds its contents. Documents then meet their
container by their rank within their size.

Ranks need no global sort: rows of a size are spread over hash buckets whose number
follows the commonest size, bucket counts are summed into offsets by a join, and row
numbers are taken inside a bucket, so a size that holds a third of all documents is
still spread out.

Defined results
- null or blank texts, null sizes and sizes under 1 are left out.
- a document above the capacity is split: full containers of its own, then a
  remainder that is packed like any item (piece_no numbers the parts).
- repeated rows and ties: each row is an item; ids are expected to be unique.
- an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, piece_no int, token_start bigint, token_end bigint, container_id bigint, container_length int"


def _fill(sizes: list[int], left: dict[int, int], length: int) -> dict[int, int]:
    """Best fit on the histogram: again and again the largest size that fits the gap."""
    got: dict[int, int] = {}
    gap, k = length, len(sizes)
    while gap > 0:
        k = bisect.bisect_right(sizes, gap, 0, k) - 1
        while k >= 0 and left[sizes[k]] - got.get(sizes[k], 0) <= 0:
            k -= 1
        if k < 0:
            break
        s = sizes[k]
        n = min(gap // s, left[s] - got.get(s, 0))
        got[s] = got.get(s, 0) + n
        gap -= n * s
    return got


def plan_patterns(histogram: dict[int, int], lengths: tuple[int, ...], container_cost: float | None = None) -> list[tuple[dict[int, int], int, int]]:
    """(sizes with their number, repeats, downsized length) until the histogram is used up.

    Every pattern exhausts at least one size or repeats as often as it can, so the
    plan is bounded by the number of sizes, not of documents.
    """
    lengths = tuple(sorted(lengths))
    price = float(lengths[-1]) if container_cost is None else container_cost
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes, plan = sorted(left), []
    while sizes:
        largest, best = sizes[-1], None
        for length in (x for x in lengths if x >= largest):
            rest = dict(left)
            rest[largest] -= 1
            got = _fill(sizes, rest, length - largest)
            got[largest] = got.get(largest, 0) + 1
            used = sum(s * n for s, n in got.items())
            cost = (price + length) / used
            if best is None or cost < best[0]:
                best = (cost, got, used)
        _, got, used = best
        repeats = min(left[s] // n for s, n in got.items())
        plan.append((got, repeats, next(x for x in lengths if x >= used)))
        for s, n in got.items():
            left[s] -= n * repeats
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
    return plan


def _intervals(plan: list[tuple[dict[int, int], int, int]], first: int) -> dict[int, dict[str, np.ndarray]]:
    """Of each size: the first rank of every pattern that uses it, copies a container, first container, length."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    container = first
    for got, repeats, length in plan:
        for s, n in got.items():
            out.setdefault(s, []).append((used.get(s, 0), n, container, length))
            used[s] = used.get(s, 0) + n * repeats
        container += repeats
    return {s: dict(zip(("rank", "copies", "container", "length"), np.array(v, dtype=np.int64).T)) for s, v in out.items()}


def pack(df: DataFrame, id_col: str, size_col: str, text_col: str | None = None, capacity: int = 2048, lengths: tuple[int, ...] = (512, 1024, 2048), bucket_rows: int = 200_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The container of every document (of every part of an oversized one).

    bucket_rows: documents of one size that are numbered in one task, about; the commonest
    size decides the number of buckets.
    """
    lengths = tuple(sorted({x for x in lengths if x < capacity} | {capacity}))
    rows = df.filter(F.col(size_col) >= 1)
    if text_col:
        rows = rows.filter(F.col(text_col).rlike(r"[^\s \u3000\ufeff]"))
    rows = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(size_col).cast("bigint").alias("n"))
    rows = rows.withColumn("full", F.expr(f"n div {capacity}")).withColumn("size", (F.col("n") % capacity).cast("int"))

    sizes = rows.groupBy("size").agg(F.count("*").alias("items"), F.sum("full").alias("fulls")).toPandas().sort_values("size")  # at most `capacity` rows
    histogram = {int(s): int(n) for s, n in zip(sizes["size"], sizes["items"]) if s > 0}
    places = _intervals(plan_patterns(histogram, lengths), first=0)
    packed = sum(len(v["rank"]) for v in places.values())
    # full containers of oversized documents are numbered downwards from -1, so that both kinds stay apart
    first_full = dict(zip(map(int, sizes["size"]), map(int, sizes["fulls"].cumsum() - sizes["fulls"]))) if len(sizes) else {}
    buckets = max(1, -(-max(map(int, sizes["items"]), default=1) // bucket_rows)) * 16
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))

    counts = rows.groupBy("size", "bucket").agg(F.count("*").alias("items"), F.sum("full").alias("fulls"))
    of_size = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("items").over(of_size), F.lit(0)).alias("before"), F.coalesce(F.sum("fulls").over(of_size), F.lit(0)).alias("full_before"))
    if buckets * len(sizes) <= broadcast_rows:  # beyond it both sides are shuffled by size and bucket, as the ranks are
        offsets = F.broadcast(offsets)

    in_bucket = Window.partitionBy("size", "bucket").orderBy("doc_id")
    ranked = rows.withColumn("k", F.row_number().over(in_bucket) - 1).withColumn("f", F.sum("full").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
    ranked = ranked.join(offsets, ["size", "bucket"])
    if any(first_full.values()):
        starts = F.create_map(*[F.lit(x) for s, n in first_full.items() for x in (s, n)])
        ranked = ranked.withColumn("full_before", F.when(F.col("full") > 0, F.col("full_before") + F.element_at(starts, F.col("size"))).otherwise(F.col("full_before")))

    @F.pandas_udf("struct<container_id bigint, container_length int>")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ids, lens = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int32)
        s, r = size.to_numpy(), rank.to_numpy()
        for value in np.unique(s):
            at = np.flatnonzero(s == value)
            p = places[int(value)]
            k = np.searchsorted(p["rank"], r[at], side="right") - 1
            ids[at] = p["container"][k] + (r[at] - p["rank"][k]) // p["copies"][k]
            lens[at] = p["length"][k]
        return pd.DataFrame({"container_id": ids, "container_length": lens})

    rest = ranked.filter(F.col("size") > 0)
    if packed:
        rest = rest.withColumn("c", place(F.col("size").cast("bigint"), F.col("before") + F.col("k")))
    else:
        rest = rest.withColumn("c", F.lit(None).cast("struct<container_id bigint, container_length int>"))
    rest = rest.select("doc_id", F.col("full").cast("int").alias("piece_no"), (F.col("full") * capacity).alias("token_start"), F.col("n").alias("token_end"), "c.container_id", "c.container_length")
    fulls = ranked.filter(F.col("full") > 0).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)))
    fulls = fulls.select(
        "doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("token_start"), ((F.col("piece_no").cast("bigint") + 1) * capacity).alias("token_end"),
        (-1 - (F.col("full_before") + F.col("f") + F.col("piece_no"))).cast("bigint").alias("container_id"), F.lit(capacity).cast("int").alias("container_length"),
    )
    return rest.unionByName(fulls)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and unused space by permitted length."""
    one = packed.groupBy("container_id", "container_length").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count("*").alias("parts"))
    return one.groupBy("container_length").agg(
        F.count("*").alias("containers"), F.sum("used").cast("bigint").alias("tokens"), F.sum(F.col("container_length").cast("bigint") - F.col("used")).cast("bigint").alias("unused"), F.max("used").cast("bigint").alias("fullest"), F.sum("parts").cast("bigint").alias("parts")
    )
