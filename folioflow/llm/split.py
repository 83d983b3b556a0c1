"""Splitting oversized texts at natural boundaries (problem 2).

Method: prefix sums of token lengths give every token's character offset; the
ends of paragraphs and sentences form sorted boundary arrays over them. Each cut
is the last boundary at or under the limit, found by binary search; the next
piece steps back by the overlap. Where no boundary lies in the window, the last
token end is used, and a hard cut where a single token is longer than the limit.

Defined results
- null or empty text: one piece with the text as it is (piece_no 0, offsets 0..len or 0..0).
- a text of at most `limit` characters: one piece, the whole text, never sent to Python.
- repeated rows: each row gives its own pieces; extra columns are ignored.
- an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "table_name string, row_id bigint, piece_no int, start_pos int, end_pos int, piece string"

_TOKEN = re.compile(r"[^\W\d_㐀-鿿]+|\d+|\s+|.", re.S)
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n| | )+[ \t　 ]*")
_SENTENCE = re.compile(r"(?:[。！？!?…]+|\.+(?=[\s”’\"'»)\]]|$))[”’\"'»）)\]】」』]*\s*")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted end offsets of paragraphs, sentences and tokens."""
    lengths = np.fromiter((m.end() - m.start() for m in _TOKEN.finditer(text)), dtype=np.int64)
    tokens = np.cumsum(lengths)
    paragraphs = np.fromiter((m.end() for m in _PARAGRAPH.finditer(text)), dtype=np.int64)
    sentences = np.fromiter((m.end() for m in _SENTENCE.finditer(text)), dtype=np.int64)
    return paragraphs, sentences, tokens


def _last(ends: np.ndarray, low: int, high: int) -> int:
    """The last offset in (low, high], or 0."""
    k = int(np.searchsorted(ends, high, side="right")) - 1
    return int(ends[k]) if k >= 0 and ends[k] > low else 0


def split_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of every piece; consecutive pieces share `overlap` characters.

    A paragraph end is preferred where it leaves the piece at least half full,
    then the last sentence end, then any paragraph end, then a token end.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    paragraphs, sentences, tokens = boundaries(text)
    pieces, start = [], 0
    while n - start > limit:
        high, low = start + limit, start + overlap
        cut = (
            _last(paragraphs, max(low, start + limit // 2), high)
            or _last(sentences, low, high)
            or _last(paragraphs, low, high)
            or _last(tokens, low, high)
            or high
        )
        pieces.append((start, cut))
        start = cut - overlap
    pieces.append((start, n))
    return pieces


def split_texts(df: DataFrame, table_name: str, id_col: str, text_col: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """One row per piece; only texts over the limit go through Python."""
    rows = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("body"))
    size: Column = F.coalesce(F.length("body"), F.lit(0))
    whole = rows.filter(size <= limit).select(
        F.lit(table_name).alias("table_name"), "row_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), size.alias("end_pos"), F.col("body").alias("piece")
    )
    return whole.unionByName(split_oversized(rows, table_name, "row_id", "body", limit, overlap))


def split_oversized(df: DataFrame, table_name: str, id_col: str, text_col: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """The pieces of the texts over the limit only."""
    long = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("body")).filter(F.length("body") > limit)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row_id, body in zip(batch["row_id"], batch["body"]):
                for k, (a, b) in enumerate(split_points(body, limit, overlap)):
                    out.append((table_name, row_id, k, a, b, body[a:b]))
            yield pd.DataFrame(out, columns=["table_name", "row_id", "piece_no", "start_pos", "end_pos", "piece"])

    return long.mapInPandas(cut, SCHEMA)


def oversized_rows(pieces: DataFrame) -> DataFrame:
    """Rows that needed a second piece, from the pieces themselves: no shuffle."""
    return pieces.filter(F.col("piece_no") == 1).select("table_name", "row_id")
