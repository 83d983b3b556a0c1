"""Shared text helpers of the subpackage."""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import cache

import numpy as np
from pyspark.sql import SparkSession

HAN = "㐀-䶿一-鿿豈-﫿"
TOKEN = re.compile(rf"[{HAN}]|[^\W\d_{HAN}]+|\d+")


def simplified_table(spark: SparkSession) -> dict[str, str]:
    """Traditional to simplified ideographs, by the rule set of the ICU library that Spark ships."""
    every = "".join(map(chr, range(0x4E00, 0xA000)))
    plain = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Hant-Hans").transliterate(every)
    return {a: b for a, b in zip(every, plain) if a != b} if len(plain) == len(every) else {}


@cache
def _fold_table() -> dict[int, str]:
    """By rule from the Unicode data: letters and digits without width, accents and case; marks and format characters vanish."""
    out = {}
    for cp in range(0x80, 0x2FA20):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x4E00 <= cp <= 0x9FFF:
            continue
        kind = unicodedata.category(chr(cp))
        if kind in ("Mn", "Cf"):
            out[cp] = ""
        elif kind[0] in "LNS":
            flat = "".join(c for c in unicodedata.normalize("NFKD", chr(cp).lower()) if not unicodedata.combining(c))
            if flat != chr(cp):
                out[cp] = flat
    return out


def fold_table(simplified: dict[str, str]) -> dict[int, str]:
    return _fold_table() | {ord(a): b for a, b in simplified.items()}


def folded(text: str, table: dict[int, str]) -> str:
    """Lower case, compatibility forms and accents flattened, ideographs simplified."""
    return text.lower() if text.isascii() else text.lower().translate(table)


_WORDS: dict[str, int] = {}


def token_ids(words: list[str]) -> np.ndarray:
    """Stable 32-bit numbers of words; an ideograph keeps its code point."""
    known = _WORDS
    if len(known) > 500_000:
        known.clear()
    out = np.empty(len(words), dtype=np.uint64)
    for k, w in enumerate(words):
        n = known.get(w)
        if n is None:
            n = known[w] = ord(w) if len(w) == 1 else zlib.crc32(w.encode()) | 0x100000000
        out[k] = n
    return out


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram, mixed so that minima are spread evenly."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the last of equals) of every window of hashes.

    Any run of window + k - 1 equal tokens shares at least one position's hash.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(at + np.arange(len(at)))
