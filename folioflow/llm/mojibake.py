"""Garbled text from a wrong character encoding (problem 7): noisy-channel decoding.

A line is garbled if undoing some wrong decoding makes it far likelier under the
corpus. Method: the share of records that hold each character and each pair of
neighbours (a word of two ideographs, an accented letter with its neighbour) is
counted over all rows, and of characters by source too (most rows are clean, so
garbled characters are rare; a large source that garbles all its rows alike is
still one of many). A line whose characters are rare, or that shows the bytes of
UTF-8 as letters, is put back into bytes under every wrong charset; characters
that charset lacks, and U+FFFD, become wildcard bytes. A lattice without wildcards
has one path a right charset: its strict decoding. One with wildcards is read
under every right charset by Viterbi search over those shares, which restores lost
bytes. Readings of one step and of two (text garbled twice) compete by what they
end in; the likeliest wins if it beats the line itself by `margin`. A line that
holds U+FFFD is garbled even where no reading is good enough.

Only shares of characters and of pairs reach the driver: bounded by Unicode, and
by the pairs of a record over `least_share`. Parameters of the search: FILLERS
commonest characters a pattern of lost bytes, `beam` last characters a position.

Defined results: null and blank texts are not garbled; lines are split at "\n"
and numbered from 0; an all-ASCII line is never garbled; repeated rows each give
rows; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import spread, written

_TAG = re.compile(r"<[^<>]*>")
LINES = "table_name string, row_id bigint, line_no int, garbled string, restored string, channel string"

# Charsets text is wrongly read in, and charsets it was written in.
WRONG = ["cp1252", "cp1251", "gb18030", "big5", "cp932", "cp949", "koi8_r", "mac_roman", "cp1250", "cp437", "cp866"]
RIGHT = ["utf_8", "gb18030", "cp1252", "cp1251", "big5", "koi8_r", "cp932"]

#: mean log share of records under which characters are rare, however many records there are
RARE = -2.5

#: charsets searched for lost bytes
LOSSY = ("utf_8", "gb18030", "big5", "cp932", "cp1251", "koi8_r", "cp1252")

#: log odds a pair that few records hold loses against its rarer character
BACK = 2.0

#: the commonest characters tried for a byte pattern with lost bytes; the search costs as much for each
FILLERS = 24

#: single-byte charsets some of whose bytes have no character; decoders then keep the byte's own number
SINGLE = ("cp1252", "cp1250", "cp1251")


def byte_itself(error: UnicodeEncodeError) -> tuple[bytes, int]:
    """A character numbered like a byte stands for that byte."""
    part = error.object[error.start : error.end]
    if any(ord(c) > 0xFF for c in part):
        raise error
    return bytes(map(ord, part)), error.end


def texts_of(df: DataFrame, table_name: str, id_col: str, text_col: str, source: Column | None = None) -> DataFrame:
    """(table_name, row_id, text, source) of rows beyond ASCII; source: what decodes its rows alike, such as a host."""
    source = F.coalesce(source.cast("string"), F.lit("")) if source is not None else F.lit("")
    return df.select(F.lit(table_name).alias("table_name"), F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"), source.alias("source")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))


def corpus_counts(texts: DataFrame, least_share: float) -> tuple[dict[str, float], dict[int, float], int]:
    """Shares of characters beyond ASCII, of pairs of characters, and the number of records.

    A character counts as the lower of its share of all records and its mean share in the
    sources: what one large source garbles alike is no commoner than one source makes it.
    A pair is a word of two ideographs, or a letter with its neighbour; pairs in fewer than
    least_share of the records are left to their characters, so that at most the mean number
    of pairs a record has, over least_share, are kept, however many records there are.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[tuple[str, int]] = Counter()
        parts: list[np.ndarray] = []

        def frame() -> pd.DataFrame:
            pairs, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
            one = pd.DataFrame([(*k, n) for k, n in held.items()], columns=["source", "c", "n"]).astype({"c": "int64", "n": "int64"})
            held.clear()
            parts.clear()
            return pd.concat([one, pd.DataFrame({"source": None, "c": pairs, "n": n})], ignore_index=True)

        size = 0
        for batch in batches:
            for source, text in zip(batch["source"], batch["text"]):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
                held.update([(source, c) for c in np.unique(codes[codes > 0x7F]).tolist()])
                held[source, -1] += 1
                parts.append(np.unique(pair_keys(codes)))
                size += len(parts[-1])
                if size > 5_000_000 or len(held) > 500_000:
                    yield frame()
                    size = 0
        yield frame()

    counted = texts.select("source", "text").mapInPandas(count, "source string, c bigint, n bigint").groupBy("source", "c").agg(F.sum("n").alias("n"))
    counted = written(counted, "characters")  # read twice
    total = F.max(F.when(F.col("c") == -1, F.col("n"))).over(Window.partitionBy("source"))
    by_source = counted.filter(F.col("source").isNotNull()).withColumn("share", F.col("n") / total)
    single = by_source.groupBy("c").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).toPandas()  # at most a row per character of Unicode
    records, sources = next(((int(n), x) for c, n, x in zip(single["c"], single["n"], single["share"]) if c == -1), (0, 1.0))
    shares = {chr(c): min(max(n - 0.5, 0.1) / max(records, 2), x / sources) for c, n, x in zip(single["c"], single["n"], single["share"]) if c >= 0}
    wide = counted.filter(F.col("source").isNull() & (F.col("n") >= max(2.0, least_share * records))).select("c", "n").toPandas()
    return shares, {int(c): n / max(records, 2) for c, n in zip(wide["c"], wide["n"])}, records


def pair_keys(codes: np.ndarray) -> np.ndarray:
    """A number for every two neighbours of which one is beyond ASCII; digits are alike."""
    codes = np.where((codes >= 48) & (codes <= 57), 48, codes)
    a, b = codes[:-1], codes[1:]
    at = ((a >= 0x80) | (b >= 0x80)) & (a != 10) & (b != 10)
    return (a[at] << 21) | b[at]


def _torn() -> re.Pattern[str]:
    """A lead byte of UTF-8 with its next byte, as any wrong charset of single bytes shows them."""
    every = []
    for wrong in WRONG:
        if wrong in ("gb18030", "big5", "cp932", "cp949"):
            continue
        shown = {}
        for n in range(0x80, 0xF5):
            try:
                shown[n] = bytes([n]).decode(wrong)
            except UnicodeDecodeError:
                shown[n] = chr(n)
        lead, next_ = ("".join(re.escape(shown[n]) for n in part) for part in (range(0xC2, 0xF5), range(0x80, 0xC0)))
        every.append(f"[{lead}][{next_}]")
    return re.compile("|".join(every))


class Channel:
    """Log shares of characters and pairs, and the readings of a garbled line."""

    def __init__(self, shares: dict[str, float], pairs: dict[int, float] | None = None, records: int = 2):
        # what no record holds is as unlikely as the corpus can tell, but not ever less likely the larger it is
        self.floor = max(-12.0, -float(np.log(max(records, 2))) - 2.0)
        table = np.full(0x110000, self.floor, dtype=np.float32)
        for c, share in shares.items():
            table[ord(c)] = max(self.floor, np.log(max(share, 1e-12)))
        table[:0x80] = 0
        table[0x80:0xA0] = self.floor  # control characters, private use and lost characters are never likely
        table[0xFFFD] = self.floor
        table[0xE000:0xF900] = self.floor
        self.top = float(table[0x80:].max())
        self.table = table
        order = sorted(pairs or {})
        self.keys = np.array(order, dtype=np.int64)
        self.values = np.log(np.array([pairs[k] for k in order], dtype=np.float64)) if order else np.empty(0)
        self.pairs = dict(zip(order, self.values.tolist()))
        self.bytes_of: dict[str, dict[str, bytes]] = {}
        self.vocabulary = [c for c, n in sorted(shares.items(), key=lambda x: (-x[1], x[0])) if c != "\ufffd" and table[ord(c)] > self.floor]
        self.known: dict[str, dict] = {}
        self.torn = _torn()
        self.cyrillic = float(table[0x400:0x500].max())

    def within_reach(self, text: str, right: str, least: float) -> bool:
        """Whether a reading in a charset of single bytes can be plausible and score least: what `plausible` asks of it, told from the text."""
        if right == "cp1252":  # a letter may hide in the second byte of a wide character
            return sum(c >= "\x80" for c in text) <= sum(c.isascii() and c.isalpha() for c in _TAG.sub("", text))
        return right not in ("cp1251", "koi8_r") or 0.8 * self.cyrillic > least

    def rarity(self, text: str) -> float:
        """Mean log share of the characters beyond ASCII; 0 if there are none."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = codes[codes >= 0x80]
        return float(self.table[codes].mean()) if len(codes) else 0.0

    def score(self, text: str) -> float:
        """Mean log share of the pairs with a character beyond ASCII; 0 if there are none."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        keys = pair_keys(codes)
        if not len(keys):
            codes = codes[codes >= 0x80]
            return float(self.table[codes].mean()) if len(codes) else 0.0
        alone = np.minimum(self.table[keys >> 21], self.table[keys & 0x1FFFFF])
        if not len(self.keys):
            return float(alone.mean())
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return float(np.where(self.keys[at] == keys, np.minimum(self.values[at], alone), np.maximum(alone - BACK, self.floor)).mean())

    def lattice(self, text: str, wrong: str) -> list[int | None] | None:
        """The bytes of a text under the wrong charset; None for a byte that was lost."""
        cache = self.bytes_of.setdefault(wrong, {})
        out: list[int | None] = []
        lost = beyond = 0
        for c in text:
            if c < "\x80":
                out.append(ord(c))
                continue
            beyond += 1
            b = cache.get(c)
            if b is None:
                try:
                    b = c.encode(wrong)
                except UnicodeEncodeError:
                    b = bytes([ord(c)]) if ord(c) < 0x100 and wrong in ("cp1252", "cp1250", "cp1251") else b""
                cache[c] = b
            if c == "�" or not b:
                out.append(None)
                lost += 1
            else:
                out.extend(b)
        return out if lost * 4 <= beyond else None  # with more lost, any text would fit

    def _patterns(self, right: str) -> dict:
        """Characters of the corpus by their bytes under the right charset, with any byte unknown."""
        index = self.known.get(right)
        if index is None:
            index = {}
            for c in self.vocabulary:
                try:
                    b = c.encode(right)
                except UnicodeEncodeError:
                    continue
                if len(b) > 4:
                    continue
                for mask in range(1, 1 << len(b)):
                    index.setdefault(tuple(None if mask >> k & 1 else x for k, x in enumerate(b)), []).append(c)
            self.known[right] = index = {k: v[:FILLERS] for k, v in index.items()}
        return index

    def _step(self, before: str, c: str) -> float:
        alone = 0.0 if c < "\x80" else float(self.table[ord(c)])
        if not before or not c or before < "\x80" and c < "\x80":
            return alone
        x, y = (48 if "0" <= k <= "9" else ord(k) for k in (before[-1], c))
        both = self.pairs.get(x << 21 | y)
        return alone - BACK if both is None else max(alone, both) + 1.0

    def viterbi(self, data: list[int | None], right: str, beam: int = 12, window: int = 8000, overlap: int = 256) -> str:
        """The likeliest text of a byte lattice, searched in overlapping windows.

        A window is cut where a character of its own likeliest path ends; the next one goes on from that character.
        """
        out: list[str] = []
        at = 0
        while at < len(data):
            part = data[at : at + window]
            last = at + len(part) == len(data)
            for c, end in self._path(part, right, beam, out[-1] if out else ""):
                if not last and end > window - overlap:
                    break
                out.append(c)
                reached = end
            at += reached
        return "".join(out)

    def _path(self, data: list[int | None], right: str, beam: int, first: str) -> list[tuple[str, int]]:
        """(character, where its bytes end) along the likeliest path: states are (position, last character)."""
        index, n = self._patterns(right), len(data)
        widest = 1 if right in ("cp1252", "cp1251", "koi8_r") else 4
        best: list[dict[str, tuple[float, int, str]]] = [{} for _ in range(n + 1)]
        best[0][first] = (0.0, -1, "")
        for i in range(n):
            states = best[i]
            if not states:
                continue
            if len(states) > beam:
                states = best[i] = dict(sorted(states.items(), key=lambda s: -s[1][0])[:beam])
            options: list[tuple[str, int, float]] = []
            if data[i] is not None and data[i] < 0x80:
                options.append((chr(data[i]), 1, 0.0))
            else:
                for width in range(1, min(widest, n - i) + 1):
                    part = data[i : i + width]
                    if None in part:
                        options += [(c, width, 0.0) for c in index.get(tuple(part), ())]
                    else:
                        try:
                            c = bytes(part).decode(right)
                        except UnicodeDecodeError:
                            continue
                        if len(c) == 1:
                            options.append((c, width, 0.0))
                if data[i] is None:  # the mark may stand for more lost bytes than one
                    options += [(c, 1, -3.0) for c in index.get((None, None), ())] if widest > 1 else []
                options.append(("�", 1, 2 * self.floor))
            for c, width, cost in options:
                for before, (value, _, _) in states.items():
                    total = value + cost + self._step(before[-1:], c)
                    old = best[i + width].get(c)
                    if old is None or total > old[0]:
                        best[i + width][c] = (total, i, before)
        c = max(best[n], key=lambda s: best[n][s][0])
        out, at = [], n
        while at > 0:
            _, came, before = best[at][c]
            out.append((c, at))
            at, c = came, before
        return out[::-1]

    def strict_readings(self, text: str, least: float) -> Iterator[tuple[str, str, int]]:
        """Every way to undo one wrong decoding without loss that may score least: (text, channel, 0)."""
        rights = [r for r in RIGHT if self.within_reach(text, r, least)]
        for wrong in WRONG:
            try:
                data = text.encode(wrong, "byte_itself" if wrong in SINGLE else "strict")
            except UnicodeEncodeError:
                continue
            for right in rights:
                if right != wrong:
                    try:
                        got = data.decode(right)
                    except UnicodeDecodeError:
                        continue
                    if got != text:
                        yield got, f"{right}>{wrong}", 0

    def lossy_readings(self, text: str, least: float) -> Iterator[tuple[str, str, int]]:
        """Readings where bytes were lost, by Viterbi search: (text, channel, lost bytes); none that cannot score least."""
        for wrong in WRONG:
            lattice = self.lattice(text, wrong)
            if lattice is None or None not in lattice:
                continue
            lost = lattice.count(None)
            beyond = sum(b is None or b >= 0x80 for b in lattice)
            for right in LOSSY:
                # a character takes two known bytes or a lost one, and scores the commonest's share at best
                if right == wrong or not self.within_reach(text, right, least) or self.top + min(1.0, lost / (lost + (beyond - lost) / 2)) * self.floor <= least:
                    continue
                # the known bytes must already fit the charset but for what the lost ones break, and read well
                rough = bytes(0xA1 if b is None else b for b in lattice).decode(right, "replace")
                if rough.count("\ufffd") > 2 * lost + beyond / 8 or self.score(rough.replace("\ufffd", "")) + 1.0 <= least:
                    continue
                got = self.viterbi(lattice, right)
                if got and got != text:
                    yield got, f"{right}>{wrong}", lost

    def twice_readings(self, text: str, least: float) -> Iterator[tuple[str, str, int]]:
        """Lossless readings of one step and of two; a first step counts by what it leads to, however it reads itself."""
        for got, channel, lost in self.strict_readings(text, least):
            yield got, channel, lost
            if channel.startswith("utf_8>"):
                for again, second, _ in self.strict_readings(got, least):
                    if again != text:
                        yield again, f"{second}+{channel}", 0

    def lossless(self, text: str, margin: float) -> tuple[str, str] | None:
        """The likeliest reading without lost bytes and its channel, if it beats the text by the margin."""
        least = self.score(text) + margin
        return self._best(text, least, self.twice_readings(text, least)) if "\ufffd" not in text else None

    def searched(self, text: str, margin: float, depth: int = 2) -> tuple[str, str] | None:
        """The likeliest reading with lost bytes, undone once more where that is likelier still."""
        best = None
        if self.rarity(text) < RARE:
            least = self.score(text) + margin
            best = self._best(text, least, self.lossy_readings(text, least))
            again = self.restore(best[0], margin, depth - 1) if best and depth > 1 else None
            best = (again[0], f"{again[1]}+{best[1]}") if again else best
        return best if best is not None else self.fill_lost(text)

    def restore(self, text: str, margin: float, depth: int = 2) -> tuple[str, str] | None:
        """The likeliest reading and its channel, if it beats the text by the margin."""
        return self.lossless(text, margin) or self.searched(text, margin, depth)

    def _best(self, text: str, least: float, readings: Iterator[tuple[str, str, int]]) -> tuple[str, str] | None:
        best = None
        for got, channel, lost in readings:
            # a guessed character is no evidence: each counts as one that no record holds
            beyond = max(1, sum(c >= "\x80" for c in got))
            value = self.score(got) + min(1.0, lost / beyond) * self.floor
            if value > least and (best is None or (value, -len(got)) > best[0]) and self.plausible(text, got, channel):
                best = ((value, -len(got)), got, channel)
        return best[1:] if best else None

    @staticmethod
    def plausible(text: str, got: str, channel: str) -> bool:
        """Not a few ideographs amid Latin words, nor marks where a charset of single bytes would have words; and only UTF-8, which checks itself, may rest on three characters or fewer."""
        shown = _TAG.sub("", got)
        han = sum("\u3400" <= c <= "\u9fff" for c in shown)
        latin = sum(c.isalpha() and c < "\u0250" for c in shown)
        if 0 < 5 * han < latin:
            return False
        beyond = [c for c in shown if c >= "\x80"]
        for right in re.findall(r"(\w+)>", channel):
            if right == "cp1252" and sum(c.isascii() and c.isalpha() for c in shown) < 2 * len(beyond) or right in ("cp1251", "koi8_r") and sum("\u0400" <= c <= "\u04ff" for c in beyond) < 0.8 * len(beyond):
                return False
        return channel.startswith("utf_8") or "+utf_8>" in channel or sum(c >= "\x80" for c in text) >= 4

    def fill_lost(self, text: str) -> tuple[str, str] | None:
        """A text otherwise in order with single letters or quotation marks lost: the likeliest one for each U+FFFD."""
        lost = text.count("�")
        if not lost or 6 * lost > len(text) or self.score(text.replace("�", "")) < self.floor / 2:
            return None
        letters, out = [c for c in self.vocabulary if c.isalpha() and c < "\u0250" or c in "«»\u2018\u2019\u201c\u201d\u2013\u2014\u2026"], []
        for k, c in enumerate(text):
            if c == "�":
                before, after = (out[-1] if out else ""), text[k + 1 : k + 2]
                c = max(letters, key=lambda x: self._step(before, x) + self._step(x, after), default=c)
            out.append(c)
        return "".join(out), "lost"

    def suspicious(self, text: str, below: float) -> list[int]:
        """Numbers of the lines whose characters beyond ASCII are rare on average or lost, or that show torn UTF-8."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.concatenate(([0], np.flatnonzero(codes == 10) + 1))
        beyond = codes >= 0x80
        total = np.add.reduceat(np.append(np.where(beyond, self.table[codes], 0.0), 0.0), starts)
        number = np.add.reduceat(np.append(beyond.astype(np.int64), 0), starts)
        lost = np.add.reduceat(np.append((codes == 0xFFFD).astype(np.int64), 0), starts)
        found = ((number > 0) & (total < below * number)) | (lost > 0)
        torn = [m.start() for m in self.torn.finditer(text)]
        if torn:
            found[np.searchsorted(starts, torn, side="right") - 1] = True
        return np.flatnonzero(found).tolist()


def garbled_lines(texts: DataFrame, margin: float = 1.2, below: float = RARE, least_share: float = 2e-4, rows_only: bool = False) -> DataFrame:
    """(table_name, row_id, line_no, garbled, restored, channel) of every garbled line.

    restored is null where no reading is likely enough. rows_only: one garbled line of
    each row, the first found; the rows are those of all garbled lines, as every
    suspicious line of a row is searched until one is garbled.
    """
    spark = texts.sparkSession
    texts = spread(texts)
    sent = spark.sparkContext.broadcast(corpus_counts(texts, least_share))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codecs.register_error("byte_itself", byte_itself)
        channel = Channel(*sent.value)
        seen: dict[tuple[str, bool], tuple[str, str] | None] = {}

        def restored(line: str, lossy: bool) -> tuple[str, str] | None:
            if (line, lossy) in seen:
                return seen[line, lossy]
            got = channel.searched(line, margin) if lossy else channel.lossless(line, margin)
            if len(seen) < 100_000:
                seen[line, lossy] = got
            return got

        def first(lines: list[str], at: list[int]) -> int | None:
            """A garbled line: a lost character settles it, else a lossless reading, else the search for lost bytes, the rarest line first."""
            for k in at:
                if "\ufffd" in lines[k]:
                    return k
            for k in at:
                if restored(lines[k], False):
                    return k
            return next((k for k in sorted(at, key=lambda k: channel.rarity(lines[k])) if restored(lines[k], True)), None)

        for batch in batches:
            out = []
            for name, row_id, text in zip(batch["table_name"], batch["row_id"], batch["text"]):
                at = channel.suspicious(text, below)
                if not at:
                    continue
                lines = text.split("\n")
                if rows_only:
                    k = first(lines, at)
                    if k is not None:
                        out.append((name, row_id, k, lines[k], None, None))
                    continue
                for k in at:
                    got = restored(lines[k], False) or restored(lines[k], True)
                    if got or "\ufffd" in lines[k]:
                        out.append((name, row_id, k, lines[k], got[0] if got else None, got[1] if got else None))
            yield pd.DataFrame(out, columns=["table_name", "row_id", "line_no", "garbled", "restored", "channel"])

    return texts.mapInPandas(find, LINES)


def garbled_rows(lines: DataFrame) -> DataFrame:
    return lines.select("table_name", "row_id").distinct()


def both(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
