"""Visible text of pages by line: what problems 5 and 6 share.

A page (HTML, JSON or plain text) becomes segments: the text one block element
shows on one line of the source. A segment carries the signatures of its block
and that block's ancestors (tag.class), a 64-bit key of its text with numbers and
the page's own host masked, and a few lengths. Texts themselves never leave the
Python stage; everything after it works on keys.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import spread

SCHEMA = (
    "table_name string, row_id bigint, line_no int, seq int, form string, host string, book bigint, kind string, path string, "
    "key bigint, size int, points double, link double, head string, words array<string>, own boolean, sep boolean, "
    "slots array<string>, latin array<int>"
)

_MARKUP = re.compile(r"<!--.*?-->|<!\w[^>]*>|<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|([^<]+)|<", re.S)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*["']?([^"'\s>]+)""")
_IS_HTML = re.compile(r"<(?:html|body|div|p|td|article|main|head|section|span)\b", re.I)
_DIGITS = re.compile(r"\d+")
_ENDER = re.compile(r"[。！？!?…]|\.(?=\s|$)")
_COMMA = re.compile(r"[,，、;；。！？.!?]")
_SEPARATOR = re.compile(r"\s*[|›»>·/]\s*|\s+")
_BREAD = re.compile(r"[|›»>]")
_HEAD = re.compile(r"^\s*([^:：。！？.!?“”\"]{2,24}?)\s*[:：]")

# The ways templates mark a slot, opening and closing.
SLOT_MARKS = ["{{", "}}"], ["${", "}"], ["#{", "}"], ["{$", "}"], ["{%", "%}"], ["<%=", "%>"], ["<%", "%>"], ["[[", "]]"], ["@", "@"], ["$", "$"], ["%", "%"], ["__", "__"], ["【", "】"], ["&lt;", "&gt;"], ["<", ">"], ["{", "}"], ["[", "]"]
#: openings of marks that prose doesn't use: a name between them is a slot whatever else the table holds
SURE_MARKS = ("{{", "${", "#{", "{$", "{%", "<%=", "<%")
_SLOT = re.compile("|".join(f"{re.escape(a)}[ \\t]*([\\w\u4e00-\u9fff][\\w.\u4e00-\u9fff-]{{1,39}})[ \\t]*{re.escape(b)}" for a, b in SLOT_MARKS))
_LATIN = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[㐀-鿿]")
_BEYOND = re.compile(r"[^\W\d_a-zA-Z]|\ufffd")

# Elements of HTML.
VOID = frozenset("br hr img meta link input wbr col area base embed source track".split())
RAW = frozenset(("script", "style", "template"))
INLINE = frozenset("a b i em strong span font u s small big sub sup code label abbr cite q mark ins del".split())
PARAGRAPH = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt blockquote pre center".split())
CLOSES_P = frozenset("p div ul ol li table td tr section article main aside header footer nav h1 h2 h3 h4 h5 h6 form hr".split())


def mask(text: str, host: str) -> str:
    """Numbers and the page's own host give way to marks, spaces fold; what recurs then recurs alike."""
    text = " ".join(text.split())
    if host and host in text:
        text = text.replace(host, "<host>")
    return _DIGITS.sub("#", text)


def key_of(text: str, host: str) -> int:
    return xxhash.xxh64_intdigest(mask(text, host).encode("utf-8", "surrogatepass")) - (1 << 63)


def _html_segments(body: str) -> Iterator[tuple[int, str, str, str, float, list[str] | None]]:
    """(line_no, kind, path, text, share of link text, texts of the links) of every segment."""
    stack: list[tuple[str, str, bool]] = []  # tag, signature, is block
    line, raw, head = 0, "", False
    texts: list[tuple[str, bool]] = []
    at: tuple[int, str, str] | None = None

    def flush() -> Iterator[tuple[int, str, str, str, float, list[str] | None]]:
        nonlocal texts, at
        if texts:
            whole = html.unescape("".join(t for t, _ in texts))
            if whole.strip():
                total = sum(len(t.strip()) for t, _ in texts) or 1
                yield at[0], at[1], at[2], whole.strip(), sum(len(t.strip()) for t, linked in texts if linked) / total, [html.unescape(t).strip() for t, linked in texts if linked and t.strip()] or None
        texts, at = [], None

    for m in _MARKUP.finditer(body):
        piece = m.group(4)
        if piece is None:
            tag = m.group(2)
            if tag is None:
                line += m.group(0).count("\n")
                continue
            tag = tag.lower()
            closing = bool(m.group(1))
            if raw:
                if closing and tag == raw:
                    raw = ""
                line += m.group(0).count("\n")
                continue
            if tag in INLINE:
                if closing:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k]
                            break
                        if stack[k][2]:
                            break
                else:
                    stack.append((tag, tag, False))
            else:
                yield from flush()
                if tag == "head":
                    head = not closing
                elif tag == "body":
                    head = False
                if closing:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                elif tag in RAW:
                    raw = tag
                elif tag not in VOID:
                    if tag in CLOSES_P and stack:
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] == "p" or (tag == "li" and stack[k][0] == "li"):
                                del stack[k:]
                                break
                            if stack[k][0] in ("div", "td", "ul", "ol", "table", "article", "main", "section"):
                                break
                    c = _CLASS.search(m.group(3)) if m.group(3) else None
                    stack.append((tag, f"{tag}.{c.group(1)}" if c else tag, True))
            line += m.group(0).count("\n")
            continue
        if raw or head:
            line += piece.count("\n")
            continue
        blocks = [s[1] for s in stack if s[2] and s[0] not in ("html", "body")]
        tags = {s[0] for s in stack}
        kind = "n" if "noscript" in tags else "h" if "h1" in tags else "s" if tags & {"h2", "h3", "h4"} else "t"
        path, linked = ">".join(blocks), "a" in tags
        for k, part in enumerate(piece.split("\n")):
            if k:
                yield from flush()
                line += 1
            if part.strip():
                if at is None:
                    at = (line, kind, path)
                texts.append((part, linked))
            elif texts:
                texts.append((part, linked))
    yield from flush()


def _json_strings(value: object, name: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, str):
        yield name, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _json_strings(v, str(k))
    elif isinstance(value, list):
        for v in value:
            yield from _json_strings(v, name)


def segments(body: str, title: str | None = None) -> tuple[str, list[tuple[int, str, str, str, float, list[str] | None]]]:
    """The form of a text (html, json, plain) and its visible segments."""
    start = body.lstrip()[:1]
    if start in ("{", "["):
        try:
            parsed = json.loads(body)
        except ValueError:
            parsed = None
        if isinstance(parsed, (dict, list)):
            out = []
            for name, text in _json_strings(parsed):
                kind = "h" if name.lower() in ("title", "name", "chapter_title", "url") else "t"
                out += [(0, kind, f"json.{name}", x.strip(), 0.0, None) for x in text.split("\n") if x.strip()]
            return "json", out
    if _IS_HTML.search(body):
        return "html", list(_html_segments(body))
    wanted = " ".join((title or "").split())
    out = []
    for k, x in enumerate(body.split("\n")):
        x = x.strip()
        if x:
            out.append((k, "h" if wanted and " ".join(x.split()) == wanted else "t", "", x, 0.0, None))
    return "plain", out


def page_rows(df: DataFrame, table_name: str, id_col: str, text_col: str, url: Column, book: Column, title: Column | None = None) -> DataFrame:
    """(table_name, row_id, body, url, book, title); null and blank texts are left out."""
    return df.select(
        F.lit(table_name).alias("table_name"), F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("body"),
        url.cast("string").alias("url"), book.cast("string").alias("book"), (title if title is not None else F.lit(None)).cast("string").alias("title"),
    ).filter(F.col("body").rlike(r"\S"))


def slot_names(text: str) -> list[str] | None:
    """What stands in template marks, as 'number of the mark, name'."""
    if not any(c in text for c in "{$#[@%_【<"):
        return None
    return [f"{m.lastindex} {m.group(m.lastindex)}" for m in _SLOT.finditer(text)] or None


def latin_words(text: str) -> list[int] | None:
    """Hashes of the words of a Latin text of six words or more."""
    if _HAN.search(text):
        return None
    if not text.isascii() and 6 * len(_BEYOND.findall(text)) > len(text.replace(" ", "")):
        return None  # another script or garbled
    found = _LATIN.findall(text.lower())
    return [xxhash.xxh32_intdigest(w.encode()) - (1 << 31) for w in dict.fromkeys(found)] if len(found) >= 6 else None


def line_segments(pages: DataFrame, detail: bool = False) -> DataFrame:
    """Every visible segment of every page, as keys and lengths (SCHEMA); slots and latin only with detail."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, row_id, body, url, book, title in zip(batch["table_name"], batch["row_id"], batch["body"], batch["url"], batch["book"], batch["title"]):
                m = re.match(r"\w+://([^/?#]+)", url or "")
                host = m.group(1).lower() if m else ""
                group = xxhash.xxh64_intdigest((book or url or f"{name}{row_id}").encode("utf-8", "surrogatepass")) - (1 << 63)
                form, parts = segments(body, title)
                for seq, (line, kind, path, text, link, links) in enumerate(parts):
                    size = len(text)
                    points = (1 + len(_COMMA.findall(text)) + min(size / 100, 3.0)) * (1 - link) if size >= 10 else 0.0
                    head = words = None
                    own = sep = False
                    if form != "json":
                        own = bool(host) and host in text.lower()
                    if size <= 160 and form == "plain" or kind == "s" or link > 0.5:
                        h = _HEAD.match(text)
                        head = h.group(1) if h else text if kind == "s" else None
                        if links:
                            words = links
                        elif size <= 160 and not _ENDER.search(text):
                            words = [w for w in _SEPARATOR.split(text) if w]
                            sep = bool(_BREAD.search(text))
                    slots = slot_names(text) if detail else None
                    latin = latin_words(text) if detail and link < 0.5 and kind == "t" else None
                    out.append((name, row_id, line, seq, form, host, group, kind, path, key_of(text, host), size, points, link, head, words, own, sep, slots, latin))
            yield pd.DataFrame(out, columns=["table_name", "row_id", "line_no", "seq", "form", "host", "book", "kind", "path", "key", "size", "points", "link", "head", "words", "own", "sep", "slots", "latin"])

    return spread(pages).mapInPandas(parse, SCHEMA)
