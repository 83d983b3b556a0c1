"""Scalar text functions as Column expressions: all of them stay in whole-stage code.

Null in gives null out unless stated. Whitespace is Unicode's, unlike Spark's trim.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"

# Fixed values.
SEARCH_PUNCTUATION = "《》「」“”\"':：-_，,。.？?！!；;"
FALSY = ("", "0", "false", "null", "none", "no", "off")
NUMERALS = "零〇一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟"
NON_STORY = ["番外", "外传", "新书", "公告", "通知", "说明", "感言", "请假", "断更", "恢复更新", "更新时间", "求票", "月票", "推荐票", "打赏", "推书", "书友群", "群号", "活动", "抽奖", "实体书", "出版", "完本", "上架"]
PROLOGUES = ["序章", "楔子", "引子", "序", "前言"]
HEADING = rf"^(?:第[\p{{N}}{NUMERALS}]+[章节回卷部集篇]|卷[\p{{N}}{NUMERALS}]+)(?:$|[\s:：、.．\-—].*|[^\s:：、.．\-—](?:.*[^。！？!?；;，,、])?)$"


def utrim(x: Column) -> Column:
    """Trim of Unicode whitespace."""
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def clean(x: Column) -> Column:
    """Trimmed, and null where nothing is left (X11)."""
    return F.nullif(utrim(x), F.lit(""))


def collapse(x: Column) -> Column:
    """Runs of whitespace to one space, trimmed."""
    return F.trim(F.regexp_replace(x, f"{WS}+", " "))


def source_url(x: Column) -> Column:
    """Without control characters but line ends and tabs, trimmed."""
    return utrim(F.regexp_replace(x, r"[\p{Cc}&&[^\n\r\t]]", ""))


def repair_encoded_url(x: Column) -> Column:
    """Un-escapes ? & = # of a URL whose query is escaped."""
    back = x
    for code, ch in (("%3[Ff]", "?"), ("%26", "&"), ("%3[Dd]", "="), ("%23", "#")):
        back = F.regexp_replace(back, code, ch)
    return F.when(x.rlike("%3[Ff]|%26|%3[Dd]"), back).otherwise(x)


def search_text(x: Column) -> Column:
    """Lower case without whitespace and the listed punctuation."""
    return F.lower(F.regexp_replace(F.translate(x, SEARCH_PUNCTUATION, ""), WS, ""))


def chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def common_count(query: Column, title: Column) -> Column:
    """Characters of the query, with repeats, that the title has."""
    return F.size(F.filter(chars(query), lambda c: F.contains(title, c)))


def ordered_count(query: Column, title: Column) -> Column:
    """Greedy count of the query's characters met in order; a character that isn't met uses up the title."""
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        found = F.call_function("locate", c, title, acc["at"])
        return F.struct((acc["n"] + (found > 0).cast("int")).alias("n"), F.when(found > 0, found + 1).otherwise(F.length(title) + 1).alias("at"))

    return F.aggregate(chars(query), start, step)["n"]


def relevance(query: Column, name: Column, author: Column) -> Column:
    """struct(score, strong) of a hit for a query."""
    q, t, a = search_text(query), search_text(F.coalesce(name, F.lit(""))), search_text(F.coalesce(author, F.lit("")))
    common = common_count(q, t)
    partial = (F.length(q) >= 2) & (F.length(t) >= 2) & (F.left(q, F.lit(2)) == F.left(t, F.lit(2))) & (F.floor(common * 100 / F.greatest(F.length(q), F.lit(1))) >= 75)
    bonus = F.when(t == q, 10_000).when(F.contains(t, q), 8_000).when(F.contains(q, t) & (F.length(t) >= 2), 3_000).when(partial, 4_500).otherwise(0)
    by_author = F.when(a == q, 1_000).otherwise(0)
    score = common * 100 + ordered_count(q, t) * 25 + bonus + by_author
    blank = q == ""
    return F.struct(F.when(blank, 0).otherwise(score).cast("int").alias("score"), (blank | (bonus > 0) | (by_author > 0)).alias("strong"))


def canonical_key(x: Column) -> Column:
    """Lower-case letters and digits; every other run is one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")


def merge_key(name: Column, author: Column) -> Column:
    """Lower-case trimmed name and author."""
    return F.concat_ws("|", F.lower(utrim(F.coalesce(name, F.lit("")))), F.lower(utrim(F.coalesce(author, F.lit("")))))


def compact(x: Column) -> Column:
    """Lower case without whitespace and joiners."""
    return F.lower(F.regexp_replace(x, rf"[{WS}·\-_|/\\]", ""))


def keyword_hits(x: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords a text has."""
    return sum((F.contains(x, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def without_author_label(x: Column) -> Column:
    """An author's name without the label before it."""
    return utrim(F.regexp_replace(utrim(x), r"^作者\s*[:：]?", ""))


def last_chapter(x: Column) -> Column:
    """A long text reduced to its last chapter line."""
    t = utrim(x)
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), utrim), lambda s: s.startswith("第") & F.contains(s, F.lit("章")))
    short = (F.length(t) <= 80) & ~F.contains(t, F.lit("\n"))
    return F.when(t == "", None).when(short, t).otherwise(F.coalesce(F.try_element_at(lines, F.lit(-1)), t))


def ellipsis(x: Column, most: int) -> Column:
    """At most `most` characters, the cut marked."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(most)), F.lit("…")))


def elide(x: Column, most: int = 12_000, head: int = 8_000, tail: int = 4_000) -> Column:
    """Head and tail of an over-long text."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(head)), F.lit("\n\n……中间内容已省略……\n\n"), F.right(x, F.lit(tail))))


def version_parts(x: Column) -> Column:
    """Numbers of a version, at least three; null if a part isn't a number."""
    plain = F.regexp_extract(F.regexp_replace(utrim(x), "^[vV]+", ""), r"^([^\-+]*)", 1)
    parts = F.transform(F.split(plain, r"\."), lambda p: utrim(p).try_cast("bigint"))
    padded = F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(3) - F.size(parts), F.lit(0))))
    return F.when(~F.exists(parts, lambda p: p.isNull()), padded)


def is_newer(candidate: Column, current: Column) -> Column:
    return F.coalesce(version_parts(candidate) > version_parts(current), F.lit(False))


def truthy(x: Column) -> Column:
    """False for blank, 0, false, null, none, no and off."""
    return ~F.lower(utrim(F.coalesce(x, F.lit("")))).isin(*FALSY)


def chinese_number(x: Column) -> Column:
    """The value of a numeral in ideographs; null for other text."""
    digit = F.create_map(*[F.lit(y) for k, v in zip("零〇一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9)) for y in (k, v)])
    unit = F.create_map(*[F.lit(y) for k, v in zip("十百千万", (10, 100, 1000, 10000)) for y in (k, v)])
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("number"))

    def step(s: Column, c: Column) -> Column:
        d, u = F.try_element_at(digit, c), F.try_element_at(unit, c)
        as_digit = F.struct(s["total"].alias("total"), s["section"].alias("section"), d.alias("number"))
        ten_thousand = F.struct((s["total"] + (s["section"] + s["number"]) * 10_000).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("number"))
        other = F.struct(s["total"].alias("total"), (s["section"] + F.when(s["number"] == 0, 1).otherwise(s["number"]) * u).alias("section"), F.lit(0).alias("number"))
        return F.when(d.isNotNull(), as_digit).when(u == 10_000, ten_thousand).otherwise(other)

    value = F.aggregate(chars(x), zero, step, lambda s: s["total"] + s["section"] + s["number"])
    return F.when(x.rlike("^[零〇一二两三四五六七八九十百千万]+$"), value)


def chapter_title(x: Column) -> Column:
    """A title without whitespace and brackets."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), rf"{WS}|[【】《》（）()]", "")


def chapter_ordinal(x: Column) -> Column:
    """The number in a chapter title, in digits or ideographs."""
    t = chapter_title(x)
    digits = F.nullif(F.regexp_extract(t, r"^(?:第)?(\d{1,5})(?:[章节回话集部卷篇.、:：]|$)", 1), F.lit(""))
    han = F.nullif(F.regexp_extract(t, r"^第?([零〇一二两三四五六七八九十百千万]+)(?:章|节|回|话|集|部|卷|篇)", 1), F.lit(""))
    return F.coalesce(digits.cast("int"), chinese_number(han))


def is_heading(line: Column) -> Column:
    """Whether a trimmed line is a chapter heading."""
    return (F.length(line) <= 80) & line.rlike(HEADING)


def file_stem(x: Column) -> Column:
    """A file's name without folders, extension and characters unfit for names."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"([^/\\]*)$", 1), r"\.[^.]*$", ""), r'[<>:"|?*\p{Cc}]', "")


def without_tags(x: Column) -> Column:
    """Visible text of markup: scripts and styles dropped, tags to spaces."""
    return collapse(F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style|noscript)\b.*?</\1>", " "), r"<[^>]*>", " "))


def rewrite(x: Column, rules: Iterable[tuple[str, str, bool]]) -> Column:
    """Ordered fold of (pattern, replacement, is_regex); a pattern that doesn't compile is passed over."""
    for pattern, replacement, is_regex in rules:
        if not pattern:
            continue
        if not is_regex:
            x = F.replace(x, F.lit(pattern), F.lit(replacement))
            continue
        try:
            groups = re.compile(pattern).groups
        except re.error:
            continue
        x = F.regexp_replace(x, f"(?m){pattern}", java_replacement(replacement, groups, script=True))
    return x


def java_replacement(replacement: str, groups: int, script: bool = False) -> str:
    """A replacement for Java; unknown groups vanish.

    A group's name is the longest run of word characters ($1x is the group 1x), or
    with script one or two digits ($1x is group 1, then x).
    """
    name_of = r"\$(?:(\d{1,2})|(&)|(\$))" if script else r"\$(?:\{(\w+)\}|(\w+)|(\$))"
    out, k = [], 0
    for m in re.finditer(name_of, replacement):
        out.append(_quoted(replacement[k : m.start()]))
        name = m.group(1) or m.group(2)
        k = m.end()
        if m.group(3):
            out.append(r"\$")
        elif name == "&":
            out.append("$0")
        elif name.isdigit():
            if script and int(name) > groups and len(name) == 2:
                name, k = name[:1], k - 1
            out.append(f"${int(name)}" if int(name) <= groups else m.group() if script else "")
    return "".join([*out, _quoted(replacement[k:])])


def _quoted(text: str) -> str:
    return text.replace("\\", r"\\").replace("$", r"\$")


def snippets(x: Column, keyword: str, radius: int = 18) -> Column:
    """An array of struct(pos, snippet) of every match of a keyword, case ignored."""
    flat = collapse(x)
    if not keyword:
        return F.array().cast("array<struct<pos int, snippet string>>")
    n = len(keyword)
    parts = F.split(F.lower(flat), re.escape(keyword.lower()))  # matches don't overlap
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * n)

    def cut(at: Column) -> Column:
        low, high = F.greatest(at - radius, F.lit(0)), F.least(at + n + radius, F.length(flat))
        middle = F.trim(F.substring(flat, low + 1, high - low))
        text = F.concat(F.when(low > 0, "...").otherwise(""), middle, F.when(high < F.length(flat), "...").otherwise(""))
        return F.struct(at.alias("pos"), text.alias("snippet"))

    return F.when(F.size(parts) > 1, F.transform(ends, cut)).otherwise(F.array().cast("array<struct<pos int, snippet string>>"))
