"""Matching entities across sources without keys (problem 1): loopy belief propagation.

Every hit becomes a profile: its name and author in one form (width, accents,
traditional forms, look-alikes and decorations flattened), the mark of a sequel
or spin-off, numbers of the last chapter and of words, the beginning of its
introduction. Hits that are copies (one origin, one address) are one node.

Candidates share evidence of two units or more: an equal name or an
equal beginning of the introduction counts two, a piece of the name together with
the author counts one, and so do near last chapters and like numbers of words. Pairs of one
origin are no candidates.

Each candidate pair is a variable with a prior log-odds from its attributes. A
source holds a work once, so of the candidates of a hit within one other origin
at most one is true: one such factor for each (hit, origin), from either side.
Messages between variables and factors are exchanged through joins on the factor
until they stop changing; the marginal of a pair is its confidence. Factors with
one candidate send nothing, so only contested pairs take part in the exchange.

No pair is dropped for the size of a block. A key of more than `block_limit` nodes is
joined in slices, one side in one of them and the other with all, so that its pairs are
spread over tasks; their number grows with the square of its nodes.

Defined results: a null or blank name has no candidates by name, a null, blank or
stand-in author is no evidence; null fields are no evidence; copies are matched
as their node and each gets its rows in the result; pairs within one origin are
never returned; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm._text import fold_table, simplified_table
from folioflow.llm.lookalike import CYRILLIC, CYRILLIC_AS_LATIN, GREEK, GREEK_AS_LATIN
from folioflow.session import spread, written

PROFILE = (
    "hit_id bigint, origin bigint, node bigint, name string, mark string, author string, family string, initial string, "
    "intro bigint, chapter int, words double, kind bigint, listed bigint, place int, keys array<bigint>"
)

# Authors that name nobody, and words round a name that aren't part of it.
NOBODY = frozenset(["", "-", "未知", "佚名", "unknown", "anonymous", "inconnu", "匿名", "无", "none", "null", "n/a", "作者不详", "不详"])
DECORATIONS = ["最新章节", "全文阅读", "txt下载", "txt全集", "无弹窗", "小说", "全本", "book edition", "read online", "a novel", "novel"]
SEQUELS = ["续集", "前传", "后传", "外传", "番外", "之后日谈", "后日谈", "第二部", "第三部", "第四部", "第一部", "下部", "part two", "part three", "the return", "origins", "ii", "iii", "iv"]

_INVISIBLE = re.compile("[­͏​-‏⁠﻿]")
_BRACKETS = re.compile(r"[(\[【][^()\[\]【】]*[)\]】]")
_TAIL = re.compile(r"\s*(?:——|—|–|\||\s-\s).*$")
_DECORATED = re.compile(r"[\s:：|-]*(?:" + "|".join(sorted(map(re.escape, DECORATIONS), key=len, reverse=True)) + r")\s*$")
_SEQUEL = re.compile(r"[\s:：-]*(?:(?<=[一-鿿])|\b)(" + "|".join(sorted(map(re.escape, SEQUELS), key=len, reverse=True)) + r"|(?<![\d级])[2-9])\s*$")
_BY = re.compile(r"^\s*(?:作者\s*[:：]?|文\s*[/:：]|著者\s*[:：]?|by\b|par\b)\s*|(?:\s*(?:[（(]?著[)）]?|@原创|等|编著))\s*$")
_INTRO = re.compile(r"^\W*(?:内容简介|作品简介|简介|文案|about this book|summary|résumé|resume|synopsis|description|présentation)\W*", re.I)
_NUMBER = re.compile(r"\d+")
_COUNT = re.compile(r"([\d.,]+)\s*(万|k|w)?", re.I)
_INVERTED = re.compile(r",\s*(the|an?|les?|la)\s*$")
_LAST_PART = re.compile(r"(?:——|[:：|–—]|\s-\s|(?<=[一-鿿])\s)\s*([^:：|–—]{2,20})$")
_JAVA_LAST_PART = r"(?:——|[:：|–—]|\s-\s|(?<=\p{IsHan})\s)\s*([^:：|–—]{2,20})$"
_FOREIGN = re.compile("[\u0370-\u04ff]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN_WORD = re.compile(r"[a-z]+")


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _letters(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def flat(text: str, table: dict[int, str], likeness: dict[int, str]) -> str:
    """One form of a short value: case, width, accents, traditional forms and look-alikes flattened."""
    if text.isascii():
        return " ".join(text.lower().split())
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if not text.isascii() and _FOREIGN.search(text):
        own = bool(re.search(r"[a-z一-鿿]", re.sub(r"\([^)]*\)|\[[^\]]*\]", "", text.lower())))
        text = _WORD.sub(lambda m: _own_letters(m.group(), likeness, own), text)
    return " ".join(text.lower().translate(table).split())


def _own_letters(word: str, likeness: dict[int, str], latin_name: bool) -> str:
    """A word that mixes scripts, or is all look-alikes in a name of another script, in the script it belongs to."""
    turned = word.translate(likeness)
    if not _FOREIGN.search(turned):
        return turned if latin_name or re.search("[A-Za-z]", word) else word
    if re.search("[A-Za-z]", word):  # true letters of the other script: the Latin ones are the look-alikes
        return word.translate({ord(b): a for a, b in zip(CYRILLIC, CYRILLIC_AS_LATIN)})
    return word


def name_parts(name: str, tails: frozenset[str] = frozenset()) -> tuple[str, str, str]:
    """(name, mark, shown): a name without decorations and common tails as letters and as shown, and the mark of a sequel."""
    m = _LAST_PART.search(name)
    if m and m.group(1).strip() in tails:
        name = name[: m.start()]
    text = _TAIL.sub("", _BRACKETS.sub(" ", name.replace("《", " ").replace("》", " ")).strip())
    m = _INVERTED.search(text)
    if m:
        text = f"{m.group(1)} {text[: m.start()]}"
    before = None
    while before != text:
        before, text = text, _DECORATED.sub("", text).strip()
    m = _SEQUEL.search(text)
    if m and m.start() > 0:
        return _letters(text[: m.start()]), m.group(1), text[: m.start()]
    return _letters(text), "", text


def name_pieces(title: str, shown: str) -> set[str]:
    """Two or three pieces of a name, of which one slip leaves most: long words, or pairs of ideographs."""
    words = [w for w in _LATIN_WORD.findall(shown) if len(w) >= 5]
    if title.isascii() and words:
        return set(sorted(words, key=len)[-3:])
    middle = len(title) // 2
    return {p for p in (title[:2], title[-2:], title[middle : middle + 2], title[middle - 1 : middle + 1]) if len(p) == 2 and p.isalpha() and not p.isascii()}


def common_tails(hits: DataFrame, least_share: float = 0.001, least_names: int = 8) -> frozenset[str]:
    """Last parts of names, behind a separator, that very many different names share: headings of sites, not of works.

    At most 1 / least_share of them, however many names there are.
    """
    names = hits.select(F.regexp_replace(F.lower(F.col("name").cast("string")), r"[\p{Cf}\x{34F}]", "").alias("n")).filter("n is not null")
    parts = names.select(F.regexp_extract("n", _JAVA_LAST_PART, 1).alias("tail"), F.regexp_replace("n", _JAVA_LAST_PART, "").alias("rest")).filter("tail != ''").distinct()
    total = names.distinct().count()
    rows = parts.groupBy("tail").count().filter(F.col("count") >= max(least_names, least_share * total)).select("tail").collect()
    return frozenset(r["tail"].strip() for r in rows) - frozenset(SEQUELS)


def author_parts(author: str) -> tuple[str, str, str]:
    """(letters, family, initial); for names without spaces the family is the first two characters."""
    text = author
    for _ in range(2):
        text = _BY.sub("", text).strip()
    if text.rstrip(".… ") in NOBODY or not _letters(text):
        return "", "", ""
    if "," in text:
        last, _, first = text.partition(",")
        text = f"{first.strip()} {last.strip()}"
    words = re.findall(r"[^\W\d_]+", text)
    if any("一" <= c <= "鿿" for c in text) or len(words) < 2:
        whole = _letters(text)
        return whole, whole[:2], ""
    return words[0] + words[-1], words[-1], words[0][:1]


def count_of(text: str | None) -> float | None:
    """A number of words in any of its notations."""
    m = _COUNT.search(text or "")
    if not m:
        return None
    try:
        return float(m.group(1).replace(",", "")) * {"": 1, "万": 1e4, "w": 1e4, "k": 1e3}[(m.group(2) or "").lower()]
    except ValueError:
        return None


def profiles(hits: DataFrame) -> DataFrame:
    """The profile of every hit (PROFILE)."""
    spark = hits.sparkSession
    table = fold_table(simplified_table(spark))
    tails = common_tails(hits)
    likeness = dict(zip(map(ord, CYRILLIC + GREEK), CYRILLIC_AS_LATIN + GREEK_AS_LATIN))
    rows = hits.select(
        F.col("hit_id").cast("bigint").alias("hit_id"), *[F.col(c).cast("string").alias(c) for c in ("name", "author", "origin", "book_url", "intro", "kind", "last_chapter", "word_count")], F.col("book_source_urls").cast("array<string>").alias("urls")
    )

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for hit, name, author, origin, url, intro, kind, last, count, urls in zip(b["hit_id"], b["name"], b["author"], b["origin"], b["book_url"], b["intro"], b["kind"], b["last_chapter"], b["word_count"], b["urls"]):
                title, mark, shown = name_parts(flat(name or "", table, likeness), tails)
                who, family, initial = author_parts(flat(author or "", table, likeness))
                begin = _letters(_INTRO.sub("", flat((intro or "")[:160], table, likeness)))
                if len(begin) < 40 and len(intro or "") > 160:  # mostly marks and blanks: the letters come later
                    begin = _letters(_INTRO.sub("", flat(intro, table, likeness)))
                begin = begin[:40] if begin[:16].isascii() else begin[:16]
                begun = _hash("i", begin) if len(begin) >= 12 else None
                source = _hash("o", origin)
                m = _NUMBER.search(last or "")
                chapter = int(m.group()) % 1_000_000 if m else None
                keys = {}
                if title:
                    keys[_hash("n", title, mark)] = 2
                    if who:
                        for p in name_pieces(title, shown):
                            keys[_hash("a", family, initial, p)] = 1
                if begun is not None:
                    keys[begun] = 2
                listed = 0  # a bit for each listed source: one in 64 others shares it, which weak evidence can bear
                for x in urls if urls is not None else ():
                    listed |= 1 << (_hash("o", x) % 64)
                listed = listed - (1 << 64) if listed >= 1 << 63 else listed
                out.append((
                    hit, source, _hash("u", origin, url) if url else _hash("h", hit), title, mark, who, family, initial, begun, chapter, count_of(count),
                    _hash("k", kind) if kind else None, listed, source % 64, [(k & ~1) | (w - 1) for k, w in keys.items()],  # the last bit tells the weight
                ))
            frame = pd.DataFrame(out, columns=["hit_id", "origin", "node", "name", "mark", "author", "family", "initial", "intro", "chapter", "words", "kind", "listed", "place", "keys"])
            yield frame.astype({"intro": "Int64", "chapter": "Int32", "kind": "Int64"})

    return spread(rows).mapInPandas(make, PROFILE)


def _small(df: DataFrame, name: str, most: int = 200_000) -> DataFrame:
    """A written table, to be broadcast if its counted rows allow it; else its joins shuffle."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= most else table


def candidates(nodes: DataFrame, block_limit: int = 2000, near_chapters: int = 15) -> DataFrame:
    """(a, b): pairs of nodes of different origins with two units of shared evidence.

    Every such pair comes out, however many nodes share a key: keys of more than
    block_limit nodes are joined in slices of about as many.
    """
    keyed = nodes.select("node", "origin", "chapter", F.log("words").cast("float").alias("words"), "keys", F.explode("keys").alias("k"))
    hot = written(keyed.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > block_limit).select("k", F.ceil(F.col("n") / block_limit).cast("int").alias("slices")), "hot")
    count = hot.count()
    hot = F.broadcast(hot) if count <= 200_000 else hot
    weight = lambda k: 1 + k.bitwiseAND(F.lit(1))
    beside = sum(F.coalesce(c, F.lit(False)).cast("int") for c in (F.abs(F.col("chapter") - F.col("there")) <= near_chapters, F.abs(F.col("words") - F.col("many")) <= 0.1))

    def met(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
        pairs = rows.join(others, on).filter((F.col("node") < F.col("other")) & (F.col("origin") != F.col("from")))
        return pairs.withColumn("weight", weight(F.col("k"))).withColumn("beside", beside)

    names = {"node": "other", "origin": "from", "chapter": "there", "words": "many", "keys": "their"}
    kept = (keyed.join(hot, "k", "left_anti") if count else keyed).drop("keys").repartition("k")  # shuffled once for both sides
    pairs = met(kept, kept.withColumnsRenamed(names), ["k"]).select("node", "other", "weight", "beside")
    if count:  # one side of a hot key in slices, the other with every slice
        rows = keyed.join(hot, "k")
        left = rows.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).drop("slices")
        right = rows.withColumnsRenamed(names).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        # what all shared keys weigh is known here, so that pairs short of two units needn't be gathered to be counted
        shared = F.aggregate(F.array_intersect("keys", "their"), F.lit(0).cast("bigint"), lambda n, k: n + weight(k))
        pairs = pairs.unionByName(met(left, right, ["k", "slice"]).filter(shared + F.col("beside") >= 2).select("node", "other", "weight", "beside"))
    return pairs.groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg((F.sum("weight") + F.max("beside")).alias("shared")).filter("shared >= 2").select("a", "b")


def prior(l: str = "l", r: str = "r") -> Column:
    """Log-odds that two profiles are one work, from their attributes alone."""
    x = lambda c: F.col(f"{l}.{c}")
    y = lambda c: F.col(f"{r}.{c}")
    longest = F.greatest(F.length(x("name")), F.length(y("name")))
    apart = F.levenshtein(x("name"), y("name"))
    sorted_equal = F.array_sort(F.split(x("name"), "")) == F.array_sort(F.split(y("name"), ""))
    spelled = x("name").rlike(r"^[^\p{IsHan}]*$")  # letters, not ideographs: a slip costs more edits
    close = F.when(spelled, apart <= F.greatest(F.lit(2), F.floor(longest / 8))).otherwise((apart <= 1) & (longest >= 3) | (sorted_equal & (apart <= 2)))
    loose = F.when(spelled, apart <= F.greatest(F.lit(3), F.floor(longest / 5))).otherwise((apart <= 2) & (longest >= 4))
    same_name = x("name") == y("name")
    # a name that several authors use says less
    shared_name = F.greatest(x("authors"), y("authors"))
    name = F.when(same_name, F.when(shared_name <= 1, 3.5).otherwise(1.0)).when(close, 0.0).when(loose, -2.0).otherwise(-12.0)
    mark = F.when(x("mark") == y("mark"), 0.0).otherwise(-9.0)
    known = (x("author") != "") & (y("author") != "")
    part = x("author").startswith(y("author")) | y("author").startswith(x("author")) | ((x("initial") != "") & (x("family") == y("family")) & (x("initial") == y("initial")))
    slip = (F.levenshtein(x("author"), y("author")) <= F.when(F.length(x("author")) >= 8, 2).otherwise(1)) & (F.least(F.length(x("author")), F.length(y("author"))) >= 3)
    author = F.when(~known, 0.0).when(x("author") == y("author"), 3.0).when(part, 2.5).when(slip, 0.5).otherwise(-6.0)
    far = F.abs(x("chapter") - y("chapter"))
    chapter = F.when(far.isNull(), 0.0).when(far <= 10, 2.5).when(far <= 16, 0.5).otherwise(-5.0)
    ratio = F.abs(F.log(x("words") / y("words")))
    words = F.when(ratio.isNull(), 0.0).when(ratio <= 0.08, 2.0).when(ratio <= 0.16, 0.3).otherwise(-4.0)
    intro = F.when(x("intro").isNull() | y("intro").isNull(), 0.0).when(x("intro") == y("intro"), 4.0).otherwise(-0.4)
    kind = F.when(x("kind").isNull() | y("kind").isNull(), 0.0).when(x("kind") == y("kind"), 0.2).otherwise(-0.8)
    bit = lambda mask, place: F.expr(f"shiftrightunsigned({mask}, {place}) & 1")
    listed = bit(f"{l}.listed", f"{r}.place") + bit(f"{r}.listed", f"{l}.place")
    return F.lit(-1.5) + name + mark + author + chapter + words + intro + kind + 0.5 * listed


def propagate(pairs: DataFrame, iterations: int = 60, tolerance: float = 0.02, damping: float = 0.5, least: float = -6.0) -> DataFrame:
    """(a, b, belief): log-odds after messages between pairs and one-to-one factors.

    pairs: a, b, oa, ob, prior. A factor of ratios r tells its variable j the log of
    1 / (1 + sum of the other r), where r is the exponential of what a variable says.
    Messages are exchanged until none moves by more than tolerance; from the tenth round
    on they are damped more, which settles loops that swing. Raises if they don't settle.
    """
    live = written(pairs.filter(F.col("prior") > least), "scored")
    fa, fb = F.xxhash64(F.lit("a"), "a", "ob").alias("fa"), F.xxhash64(F.lit("b"), "b", "oa").alias("fb")
    live = live.select("a", "b", "prior", fa, fb)
    many = _small(live.select(F.explode(F.array("fa", "fb")).alias("f")).groupBy("f").count().filter("count > 1").select("f"), "contested")
    ca, cb = many.select(F.col("f").alias("fa"), F.lit(True).alias("ma")), many.select(F.col("f").alias("fb"), F.lit(True).alias("mb"))
    marked = live.join(ca, "fa", "left").join(cb, "fb", "left")
    contested = F.coalesce("ma", F.lit(False)) | F.coalesce("mb", F.lit(False))
    marked = marked.withColumn("contested", contested).select("a", "b", "prior", "fa", "fb", "contested")
    state = written(marked.filter("contested").drop("contested"), "messages").withColumn("ua", F.lit(0.0)).withColumn("ub", F.lit(0.0))  # messages of the two factors
    e = lambda c: F.exp(F.least(F.greatest(c, F.lit(-30.0)), F.lit(30.0)))
    for n in range(iterations):
        damping = min(damping if n < 10 else damping + 0.05, 0.9)
        said = state.withColumn("ra", e(F.col("prior") + F.col("ub"))).withColumn("rb", e(F.col("prior") + F.col("ua")))
        sa = said.groupBy("fa").agg(F.sum("ra").alias("sa"))
        sb = said.groupBy("fb").agg(F.sum("rb").alias("sb"))
        heard = said.join(sa, "fa").join(sb, "fb")
        na = -F.log1p(F.greatest(F.col("sa") - F.col("ra"), F.lit(0.0)))
        nb = -F.log1p(F.greatest(F.col("sb") - F.col("rb"), F.lit(0.0)))
        new = heard.select("a", "b", "prior", "fa", "fb", (damping * F.col("ua") + (1 - damping) * na).alias("ua"), (damping * F.col("ub") + (1 - damping) * nb).alias("ub"), F.abs(na - F.col("ua")).alias("da"), F.abs(nb - F.col("ub")).alias("db"))
        new = written(new, "messages")
        moved = new.agg(F.max(F.greatest("da", "db")).alias("m")).first()["m"]
        state = new.drop("da", "db")
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"messages still move by {moved} after {iterations} rounds")
    settled = state.select("a", "b", (F.col("prior") + F.col("ua") + F.col("ub")).alias("belief"))
    return settled.unionByName(marked.filter(~F.col("contested")).select("a", "b", F.col("prior").alias("belief")))


def match_hits(hits: DataFrame, least_confidence: float = 0.5, block_limit: int = 2000) -> DataFrame:
    """(hit_id_a, hit_id_b, confidence) of all pairs of hits of different origins that are likelier one work than not."""
    rows = written(profiles(hits), "profiles")
    # copies and names of several authors are few: only they are looked up
    copied = _small(rows.groupBy("node").agg(F.min("hit_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("node", "first"), "copied")
    nodes = rows.join(copied, "node", "left").filter(F.col("first").isNull() | (F.col("first") == F.col("hit_id"))).drop("first").withColumn("node", F.col("hit_id"))
    several = _small(nodes.filter("author != ''").groupBy("name", "mark").agg(F.count_distinct("family").alias("authors")).filter("authors > 1"), "several")
    facts = nodes.drop("keys", "hit_id").join(several, ["name", "mark"], "left").withColumn("authors", F.coalesce("authors", F.lit(1)))
    facts = written(facts, "facts")
    pairs = candidates(nodes, block_limit)
    l = facts.select(F.col("node").alias("a"), F.struct(*[c for c in facts.columns if c != "node"]).alias("l"))
    r = facts.select(F.col("node").alias("b"), F.struct(*[c for c in facts.columns if c != "node"]).alias("r"))
    scored = pairs.join(l, "a").join(r, "b").select("a", "b", F.col("l.origin").alias("oa"), F.col("r.origin").alias("ob"), prior().alias("prior"))
    beliefs = propagate(scored)
    limit = math.log(least_confidence / (1 - least_confidence))
    found = beliefs.filter(F.col("belief") >= limit).select("a", "b", (1 / (1 + F.exp(-F.col("belief")))).alias("confidence"))
    copies = _small(rows.join(copied, "node").select("first", "hit_id"), "copies")
    x, y = (copies.select(F.col("first").alias(n), F.col("hit_id").alias(f"{n}_copy")) for n in ("a", "b"))
    each = found.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("a_copy", "a").alias("x"), F.coalesce("b_copy", "b").alias("y"), "confidence")
    return each.select(F.least("x", "y").alias("hit_id_a"), F.greatest("x", "y").alias("hit_id_b"), "confidence")
