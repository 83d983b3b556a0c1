"""Text cut off by field limits (problem 10), in SQL.

Method: word trigrams are counted inside texts and at ends; the last trigram of
every text is joined to the counts, and a text is flagged where its last trigram is
frequent inside but almost never terminal. An end is what the text's own end looks
like: a text that stops without a sentence mark is compared with grams at the ends of
lines that have none either (headings, lists, signatures), a text that stops with dots
that sentences use too, with grams at the ends of sentences. A rare trigram backs off
to the last two words, then to the last word; a word that ends no line at all is
terminal nowhere, so a text broken off within it is flagged.

Before that, marks systems put where they cut are taken off (with the brackets, blanks
and dots round them), and broken markup. Dots that texts also use inside are ordinary
punctuation; dots that stand at ends only are marks of a cut. A short last line whose
beginning is that of many last lines and of few others (a signature, remark, list or
address), or of lines that hardly ever close with a sentence mark (numbered headings),
closes a whole text.

Counts run over all documents; digits are one word, a CJK ideograph is a word. Only
grams whose last word ends some text are counted, which leaves every count asked for
whole.

Defined results: null and blank texts are never flagged and count in no share; a
text closing with a sentence mark is whole unless a mark of the cut follows it (the
point of a single letter is that of an initial and closes nothing); repeated rows each
give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import spread, written

# Marks that systems put where they cut; short ones are words of sentences too.
CUT_MARKS = ["阅读全文", "查看全文", "展开全文", "点击展开", "继续阅读", "continue reading", "read more", "show more", "see more", "lire la suite", "voir plus"]
SHORT_MARKS = ["展开", "more", "suite"]
# Marks that end a sentence or a line, and marks that close behind them.
ENDERS, QUOTES = tuple("。！？.!?\n…"), tuple("”’\"»）)」』】")
CLOSERS = "。！？.!?"
BLANKS = " \t\n\x0b\f\r　 ﻿"
#: characters at an end in which marks are looked for first, and what may stand round a mark
_END, _AROUND = 256, BLANKS + "….()（）[]【】<>" + "".join(QUOTES) + "\ufffd"
#: characters in which broken markup at an end is looked for: longer than any the pattern allows
_MARKUP = 80
_BROKEN = r"<[/!]?[A-Za-z]{0,20}[^<>]{0,40}$|&[A-Za-z]{0,7}$|\\u?[0-9a-fA-F]{0,3}$"
_LETTER = r"[\p{L}\p{M}&&[^\p{IsHan}]]"
_WORD = rf"{_LETTER}+(?:[’'\-]{_LETTER}+)*|\p{{IsHan}}|#|\n|[^\s\p{{L}}\p{{M}}]"
#: the beginning of a line is told by so many characters
_HEAD = 40
#: characters from which the last words are read; texts whose last words are longer are read whole
_TAIL = 400


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _closes(text: Column) -> Column:
    """Whether a text or line ends with a sentence mark, behind which quotation marks may close; not with an initial."""
    stem = F.rtrim(text, F.lit(BLANKS + "".join(QUOTES)))
    return F.right(stem, F.lit(1)).isin(*CLOSERS) & ~F.right(stem, F.lit(3)).rlike(r"(?:^|[^\p{L}\p{M}])\p{IsLatin}\.$")


def prepared(df: DataFrame, id_col: str, text_col: str, source_col: str | None) -> DataFrame:
    """doc_id, source, the trimmed text, the text without marks of a cut, the dots at its end, and how it ends."""
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    rows = spread(df.select(F.col(id_col).cast("bigint").alias("doc_id"), source.alias("source"), F.col(text_col).cast("string").alias("x")))
    rows = rows.select("doc_id", "source", _trim(F.col("x")).alias("t")).filter("t != ''")
    # marks, dots and brackets are looked for in the last characters; where these hold hardly anything else, in the whole text
    end = F.right("t", F.lit(_END))
    rows = _once(rows, "end", F.when(F.length(F.rtrim(end, F.lit(_AROUND))) >= _END // 2, end).otherwise(F.col("t")))
    # from the end: blanks and dots, a closing bracket, the words of the mark, an opening bracket, blanks and dots
    flat = F.when(F.endswith("end", F.lit("...")), F.rtrim("end", F.lit("."))).otherwise(F.col("end"))
    rows = _once(rows, "m", F.rtrim(flat, F.lit(BLANKS + "…)）]】>")))
    length = lambda marks: F.greatest(*[F.when(F.endswith(F.lower(F.right("m", F.lit(20))), F.lit(w)), F.lit(len(w))).otherwise(0) for w in marks])
    rows = rows.withColumn("long", length(CUT_MARKS)).withColumn("short", length(SHORT_MARKS))
    rows = rows.withColumn("left", F.rtrim(F.left("m", F.length("m") - F.greatest("long", "short")), F.lit(BLANKS)))
    # a short mark is a word like others unless dots or a bracket set it apart
    apart = (F.col("long") > 0) | (F.col("short") > 0) & F.right("left", F.lit(1)).isin(*"….([（【<")
    rows = _once(rows, "u", F.when(apart, _trim(F.rtrim("left", F.lit("(（[【<")))).otherwise(F.col("end")))
    short = F.right("u", F.lit(_MARKUP))
    unbroken = F.rtrim(F.concat(F.left("u", F.greatest(F.length("u") - _MARKUP, F.lit(0))), F.regexp_replace(short, _BROKEN, "")), F.lit("\ufffd"))
    rows = _once(rows, "b", unbroken)
    stem = F.rtrim("b", F.lit("…."))  # the dots at the end: a run of … or of three points and more
    run = F.substr("b", F.length(stem) + 1, F.length("b"))
    rows = _once(rows, "dots", F.when(run.contains("…") | run.contains("..."), run).otherwise(F.lit("")))
    rows = _once(rows, "stem", F.rtrim(F.when(F.col("dots") != "", stem).otherwise(F.col("b")), F.lit(BLANKS)))
    bare = F.concat(F.left("t", F.length("t") - F.length("end")), F.col("stem"))
    return rows.select("doc_id", "source", "t", bare.alias("bare"), (F.col("b") != F.col("end")).alias("marked"), "dots", (_closes(F.col("stem")) & (F.col("dots") == "")).alias("closed"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that later columns may use often: a generator keeps the optimizer from repeating its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def tokens(text: Column) -> Column:
    """Words: runs of letters, ideographs, '#' for a number, single marks, and line ends."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\d+", "#"), F.lit(f"({_WORD})"), 1)


def _last_words(text: Column) -> Column:
    """The words of the end of a text, three whole ones at least if it has them."""
    end = tokens(F.right(text, F.lit(_TAIL)))
    words = F.when((F.length(text) > _TAIL) & (F.size(F.filter(end, lambda x: x != "\n")) < 4), tokens(text)).otherwise(end)
    return F.filter(words, lambda x: x != "\n")


def gram_counts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, n, ending, bare): how often 1-3 words stand in texts, at the end of a sentence or line, and at the end of a line without a sentence mark.

    asked: the last words (g1) for which grams are counted.
    """
    # one text end is no evidence for itself: a text that isn't closed counts as followed by nothing
    w = _once(rows.select(F.when(F.col("closed"), F.col("t")).otherwise(F.col("bare")).alias("x")), "w", tokens(F.col("x"))).select("w")
    # the grams are built inside the array, so that exploding them doesn't carry the words along
    parts = F.transform(F.slice("w", 4, F.greatest(F.size("w") - 3, F.lit(0))), lambda d, i: F.struct(*[F.get("w", i + k).alias(x) for k, x in enumerate("abc")], d.alias("d")))
    grams = w.select(F.inline(parts)).join(asked.select(F.col("g1").alias("c")), "c", "left_semi")
    # the point after a single letter is that of an initial
    ends = (F.col("d").isin(*ENDERS) & ~((F.col("d") == ".") & F.col("c").rlike(r"^\p{IsLatin}$"))).cast("int")
    three = grams.groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.sum(ends).alias("ending"), F.count_if(F.col("d") == "\n").alias("bare"))
    flat = F.array(F.concat_ws(" ", "a", "b", "c"), F.concat_ws(" ", "b", "c"), F.col("c"))
    return three.select(F.explode(flat).alias("gram"), "n", "ending", "bare").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "ending", "bare")])


def line_heads(rows: DataFrame) -> DataFrame:
    """(head, last, other, open_inside, closed_inside): lines beginning so that close a text unpunctuated, that stand elsewhere, and of those before the last the ones without and with a sentence mark."""
    lines = F.filter(F.split("t", r"\n"), lambda x: x != "")
    rows = rows.select(lines.alias("l")).select(F.posexplode(F.col("l")).alias("k", "line"), F.size("l").alias("n"))
    rows = rows.select(_head(F.col("line")).alias("head"), (F.col("k") == F.col("n") - 1).alias("at_end"), (F.col("n") > 1).alias("several"), _closes(F.col("line")).alias("closes"))
    last = F.col("at_end") & F.col("several") & ~F.col("closes")
    return rows.groupBy("head").agg(F.count_if(last).alias("last"), F.count_if(~last).alias("other"), F.count_if(~F.col("at_end") & ~F.col("closes")).alias("open_inside"), F.count_if(~F.col("at_end") & F.col("closes")).alias("closed_inside"))


def dot_runs(rows: DataFrame) -> DataFrame:
    """(dots, dots_inside): whether a run of dots is ordinary punctuation inside texts, or stands at ends only.

    One row per distinct run of at most six dots (longer ones count as six).
    """
    runs = rows.select(F.explode(F.regexp_extract_all("t", F.lit(r"((?:…|\.{3})+)"), 1)).alias("run"), "dots").filter(F.length("run") <= 6)
    return runs.groupBy(F.col("run").alias("dots")).agg((F.count("*") > 3 * F.count_if(F.col("dots") == F.col("run"))).alias("dots_inside"))


def _head(line: Column) -> Column:
    """The beginning of a line: up to its first colon, digit or space, three characters at least of CJK text."""
    flat = F.regexp_replace(F.lower(F.left(line, F.lit(_HEAD))), r"\d+", "#")
    return F.regexp_extract(flat, r"^\s*([\p{L}\p{M}]{1,3}[:：]|\p{IsHan}{1,3}[^\p{IsHan}\p{L}]?|[^\s:：#]+(?:\s[^\s:：#]+)?[:：#]?|.)", 1)


def cut_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", most_ending: float = 0.25, least_count: int = 4, broadcast_words: int = 1_000_000) -> DataFrame:
    """(doc_id, source, cut) of every document with text; cut says whether it breaks off.

    most_ending: share of a gram's occurrences at ends up to which it ends nothing.
    least_count: occurrences below which a gram says too little and is shortened.
    broadcast_words: last words up to which, counted, they are broadcast; beyond, they are joined by a shuffle.
    """
    rows = prepared(df, id_col, text_col, source_col)
    n = F.size("w")
    at = lambda k: F.when(n >= k, F.try_element_at(F.col("w"), n - k + 1))
    line = F.element_at(F.filter(F.split("t", r"\n"), lambda x: x != ""), -1)
    last = _once(_once(rows, "w", F.when(~F.col("closed"), _last_words(F.col("bare")))), "line", line)
    last = last.select(
        "doc_id", "source", "closed", "marked", "dots", _head(F.col("line")).alias("head"), (F.col("t").contains("\n") & (F.length("line") <= 80)).alias("short_line"),
        F.when(n >= 3, F.concat_ws(" ", at(3), at(2), at(1))).alias("g3"), F.when(n >= 2, F.concat_ws(" ", at(2), at(1))).alias("g2"), at(1).alias("g1"),
    )
    last = written(last, "ends")  # a few short columns; read for the words asked, for the join and for the closed texts
    open_rows = last.filter("not closed")
    words = open_rows.select("g1").filter("g1 is not null").distinct()
    counts = gram_counts(rows, F.broadcast(words) if words.count() <= broadcast_words else words)
    # one join for the three lengths: the grams are exploded, joined and folded again by document
    asked = open_rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("gram")) for k in (3, 2, 1)])).alias("q")).select("doc_id", "q.k", "q.gram").filter("gram is not null")
    known = asked.join(counts, "gram").groupBy("doc_id").agg(*[F.max(F.when(F.col("k") == k, F.struct("n", "ending", "bare"))).alias(f"s{k}") for k in (3, 2, 1)])
    told = open_rows.join(known, "doc_id", "left").join(line_heads(rows), "head", "left").join(F.broadcast(dot_runs(rows)), "dots", "left")
    # the longest gram that is frequent enough speaks; one that nothing is known of ends nothing
    spoken = F.coalesce(*[F.when(F.col(f"s{k}.n") >= least_count, F.col(f"s{k}.bare") / F.col(f"s{k}.n")) for k in (3, 2, 1)], F.lit(0.0))
    closing = (F.col("last") >= 3) & (F.col("last") > 2 * F.col("other")) | (F.col("open_inside") >= least_count) & (F.col("open_inside") > 4 * F.col("closed_inside"))
    verdict = (
        F.when(F.col("marked"), spoken <= most_ending)
        .when(F.col("short_line") & closing, F.lit(False))
        .when(F.col("dots_inside"), (F.col("s3.n") >= 5 * least_count) & (F.col("s3.ending") / F.col("s3.n") <= most_ending / 10))
        .otherwise(spoken <= most_ending)
    )
    flagged = told.select("doc_id", "source", F.coalesce(verdict, F.lit(False)).alias("cut"))
    return flagged.unionByName(last.filter("closed").select("doc_id", "source", F.lit(False).alias("cut")))


def cut_share(cut: DataFrame) -> DataFrame:
    """Of each source: documents, cut documents and their share; null sources are one group."""
    return cut.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut_documents")).withColumn("share", F.round(F.col("cut_documents") / F.col("documents"), 6))
