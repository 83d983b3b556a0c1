"""Segmentation of texts into chapters, byte offsets included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.session import spread


def chapters(texts: DataFrame, key: str = "book_url", body: str = "text") -> DataFrame:
    """(key, index, title, url, start_pos, end_pos, content) of every chapter.

    A line is a heading by its form. What stands before the first heading is a
    prologue; a text without headings is one chapter. Offsets count UTF-8 bytes and
    are kept within the row: lines become an array of structs, heading positions are
    picked from it and each chapter is a slice, so texts are neither exploded by
    line nor shuffled.

    Null texts give no row; an empty text gives one empty chapter.
    """
    lines = F.split(F.col(body), "\n")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<head: bigint, begin: bigint, title: string>>").alias("heads"))

    def step(acc: Column, line: Column) -> Column:
        raw = F.regexp_replace(line, r"\r+$", "")
        title = text.utrim(raw)
        lead = F.octet_length(raw) - F.octet_length(F.regexp_replace(raw, f"^{text.WS}+", ""))
        head = F.struct((acc["at"] + lead).cast("bigint").alias("head"), (acc["at"] + F.octet_length(line) + 1).cast("bigint").alias("begin"), title.alias("title"))
        heads = F.when((title != "") & text.is_heading(title), F.array_append(acc["heads"], head)).otherwise(acc["heads"])
        return F.struct((acc["at"] + F.octet_length(line) + 1).cast("bigint").alias("at"), heads.alias("heads"))

    found = spread(texts).select(F.col(key).alias("book_url"), F.col(body).alias("t"), F.aggregate(lines, start, step)["heads"].alias("heads")).filter("t is not null")
    size = F.octet_length("t").cast("bigint")
    cut = lambda raw, a, b: F.decode(F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "UTF-8")
    whole = F.struct(F.lit("正文").alias("title"), F.lit(0).cast("bigint").alias("a"), size.alias("b"))
    front = F.struct(F.lit("序章").alias("title"), F.lit(0).cast("bigint").alias("a"), F.get("heads", F.lit(0))["head"].alias("b"))
    each = F.transform("heads", lambda h, i: F.struct(h["title"].alias("title"), F.least(h["begin"], size).alias("a"), F.coalesce(F.get("heads", i + 1)["head"], size).alias("b")))
    has_front = text.utrim(cut(F.encode("t", "UTF-8"), F.lit(0), F.get("heads", F.lit(0))["head"])) != ""
    parts = F.when(F.size("heads") == 0, F.array(whole)).when(has_front, F.concat(F.array(front), each)).otherwise(each)
    # the slices are cut from one array of bytes before the rows are made, so no chapter carries the whole text
    slices = lambda raw: F.transform(parts, lambda p, i: F.struct(i.alias("index"), p["title"].alias("title"), p["a"].alias("start_pos"), F.when(F.size("heads") == 0, F.col("t")).otherwise(F.regexp_replace(cut(raw, p["a"], p["b"]), r"[\r\n]+$", "")).alias("content")))
    rows = found.select("book_url", F.inline(F.element_at(F.transform(F.array(F.encode("t", "UTF-8")), slices), 1)))
    return rows.select("book_url", "index", "title", F.concat(F.regexp_replace("book_url", "#+$", ""), F.lit("#"), F.col("index").cast("string")).alias("url"), "start_pos", (F.col("start_pos") + F.octet_length("content")).alias("end_pos"), "content")


def read_range(data: Column, start: Column, end: Column) -> Column:
    """The text of a byte range of a text."""
    return F.decode(F.substring(F.encode(data, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
