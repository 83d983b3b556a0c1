"""Template residue and error-page text (problem 5).

Method: records made from one template align on their text with numbers and host
masked. Three kinds of residue show in the alignment:
- unfilled slots: a name in template marks is a variable's name if the marks are ones
  that prose doesn't use, or if it stands in several kinds of marks or in such ones
  (template systems differ, their variables agree);
- repeated error templates and default fillers: main lines that recur in several
  books, mostly as the end of a record, and often in records that consist of
  recurring lines only. Lines of stories recur too, but not in these places;
- blind text: Latin text most of whose words hardly any other text has.
Navigation, scripts, noscript and other furniture is taken away before, by the
page operator, so words of this kind beside a whole main text count for nothing.

Defined results: null and blank texts are no cases; a record is named once;
repeated rows each give rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.pages import SLOT_MARKS, SURE_MARKS
from folioflow.session import written

ROW = ["table_name", "row_id"]


def main_lines(roles: DataFrame) -> DataFrame:
    """The main segments of every row; a page without its host's container counts with all its text but links and known furniture."""
    columns = [*ROW, "seq", "key", "book", "size", "slots", "latin"]
    # no container in the page: an error page outside the site's template
    stray = roles.filter((F.col("form") == "html") & ~F.col("inside") & ~F.col("known") & (F.col("link") < 0.5) & (F.col("kind") != "n") & (F.col("role") != "main"))
    with_container = roles.filter("inside").select(*ROW).distinct()
    return roles.filter(F.col("role") == "main").select(*columns).unionByName(stray.join(with_container, ROW, "left_anti").select(*columns))


def slot_rows(roles: DataFrame, least_marks: int = 2) -> DataFrame:
    """Rows with a slot named by a variable: a name in marks that prose doesn't use, or one in other marks that also stands in several kinds of marks or in such ones."""
    slots = roles.filter("slots is not null").select(*ROW, F.explode("slots").alias("slot")).withColumn("mark", F.substring_index("slot", " ", 1).cast("int")).withColumn("name", F.lower(F.substring_index("slot", " ", -1)))
    sure = F.col("mark").isin([k + 1 for k, (a, _) in enumerate(SLOT_MARKS) if a in SURE_MARKS])
    names = slots.groupBy("name").agg(F.count_distinct("mark").alias("marks"), F.bool_or(sure).alias("sure")).filter((F.col("marks") >= least_marks) | F.col("sure")).select("name")
    return slots.join(names, "name", "left_semi").select(*ROW).distinct()


def common_words(lines: DataFrame, least_share: float = 0.01) -> list[int]:
    """Words in a share of all Latin lines: at most the mean number of words a line has, over the share."""
    latin = lines.filter("latin is not null")
    total = latin.count()
    counts = latin.select(F.explode("latin").alias("w")).groupBy("w").count()
    return [r["w"] for r in counts.filter(F.col("count") >= max(2.0, least_share * total)).select("w").collect()]


def blind_rows(lines: DataFrame, most_common: float = 0.35) -> DataFrame:
    """Rows half of whose main text is Latin text of uncommon words."""
    words = common_words(lines)
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<int>")
    blind = F.coalesce(F.size(F.array_intersect("latin", known)) / F.size("latin") < most_common, F.lit(False))
    return lines.groupBy(*ROW).agg(F.sum(F.when(blind, F.col("size")).otherwise(0)).alias("blind"), F.sum("size").alias("size")).filter("blind * 2 > size").select(*ROW)


def template_rows(lines: DataFrame, least_books: int = 3, least_rows: int = 4, least_alone: float = 0.2, least_last: float = 0.8) -> DataFrame:
    """Rows that end in, or consist of, a repeated error or filler template."""
    lines = lines.select(*ROW, "seq", "key", "book")
    recurring = lines.groupBy("key", "book").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("books")).filter(F.col("books") >= least_books).select("key", F.lit(1).alias("rec"))
    marked = lines.join(recurring, "key", "left").withColumn("rec", F.coalesce("rec", F.lit(0)))
    # lines behind which only recurring lines follow are the end of a record
    tail = marked.groupBy(*ROW).agg(F.max(F.when(F.col("rec") == 0, F.col("seq")).otherwise(-1)).alias("story_end"))
    placed = marked.filter("rec = 1").join(tail, ROW).withColumn("ends", F.col("seq") > F.col("story_end")).withColumn("alone", F.col("story_end") == -1)
    per_row = placed.groupBy("key", *ROW).agg(F.bool_or("ends").alias("ends"), F.bool_or("alone").alias("alone"), F.first("book").alias("book"))
    bad = per_row.groupBy("key").agg(F.count("*").alias("n"), F.count_if("ends").alias("ends"), F.count_if("alone").alias("alone"))
    bad = bad.filter((F.col("n") >= least_rows) & (F.col("alone") >= least_alone * F.col("n")) & (F.col("ends") >= least_last * F.col("n"))).select("key")
    return per_row.filter("ends").join(bad, "key", "left_semi").select(*ROW).distinct()


def residue_rows(roles: DataFrame) -> DataFrame:
    """(table_name, row_id) of all rows whose main text is residue; roles of segments with detail."""
    lines = written(main_lines(roles), "lines")
    return slot_rows(lines).unionByName(blind_rows(lines)).unionByName(template_rows(lines)).distinct()
