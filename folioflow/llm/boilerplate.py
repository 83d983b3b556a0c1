"""Page boilerplate mixed with main content (problem 6): tree scoring.

Method: every paragraph earns points for its length and its commas, discounted by
its share of link text, and passes them to its parent and half of them to its
grandparent. Points are pooled over all pages of a host by the containers'
signatures (pages of a site share their template, so a page with one short
paragraph still gets its container); the best signature of a host is the main
body, and every element of that signature in a page is kept with it.

What stands outside main bodies is furniture, and teaches what furniture looks
like: texts (numbers and the own host masked) seen mostly outside main bodies on
several hosts, words of menu links, headings of side blocks. These find furniture
inside main bodies and in plain texts, which have no tree.

Defined results: null and blank texts have no lines; lines are split at "\n" and
numbered from 0; JSON texts have no furniture; a line with any main text, a
chapter heading or no visible text is no furniture; a page whose host elects no
container keeps everything outside menus; repeated rows each give rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import written


def main_containers(segments: DataFrame) -> DataFrame:
    """(host, main): the signature with the most points of each host."""
    parts = F.split("path", ">")
    n = F.size(parts)
    # text straight in a container counts for it; text in a paragraph counts for what holds the paragraph
    inner = F.regexp_extract(F.element_at(parts, -1), r"^(\w+)", 1).isin("p", "li", "h2", "h3", "h4", "dd", "dt", "blockquote", "pre")
    level = lambda k: F.when(n > k - 1, F.try_element_at(parts, F.lit(-k)))
    first, second = F.when(inner, level(2)).otherwise(level(1)), F.when(inner, level(3)).otherwise(level(2))
    given = segments.filter((F.col("form") == "html") & F.col("kind").isin("t") & (F.col("points") > 0))
    points = given.select("host", F.explode(F.array(F.struct(first.alias("sig"), F.col("points").alias("x")), F.struct(second.alias("sig"), (F.col("points") / 2).alias("x")))).alias("p"))
    total = points.filter("p.sig is not null").groupBy("host", "p.sig").agg(F.sum("p.x").alias("x"))
    return total.groupBy("host").agg(F.max_by("sig", F.struct("x", "sig")).alias("main"))


def with_place(segments: DataFrame, broadcast_hosts: int = 200_000, salts: int = 64) -> DataFrame:
    """Adds `inside`: true in the main body, false outside, null where there is no tree.

    Hosts have one row each: up to broadcast_hosts of them, counted, they are broadcast;
    beyond, they are repeated under `salts` numbers, over which the rows of a hot host spread.
    """
    hosts = written(main_containers(segments), "containers")
    if hosts.count() <= broadcast_hosts:
        placed = segments.join(F.broadcast(hosts), "host", "left")
    else:
        salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        placed = segments.withColumn("salt", F.pmod(F.xxhash64("table_name", "row_id"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    inside = F.array_contains(F.split("path", ">"), F.col("main"))
    return placed.withColumn("inside", F.when(F.col("form") == "html", F.coalesce(inside, F.lit(False)) & (F.col("kind") != "n")))


def furniture_keys(placed: DataFrame, least_hosts: int = 2) -> DataFrame:
    """(key): texts seen outside main bodies on several hosts, and more often there than inside."""
    html = placed.filter((F.col("form") == "html") & (F.col("kind") != "h"))
    by_host = html.groupBy("key", "host").agg(F.count_if(~F.col("inside")).alias("out"), F.count_if(F.col("inside")).alias("in"))
    return by_host.groupBy("key").agg(F.count_if(F.col("out") > 0).alias("hosts"), F.sum("out").alias("out"), F.sum("in").alias("in")).filter((F.col("hosts") >= least_hosts) & (F.col("out") > F.col("in"))).select("key")


def _vocabulary(placed: DataFrame, word: Column, least_share: float) -> list[str]:
    """Words on a share of all hosts: at most 1 / share times as many as a host has, however many hosts there are."""
    rows = placed.withColumn("w", word).filter("w is not null").select("host", "w").distinct()
    hosts = placed.agg(F.count_distinct("host").alias("n")).first()["n"]
    return sorted(r["w"] for r in rows.groupBy("w").count().filter(F.col("count") >= max(2, least_share * hosts)).select("w").collect())


def menu_words(placed: DataFrame, least_pages: float = 0.2, least_hosts: int = 2) -> list[str]:
    """Words of links that stand outside main bodies on a share of the pages of several hosts.

    A host has at most its links a page, over the share, of them; links to single
    works don't reach it.
    """
    html = placed.filter(F.col("form") == "html")
    menus = html.filter(~F.col("inside") & (F.col("link") > 0.5) & F.col("words").isNotNull())
    on = menus.select("host", "table_name", "row_id", F.explode("words").alias("w")).distinct().groupBy("host", "w").agg(F.count("*").alias("n"))
    pages = html.select("host", "table_name", "row_id").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    wide = on.join(pages, "host").filter(F.col("n") >= F.greatest(F.lit(2), least_pages * F.col("pages")))
    rows = wide.groupBy("w").count().filter(F.col("count") >= least_hosts).select("w").collect()
    return sorted({w for r in rows for w in r["w"].split()})


def side_headings(placed: DataFrame, least_share: float = 0.03) -> list[str]:
    return _vocabulary(placed.filter((F.col("form") == "html") & ~F.col("inside") & (F.col("kind") == "s")), F.col("head"), least_share)


def classified(segments: DataFrame, broadcast_keys: int = 500_000) -> DataFrame:
    """Adds `role` to every segment: main, heading or furniture. Texts are parsed once, into a written table."""
    placed = with_place(written(segments, "segments"))
    words, heads = menu_words(placed), side_headings(placed)
    known = written(furniture_keys(placed), "furniture").withColumn("known", F.lit(True))
    if known.count() <= broadcast_keys:  # 8 bytes each; beyond it both sides are shuffled
        known = F.broadcast(known)
    rows = placed.join(known, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    menu = F.col("words").isNotNull() & (F.size("words") >= 2) & (F.size(F.array_except("words", F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"))) == 0)
    bread = F.coalesce(F.col("sep") & (F.size("words") >= 3) & F.element_at("words", 1).isin(words), F.lit(False)) if words else F.lit(False)
    side = F.coalesce(F.col("head").isin(heads), F.lit(False)) if heads else F.lit(False)
    # a chapter may name its site; a line of its own that does so is its advertising
    advert = F.col("own") & (F.col("size") <= 120)
    shown = F.col("known") | F.coalesce(menu | bread, F.lit(False)) | side | advert
    role = (
        F.when(F.col("kind") == "n", "furniture")
        .when(F.col("kind") == "h", "heading")
        .when(F.col("form") == "json", "main")
        .when(F.col("form") == "html", F.when(~F.col("inside"), F.when(F.col("main").isNull() & ~shown & (F.col("link") < 0.5), "main").otherwise("furniture")).when(F.col("known") | advert | (F.col("link") > 0.5), "furniture").otherwise("main"))
        .otherwise(F.when(shown, "furniture").otherwise("main"))
    )
    return rows.select("table_name", "row_id", "line_no", "seq", "form", "kind", "inside", "known", "link", "key", "book", "size", "slots", "latin", role.alias("role"))


def furniture_lines(roles: DataFrame) -> DataFrame:
    """(table_name, row_id, line_no) of lines whose visible text is furniture only."""
    lines = roles.filter("form != 'json'").groupBy("table_name", "row_id", "line_no").agg(F.bool_and(F.col("role") == "furniture").alias("only"))
    return lines.filter("only").select("table_name", "row_id", "line_no")
