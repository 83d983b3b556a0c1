"""Reading statistics, documents with fallbacks, backups and imported texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a book made of an imported text says of itself.
IMPORTED_AUTHOR, IMPORTED_KIND = "本地导入", "本地TXT"


def statistics(shelf: DataFrame, user: str = "user_ns") -> DataFrame:
    """Of each user: seconds, books opened, chapters read and books completed."""
    done = (F.col("total_chapter_num") > 0) & (F.col("dur_chapter_index") >= F.col("total_chapter_num") - 1)
    return shelf.groupBy(user).agg(
        F.sum(F.coalesce("dur_chapter_pos", F.lit(0))).cast("bigint").alias("total_seconds"), F.count_distinct("book_url").alias("opened_books"),
        F.count_distinct("book_url", "dur_chapter_index").alias("read_chapters"), F.count_distinct(F.when(done, F.col("book_url"))).alias("completed_books"),
    )


def time_text(seconds: Column) -> Column:
    """Hours and minutes in words; one minute at least."""
    minutes = F.floor(seconds / 60)
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("小时"), (minutes % 60).cast("string"), F.lit("分钟"))).otherwise(F.concat(F.greatest(minutes, F.lit(1)).cast("string"), F.lit("分钟")))


def batch_totals(results: DataFrame, ok: Column, batch: Column) -> DataFrame:
    """Totals of each batch of test results, the partial form of A8."""
    return results.groupBy(batch.alias("batch")).agg(F.count("*").alias("total"), F.count_if(ok).alias("available"), F.count_if(~ok).alias("failed"))


def merged_totals(batches: DataFrame) -> DataFrame:
    """The final form: batches added up."""
    return batches.agg(*[F.sum(c).alias(c) for c in ("total", "available", "failed")], F.count("*").alias("batches"))


def recent(shelf: DataFrame, cached: DataFrame, keys: tuple[str, str] = ("user_ns", "book_url")) -> DataFrame:
    """The latest shelf row of every book with what the browser has of it (J15): cache rows are counted before the join."""
    last = shelf.groupBy(*keys).agg(F.max_by(F.struct("name", "dur_chapter_index"), F.struct("dur_chapter_time", "shelf_id")).alias("b"))
    have = cached.groupBy(keys[1]).agg(F.count("*").alias("cached_chapters"), F.max("updated_at").alias("cached_at"))
    return last.join(have, keys[1], "left").select(*keys, "b.name", "b.dur_chapter_index", F.coalesce("cached_chapters", F.lit(0)).alias("cached_chapters"), "cached_at")


def with_fallback(wanted: DataFrame, store: DataFrame, legacy: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Wanted keys with their value from the store, else from an older place, and where it came from."""
    one, two = store.select(*keys, F.col(value).alias("_one")), legacy.select(*keys, F.col(value).alias("_two"))
    found = wanted.join(one, keys, "left").join(two, keys, "left")
    return found.select(*wanted.columns, F.coalesce("_one", "_two").alias(value), F.when(F.col("_one").isNotNull(), "store").when(F.col("_two").isNotNull(), "legacy").otherwise("none").alias("place"))


def backup(raw: Column) -> Column:
    """The parts of a backup with defaults; null where it is no JSON object or lacks version or shelf."""
    part = lambda path, default: F.coalesce(F.get_json_object(raw, path), F.lit(default))
    whole = F.coalesce(F.get_json_object(raw, "$.version"), F.lit("")).isin("", "0", "false").__invert__() & F.get_json_object(raw, "$.bookshelf").isNotNull()
    return F.when(whole, F.struct(
        F.get_json_object(raw, "$.version").alias("version"), part("$.app", "reader").alias("app"), part("$.bookshelf.books", "[]").alias("books"), part("$.bookshelf.groups", "[]").alias("groups"),
        part("$.bookSources", "[]").alias("sources"), part("$.bookmarks", "[]").alias("bookmarks"), part("$.replaceRules", "[]").alias("rules"),
    ))


def imported_books(chapters: DataFrame, keys: tuple[str, str] = ("user_ns", "book_url")) -> DataFrame:
    """A book row of every imported text: constant author and kind, chapters, last title and length."""
    # a repeated chapter counts once, as it came last
    one = chapters.groupBy(*keys, "chapter_index").agg(F.max_by(F.struct("title", F.char_length("content").alias("n")), "chapter_id").alias("c"))
    book = one.groupBy(*keys).agg(F.count("*").alias("total_chapter_num"), F.max_by("c.title", "chapter_index").alias("latest_chapter_title"), F.sum("c.n").alias("n"))
    return book.select(*keys, F.lit(IMPORTED_AUTHOR).alias("author"), F.lit(IMPORTED_KIND).alias("kind"), "total_chapter_num", "latest_chapter_title", F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit("字")).alias("word_count"))


def masked(rows: DataFrame, secrets: list[str]) -> DataFrame:
    """Rows whose secret fields are blank; whether each was set stays told."""
    return rows.withColumns({f"has_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in secrets} | {c: F.lit("") for c in secrets})


def bookmark_key(name: Column, author: Column) -> Column:
    """One bookmark a book: its name and author."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit("_"), F.coalesce(author, F.lit("")))


def feed_text(raw: Column) -> Column:
    """Text of a feed without scripts and styles; a whole page instead of a text is refused."""
    page = F.lower(raw).rlike("<html|<body|<head|<form|搜索|首页|广告拦截器")
    kept = raw
    for tag in ("script", "style", "noscript"):
        kept = F.regexp_replace(kept, rf"(?is)<{tag}.*?</{tag}>", "")
    return F.when(raw.isNull() | page, "").otherwise(F.btrim(kept, F.lit(" \t\n\x0b\f\r")))
