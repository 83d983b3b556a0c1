"""JSON, feed, TXT and bundle imports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys under which lists are wrapped.
SOURCE_KEYS = ("bookSourceList", "bookSources", "data", "sources")
FEED_KEYS = ("rssSources", "rssSourceList", "data", "sources")


def listed(value: Column, keys: tuple[str, ...]) -> Column:
    """The objects of a JSON text: an array, a list under one of the keys, or one object (S6, S7); null if it doesn't parse."""
    t = F.trim(value)
    arrays = F.coalesce(*[F.from_json(F.get_json_object(t, f"$.{k}"), "array<string>") for k in keys])
    whole = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    one = F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), F.array(t))
    return F.coalesce(whole, arrays, one)


def objects(files: DataFrame, column: str = "value", keys: tuple[str, ...] = SOURCE_KEYS) -> DataFrame:
    """(pos, item): one row per object; texts and items that don't parse are skipped."""
    rows = files.select(F.posexplode(listed(F.col(column), keys)).alias("pos", "item"))
    return rows.filter(F.try_parse_json("item").isNotNull() & F.trim("item").startswith("{"))


def read_objects(spark: SparkSession, path: str, keys: tuple[str, ...] = SOURCE_KEYS, glob: str = "*.json") -> DataFrame:
    return objects(spark.read.option("wholetext", "true").option("pathGlobFilter", glob).text(path), "value", keys)


def feed_items(feeds: DataFrame, url: str = "source_url", body: str = "body") -> DataFrame:
    """Articles of RSS and Atom feeds (S9): title, first link, summary, content, date, image, place.

    Items are cut out by pattern, so one broken item doesn't lose its feed.
    """
    text = F.col(body)
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<((?:item|entry)\b[^>]*>.*?)</(?:item|entry)>"), 1)
    rows = feeds.filter(text.isNotNull()).select(F.col(url).alias("source_url"), F.posexplode(blocks).alias("ord", "b"))

    def tag(*names: str) -> Column:
        def one(n: str) -> Column:
            raw = F.regexp_extract("b", rf"(?is)<{n}\b[^>]*>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{n}>", 1)
            return F.nullif(F.trim(raw), F.lit(""))
        return F.coalesce(*[one(n) for n in names])

    href = F.nullif(F.regexp_extract("b", r"""(?is)<link\b[^>]*?href\s*=\s*["']([^"']+)""", 1), F.lit(""))
    image = F.nullif(F.regexp_extract("b", r"""(?is)<(?:media:thumbnail|media:content|enclosure)\b[^>]*?url\s*=\s*["']([^"']+)""", 1), F.lit(""))
    stamp = tag("published", "pubDate", "updated", "dc:date")
    parsed = F.coalesce(F.try_to_timestamp(stamp), F.try_to_timestamp(F.regexp_replace(stamp, r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    return rows.select("source_url", "ord", tag("title").alias("title"), F.coalesce(tag("link"), href).alias("link"), tag("summary", "description").alias("summary"), tag("content:encoded", "content").alias("content"), parsed.alias("published"), image.alias("image"))


def merged_feeds(items: DataFrame) -> DataFrame:
    """Articles of many feeds, newest first, undated ones last in their place."""
    return items.orderBy(F.desc_nulls_last("published"), "source_url", "ord")


def text_files(spark: SparkSession, path: str, most_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """(path, text) of TXT files up to a size: UTF-8, else GB18030, without byte order mark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).filter((F.col("length") > 0) & (F.col("length") <= most_bytes))

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            try:
                return b.decode("utf-8-sig")
            except UnicodeDecodeError:
                return b.decode("gb18030", "replace")
        return data.map(one)

    return files.select("path", decode("content").alias("text"))


def recovered(df: DataFrame, column: str, key_fields: tuple[str, ...] = ("bookUrl", "origin"), row_key: str | None = None) -> DataFrame:
    """Objects of concatenated or damaged JSON texts up to the first error, repeats of a key dropped.

    row_key: a column, such as the owner of a shelf, that every object keeps.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for batch in batches:
            out = []
            for owner, text in zip(batch[row_key] if row_key else batch[column], batch[column]):
                at, seen, n, text = 0, set(), 0, text or ""
                while True:
                    while at < len(text) and text[at] in " \t\r\n,":
                        at += 1
                    try:
                        value, at = decoder.raw_decode(text, at)
                    except ValueError:
                        break
                    for item in value if isinstance(value, list) else [value]:
                        if not isinstance(item, dict):
                            continue
                        key = "::".join(str(item.get(k, "")) for k in key_fields)
                        if key not in seen:
                            seen.add(key)
                            out.append(((owner,) if row_key else ()) + (n, json.dumps(item, ensure_ascii=False, sort_keys=True)))
                            n += 1
            yield pd.DataFrame(out, columns=[*([row_key] if row_key else []), "pos", "item"])

    own = f"`{row_key}` {dict(df.dtypes)[row_key]}, " if row_key else ""
    return df.select(*([row_key] if row_key else []), column).mapInPandas(read, f"{own}pos int, item string")
