"""Hashes, ciphers, encodings, times and numbers rules may use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STRENGTHS = {"strong": 3, "moderate": 2, "weak": 1}


def keyed_md5(*parts: Column) -> Column:
    """md5 of parts joined by line ends."""
    return F.md5(F.concat_ws("\n", *parts))


def aes_cbc_text(data: Column, key: str, iv: str) -> Column:
    """Base64 of AES-CBC with PKCS padding as text; blank where it doesn't decrypt."""
    whole = F.concat(F.encode(F.lit(iv), "UTF-8"), F.try_to_binary(data, F.lit("base64")))
    return F.coalesce(F.try_aes_decrypt(whole, F.encode(F.lit(key), "UTF-8"), F.lit("CBC"), F.lit("PKCS")).cast("string"), F.lit(""))


def uri_component(x: Column) -> Column:
    """Percent encoding of a component, spaces as %20 and ~!*'() as they are."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def minutes(t: Column) -> Column:
    """yyyy-MM-dd HH:mm of epoch seconds, or of milliseconds beyond 1e12."""
    return F.date_format(F.timestamp_seconds(F.when(t > 1_000_000_000_000, t / 1000).otherwise(t)), "yyyy-MM-dd HH:mm")


def reading_time(seconds: Column) -> Column:
    """Hours and minutes in words."""
    h, m = F.floor(seconds / 3600).cast("bigint"), F.floor(seconds % 3600 / 60).cast("bigint")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("小时"), m.cast("string"), F.lit("分钟"))).when(m > 0, F.concat(m.cast("string"), F.lit("分钟"))).otherwise(F.lit("不足1分钟"))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def recency(now: Column, seen: Column, span: int = 8) -> Column:
    """How near two places are, 0 beyond a span."""
    return F.greatest(F.lit(0), span - F.abs(now - seen))


def strength(x: Column) -> Column:
    out = None
    for name, value in STRENGTHS.items():
        out = F.when(x == name, value) if out is None else out.when(x == name, value)
    return out.otherwise(0)
