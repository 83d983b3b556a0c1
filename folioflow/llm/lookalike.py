"""Visually identical text with different characters (problem 3), in SQL.

Method: every value is mapped by look-alike tables, mapped values are grouped
under the accent-sensitive Unicode collation UNICODE_CI (which ignores zero-width
characters and differences of width and compatibility, but keeps accents), one
canonical member is chosen per class, and it is joined back to the rows.

The canonical member is the clean member most rows have (ties: the least string
in code-point order); a class without a clean member takes its least mapped
value. A value is `dirty` if it holds invisible characters, spaces other than
U+0020, full-width letters or digits, decomposed accents, compatibility forms or
letters of another script than its own writing.

Defined results: null values give no row; an empty string is its own class and
clean; repeated rows each give a row; very long values are handled whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import written

# Look-alike letters, each with the Latin letter it resembles.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXovcj"
LATIN_AS_CYRILLIC = "ABEKMHOPCTYXaeopcyxSsIiJj"
CYRILLIC_FOR_LATIN = "АВЕКМНОРСТУХаеорсухЅѕІіЈј"

# Java regular expressions of the character classes.
INVISIBLE = r"[\p{Cf}\p{Cc}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"
OTHER_SPACE = r"[\p{Z}&&[^ ]]"
COMPATIBILITY = (
    r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FF9F}\x{FFA1}-\x{FFDC}"
    r"\x{2E80}-\x{2FD5}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}\x{FB00}-\x{FB4F}\x{2100}-\x{2109}\x{210A}-\x{2138}\x{2160}-\x{217F}"
    r"\x{2460}-\x{24FF}\x{3200}-\x{33FF}\x{1D400}-\x{1D7FF}\x{1F100}-\x{1F16F}\x{2070}-\x{209C}\xAA\xB2\xB3\xB9\xBA\x{2B0}-\x{2B8}\x{1C4}-\x{1CC}\x{1F1}-\x{1F3}\x{132}\x{133}\x{17F}]"
)
DECOMPOSED = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{IsHiragana}\p{IsKatakana}][\x{300}-\x{34E}\x{350}-\x{36F}\x{3099}\x{309A}]"
_OTHER = r"\p{IsCyrillic}\p{IsGreek}"
_EDGE = r"(?<![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}])"
_END = r"(?![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}])"
MIXED_WORD = rf"\p{{IsLatin}}\p{{M}}*[{_OTHER}]|[{_OTHER}]\p{{M}}*\p{{IsLatin}}|\p{{IsGreek}}\p{{M}}*\p{{IsCyrillic}}|\p{{IsCyrillic}}\p{{M}}*\p{{IsGreek}}"
FOREIGN_WORD = rf"{_EDGE}[{CYRILLIC}{GREEK}]+{_END}"


@cache
def _tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """By rule from the Unicode data: one-to-one compatibility forms, and the clusters that need a lookup."""
    one_from, one_to, many = [], [], []
    for cp in range(0x80, min(sys.maxunicode, 0x2FFFF)):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind[0] not in "LNS" or 0xAC00 <= cp <= 0xD7A3:
            continue
        flat = unicodedata.normalize("NFKC", ch)
        if flat != ch and any(unicodedata.category(x)[0] in "LN" for x in flat):
            if len(flat) == 1:
                one_from.append(ch)
                one_to.append(flat)
            else:
                many.append((ch, flat))
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and cp < 0x3100 and unicodedata.normalize("NFC", apart) == ch:
            many.append((apart, ch))
    return "".join(one_from), "".join(one_to), tuple(many)


def _has(value: Column, pattern: str) -> Column:
    return value.rlike(pattern)


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value computed once; plain nesting would repeat the expression at every use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def flattened(value: Column) -> Column:
    """Without invisible characters, every space U+0020, one-to-one compatibility forms flattened."""
    one_from, one_to, _ = _tables()
    return F.translate(F.regexp_replace(F.regexp_replace(value, INVISIBLE, ""), OTHER_SPACE, " "), one_from, one_to)


def visible(value: Column) -> Column:
    """Flattened, the forms of several letters spelled out and accents composed."""
    _, _, many = _tables()
    lookup = F.create_map(*[F.lit(x) for pair in many for x in pair])
    clusters = lambda v: F.regexp_extract_all(v, F.lit(r"(?s)(.[\x{300}-\x{36F}\x{3099}\x{309A}]*)"), 1)
    return _let(flattened(value), lambda v: F.array_join(F.transform(clusters(v), lambda c: F.coalesce(F.try_element_at(lookup, c), c)), ""))


def own_script(value: Column) -> Column:
    """Look-alike letters brought back to the script most of the value's letters have."""
    return _let(value, _own_script)


def _own_script(value: Column) -> Column:
    latin, other = _count(value, r"\p{IsLatin}"), _count(value, rf"[{_OTHER}]")
    to_latin = F.translate(value, CYRILLIC + GREEK, CYRILLIC_AS_LATIN + GREEK_AS_LATIN)
    # true Cyrillic words stand beside Latin ones only whole; a look-alike of them is turned word by word
    to_cyrillic = F.translate(value, LATIN_AS_CYRILLIC, CYRILLIC_FOR_LATIN)
    foreign = _has(value, MIXED_WORD) | _has(value, FOREIGN_WORD)
    unlike = _has(value, rf"[{_OTHER}&&[^{CYRILLIC}{GREEK}]]")
    return (
        F.when(~_has(value, rf"[{_OTHER}]"), value)
        .when(unlike & _has(value, MIXED_WORD), to_cyrillic)
        .when(unlike, value)
        .when(foreign & ((latin > 0) | _has(value, r"\p{IsHan}")), to_latin)
        .otherwise(value)
    )


def is_dirty(value: Column) -> Column:
    """Whether a value is made of other characters than it seems; false for null."""
    plain = _has(value, INVISIBLE) | _has(value, OTHER_SPACE) | _has(value, COMPATIBILITY) | _has(value, DECOMPOSED)
    other = _has(value, rf"[{_OTHER}]")
    return F.coalesce(plain | (other & _let(flattened(value), _mixes_scripts)), F.lit(False))


def _mixes_scripts(shown: Column) -> Column:
    latin, unlike = _count(shown, r"\p{IsLatin}"), _has(shown, rf"[{_OTHER}&&[^{CYRILLIC}{GREEK}]]")
    # a Latin word of look-alikes beside Cyrillic ones is no mixture: a numeral of the series
    return _has(shown, MIXED_WORD) | (~unlike & ((latin > 0) | _has(shown, r"\p{IsHan}")) & _has(shown, FOREIGN_WORD))


def values_of(df: DataFrame, table_name: str, id_col: str, fields: list[str]) -> DataFrame:
    """(table_name, row_id, field_name, value), one row per non-null value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = df.select(F.lit(table_name).alias("table_name"), F.col(id_col).cast("bigint").alias("row_id"), F.explode(pairs).alias("p"))
    return rows.select("table_name", "row_id", "p.field_name", "p.value").filter(F.col("value").isNotNull())


def classes(values: DataFrame) -> DataFrame:
    """(value, dirty, canonical) of every distinct value: one aggregation by value, one by class."""
    distinct = values.groupBy("value").agg(F.count("*").alias("rows"))
    mapped = distinct.withColumn("dirty", is_dirty(F.col("value"))).withColumn("mapped", F.when(F.col("dirty"), own_script(visible(F.col("value")))).otherwise(F.col("value")))
    keyed = mapped.withColumn("class_key", F.collate(F.col("mapped"), "UNICODE_CI"))
    # repeated spellings pre-aggregate; the winner of a class is one small struct, so a hot class stays cheap
    rank = F.struct(F.col("dirty").cast("int").alias("d"), (-F.col("rows")).alias("r"), F.col("mapped").alias("m"))
    best = keyed.groupBy("class_key").agg(F.min(rank).alias("best"))
    return keyed.join(best, "class_key").select("value", "dirty", F.col("best.m").alias("canonical"))


def canonical_forms(values: DataFrame) -> DataFrame:
    """Every row's value with the canonical member of its class and whether it was dirty."""
    return values.join(classes(values), "value").select("table_name", "row_id", "field_name", "value", "canonical", "dirty")


def _plainly(value: Column) -> Column:
    """A value without what members of a class may rightly differ in: case, and punctuation of either width."""
    return F.lower(F.regexp_replace(value, r"[\p{P}\p{S}]", ""))


def lookalike_rows(values: DataFrame, broadcast_values: int = 200_000) -> DataFrame:
    """The rows whose value is not what the canonical member of its class shows.

    Values are told apart from their canonical member once each; those that differ are
    counted, and up to broadcast_values of them are broadcast to the rows.
    """
    found = classes(values).filter(_plainly(F.col("value")) != _plainly(F.col("canonical"))).select(F.col("value").alias("v"), "canonical")
    found = written(found, "lookalikes")
    found = F.broadcast(found) if found.count() <= broadcast_values else found
    return values.join(found, values["value"] == found["v"]).select("table_name", "row_id", "field_name", "value", "canonical")
