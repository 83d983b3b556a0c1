"""Permissive reading of model output: fences, truncation, shapes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields that hold a text, in order of preference.
TEXT_KEYS = ("name", "title", "content", "text", "summary", "description", "value")


def balanced(text: str) -> str | None:
    """The first object of a text whose braces close, strings respected."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)):
        c = text[k]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text[start : k + 1]
    return None


def repaired(text: str) -> str | None:
    """A truncated object closed: the open string ended, a dangling member dropped, brackets closed."""
    start = text.find("{")
    if start < 0:
        return None
    body, stack, quoted, escaped = text[start:], [], False, False
    for c in body:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    if escaped:
        body = body[:-1]
    closing = "".join(reversed(stack))
    attempts = [body + ('"' if quoted else "")]
    attempts += [re.sub(r',?\s*"[^"]*"?\s*:?\s*$', "", attempts[0]), re.sub(r",\s*$", "", attempts[0]), re.sub(r":\s*$", ": null", attempts[0]), re.sub(r',?\s*"[^"]*"\s*:\s*[^",{\[\]}]*$', "", attempts[0])]
    for a in attempts:
        try:
            return json.dumps(json.loads(a + closing), ensure_ascii=False)
        except ValueError:
            continue
    return None


def parsed(text: str | None) -> dict | None:
    """The object a model's answer holds, fences and talk around it aside; null if there is none."""
    if not text:
        return None
    plain = re.sub(r"^\s*```[\w-]*\s*|\s*```\s*$", "", text.strip())
    for attempt in (plain, balanced(plain), repaired(plain)):
        if attempt is None:
            continue
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def as_objects(value: object, key: str, keep_strings: bool = True) -> list[dict]:
    """A list of objects from a list, one object or strings, which become objects of one key."""
    items = value if isinstance(value, list) else [] if value is None else [value]
    out = []
    for x in items:
        if isinstance(x, dict):
            out.append(x)
        elif isinstance(x, str) and keep_strings and x.strip():
            out.append({key: x.strip()})
    return out


def as_strings(value: object) -> list[str]:
    """A list of texts from strings, or from objects by their preferred field."""
    items = value if isinstance(value, list) else [] if value is None else [value]
    texts = (x if isinstance(x, str) else next((str(x[k]) for k in TEXT_KEYS if x.get(k)), "") if isinstance(x, dict) else str(x) if x is not None else "" for x in items)
    return [t.strip() for t in texts if t.strip()]


def summary_of(answer: Column) -> Column:
    """struct(summary, key_points) of a model's answer; plain text is its own summary."""
    return F.pandas_udf(_summaries, "struct<summary string, key_points array<string>>")(answer)


def _summaries(answers: pd.Series) -> pd.DataFrame:
    rows = []
    for a in answers:
        value = parsed(a)
        if value is None:
            rows.append((a if a and a.strip() else None, []))
        else:
            s = value.get("summary")
            rows.append((s.strip() if isinstance(s, str) and s.strip() else None, as_strings(value.get("keyPoints", value.get("key_points")))))
    return pd.DataFrame(rows, columns=["summary", "key_points"])
