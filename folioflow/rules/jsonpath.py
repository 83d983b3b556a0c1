"""A small JSONPath: members, indexes, slices, wildcards, recursive descent and simple filters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_STEP = re.compile(r"""\.\.|\.?([\w\-一-鿿]+|\*)|\[\s*(?:'([^']*)'|"([^"]*)"|(\*)|(-?\d*):(-?\d*)(?::(-?\d+))?|(-?\d+(?:\s*,\s*-?\d+)*)|\?\(\s*@\.?([\w.\-]*)\s*(?:(==|!=|>=|<=|>|<)\s*(?:'([^']*)'|"([^"]*)"|([^\s)]+)))?\s*\))\s*\]""")


def _all(value: object) -> Iterator[object]:
    yield value
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    for c in children:
        yield from _all(c)


def _literal(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def _passes(item: object, path: str, op: str | None, want: object) -> bool:
    for key in filter(None, path.split(".")):
        if not isinstance(item, dict) or key not in item:
            return False
        item = item[key]
    if op is None:
        return True
    try:
        return {"==": lambda: item == want, "!=": lambda: item != want, ">": lambda: item > want, "<": lambda: item < want, ">=": lambda: item >= want, "<=": lambda: item <= want}[op]()
    except TypeError:
        return False


def query(value: object, path: str) -> list[object]:
    """Every value a path leads to; [] for a path that doesn't parse."""
    path = path.strip()
    if not path.startswith("$"):
        return []
    found, k, deep = [value], 1, False
    while k < len(path):
        m = _STEP.match(path, k)
        if not m:
            return []
        k = m.end()
        if m.group() == "..":
            deep = True
            continue
        if deep:
            found, deep = [y for x in found for y in _all(x)], False
        name = next((g for g in m.groups()[:3] if g is not None), None)
        out: list[object] = []
        for x in found:
            if name == "*" or m.group(4):
                out += x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
            elif name is not None:
                if isinstance(x, dict) and name in x:
                    out.append(x[name])
            elif m.group(5) is not None:
                a, b, c = (int(g) if g else None for g in m.groups()[4:7])
                out += x[a:b:c] if isinstance(x, list) and c != 0 else []
            elif m.group(8):
                for n in map(int, m.group(8).split(",")):
                    if isinstance(x, list) and -len(x) <= n < len(x):
                        out.append(x[n])
            else:
                want = next((g for g in m.groups()[10:12] if g is not None), None)
                want = want if want is not None else _literal(m.group(13)) if m.group(13) else None
                out += [y for y in (x if isinstance(x, list) else x.values() if isinstance(x, dict) else []) if _passes(y, m.group(9) or "", m.group(10), want)]
        found = out
    return found


def select(value: object, path: str) -> list[object]:
    """Values of a path, one level of lists opened."""
    return [y for x in query(value, path) for y in (x if isinstance(x, list) else [x])]


def as_text(value: object) -> str | None:
    """A value as text: lists by line without nulls, objects as compact JSON."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "\n".join(t for t in map(as_text, value) if t is not None)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else str(value)
