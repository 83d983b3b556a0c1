"""The extraction-rule language: one document in, rows of fields out.

A rule is `[mode] chain [@extractor] [##pattern##replacement...]`. Modes are CSS
chains, JSONPath, XPath and regular expressions; && joins lists, || takes the
first that isn't empty, %% interleaves; @put/@get carry variables; {{...}} and
{$...} are filled in. Rules are parsed once at plan time, documents are evaluated
in Arrow batches; a regular-expression list rule becomes plain Columns.

Scripts in rules cannot run here: a registry maps a script's text to a Python
callable, and a rule with an unknown script raises UnknownScript.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as xml
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import java_replacement
from folioflow.functions.urls import resolve
from folioflow.rules import dom, jsonpath

Script = Callable[[str, dict[str, str]], str]


class UnknownScript(ValueError):
    """A rule needs a script that isn't registered."""


# ---- plan-time parsing --------------------------------------------------------------------


def split_top(rule: str, marks: tuple[str, ...]) -> tuple[list[str], str | None]:
    """Parts of a rule at the first-seen mark, outside brackets and quotes (U4)."""
    parts, depth, quote, last, used, k = [], 0, "", 0, None, 0
    while k < len(rule):
        c = rule[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif depth == 0:
            mark = next((m for m in marks if rule.startswith(m, k) and used in (None, m)), None)
            if mark:
                used = mark
                parts.append(rule[last:k])
                k += len(mark)
                last = k
                continue
        k += 1
    parts.append(rule[last:])
    return [p.strip() for p in parts], used


def mode_of(rule: str, body: str | None = None) -> str:
    """css, json, xpath, regex or script; a plain rule on a JSON body is a JSON path."""
    r = rule.strip()
    for prefix, mode in (("@css:", "css"), ("@xpath:", "xpath"), ("@json:", "json"), ("@regex:", "regex"), ("@js:", "script"), ("js:", "script"), ("<js>", "script")):
        if r.lower().startswith(prefix):
            return mode
    if r.startswith(("/", "./")):
        return "xpath"
    if r.startswith(("$.", "$[")):
        return "json"
    if r.startswith(":"):
        return "regex"
    if body is not None and body.lstrip()[:1] in ("{", "["):
        try:
            json.loads(body)
            return "json"
        except ValueError:
            pass
    return "css"


def strip_mode(rule: str) -> str:
    return re.sub(r"^\s*(?:@css:|@xpath:|@json:|@regex:|@js:|js:|:)", "", rule, flags=re.I).strip()


def css_of(step: str) -> str:
    """A step of a chain as a CSS selector (R4): class.a b, id.x, tag.x, and bare names of several words as classes."""
    s = step.strip()
    for prefix, lead in (("class.", "."), ("id.", "#"), ("tag.", "")):
        if s.startswith(prefix):
            rest = s[len(prefix) :]
            return "." + ".".join(rest.split()) if lead == "." else lead + rest.strip()
    words = s.split()
    return "." + ".".join(words) if len(words) > 1 and s[:1].isalpha() else s


def parse_step(step: str) -> tuple[str, str, list, bool]:
    """(axis, selector, index items, excluded) of a step (R5). axis: css, children or text."""
    s, items, exclude = step.strip(), None, False
    m = re.fullmatch(r"(.*)\[\s*(!?)\s*([\d:,\-\s]*)\]", s, re.S)
    if m:
        parsed = [_index(p) for p in m.group(3).split(",") if p.strip()]
        if None not in parsed:
            s, exclude, items = m.group(1).strip(), bool(m.group(2)), parsed
    if items is None:
        m = re.fullmatch(r"(.*)([!.])\s*(-?\d+(?:\s*:\s*-?\d+)*)", s, re.S)
        if m:
            s, exclude, items = m.group(1).strip(), m.group(2) == "!", [int(x) for x in m.group(3).split(":")]
    if s in ("", "children"):
        return "children", "", items, exclude
    if s.startswith("text."):
        return "text", s[5:].strip(), items, exclude
    return "css", css_of(s), items, exclude


def _index(part: str) -> int | tuple | None:
    try:
        if ":" not in part:
            return int(part)
        bounds = [int(x) if x.strip() else None for x in part.split(":")]
        return tuple((bounds + [None, None])[:3]) if len(bounds) <= 3 else None
    except ValueError:
        return None


def pick(n: int, items: list, exclude: bool) -> list[int]:
    """Positions that index items choose of n, in their order, each once."""
    out: dict[int, None] = {}
    for item in items:
        if isinstance(item, int):
            k = item + n if item < 0 else item
            if 0 <= k < n:
                out[k] = None
            continue
        a, b, step = item
        a, b = 0 if a is None else a + n if a < 0 else a, n - 1 if b is None else b + n if b < 0 else b
        if n == 0 or (a < 0 and b < 0) or (a >= n and b >= n):
            continue
        a, b = min(max(a, 0), n - 1), min(max(b, 0), n - 1)
        step = 1 if step is None else step
        step = step if step > 0 else max(step + n, 1) if -step < n else 1
        for k in range(a, b + 1, step) if a <= b else range(a, b - 1, -step):
            out[k] = None
    return [k for k in range(n) if k not in out] if exclude else list(out)


# ---- evaluation on one document -----------------------------------------------------------


def _step(nodes: list[dom.Node], step: str) -> list[dom.Node]:
    axis, selector, items, exclude = parse_step(step)
    out: list[dom.Node] = []
    for node in nodes:
        if axis == "children":
            got = node.elements() if node.parent or node.tag != "#document" else []
        elif axis == "text":
            got = [n for n in ([node] if node.parent else []) + list(node.walk()) if selector in _own_text(n)]
        else:
            got = dom.select(node, selector)
        out += got if items is None else [got[k] for k in pick(len(got), items, exclude)]
    return out


def elements(root: dom.Node, rule: str) -> list[dom.Node]:
    """Elements of a list rule (R7); combinators count in the first step only."""
    steps, _ = split_top(rule.split("@@")[0].strip(), ("@",))
    parts, mark = split_top(steps[0], ("&&", "||", "%%"))
    if mark:
        return combine([_step([root], p) for p in parts], mark)
    nodes = [root]
    for s in steps:
        nodes = _step(nodes, s)
    return nodes


def combine(lists: list[list], mark: str) -> list:
    """Union, first non-empty or interleave of lists (U1-U3), from left to right."""
    out = lists[0]
    for more in lists[1:]:
        if mark == "&&":
            out = out + more
        elif mark == "||":
            out = out or more
        else:
            longest = max(len(out), len(more))
            out = [x for k in range(longest) for x in (out[k : k + 1] + more[k : k + 1])]
    return out


def _own_text(node: dom.Node) -> str:
    return "".join(c.strip() for c in node.children if isinstance(c, str))


def extract(node: dom.Node, how: str) -> str | None:
    """What an extractor takes from an element (R11); null where nothing is left."""
    h = how.strip()
    if h == "text":
        value = " ".join(t for t in (x.strip() for x in node.texts()) if t)
    elif h == "textNodes":
        value = "\n".join(t for t in (x.strip() for x in node.texts()) if t)
    elif h == "ownText":
        value = _own_text(node)
    elif h == "html":
        value = node.inner()
    elif h == "all":
        value = node.outer()
    else:
        m = re.fullmatch(r"attr\[\s*([\w\-:]+)\s*\]|attr\.([\w\-:]+)|([\w\-:]+)", h)
        value = node.attrs.get(next(g for g in m.groups() if g).lower(), "") if m else ""
    return value.strip() or None


EXTRACTORS = frozenset(("text", "textNodes", "ownText", "html", "all"))


def _chain_values(node: dom.Node, rule: str) -> list[str]:
    steps, _ = split_top(rule, ("@",))
    last = steps[-1]
    is_extractor = last in EXTRACTORS or re.fullmatch(r"attr\[[^\]]+\]|href|src|data-[\w\-]+", last) or (len(steps) > 1 and re.fullmatch(r"title|alt|content|value|id|class", last))
    how = last if is_extractor else "text"
    nodes = [node]
    for s in steps[:-1] if is_extractor else steps:
        if s:
            nodes = _step(nodes, s)
    return [v for v in (extract(n, how) for n in nodes) if v]


def css_values(node: dom.Node, rule: str) -> list[str]:
    """All values of a field rule on an element, combinators included."""
    parts, mark = split_top(rule, ("&&", "||", "%%"))
    return combine([_chain_values(node, p) for p in parts], mark) if mark else _chain_values(node, rule)


def xpath_values(text: str, rule: str) -> list[str]:
    """Values of an XPath on well-formed markup; [] for markup or a path that doesn't parse."""
    try:
        root = xml.fromstring(text)
    except xml.ParseError:
        return []
    m = re.fullmatch(r"(.*?)(?:/(@[\w\-:]+|text\(\)))?", strip_mode(rule), re.S)
    path, last = m.group(1), m.group(2)
    path = "." + path if path.startswith("//") else "./" + path.lstrip("/").partition("/")[2] if path.startswith("/") else path or "."
    try:
        nodes = root.findall(path)
    except SyntaxError:
        return []
    if last and last.startswith("@"):
        return [n.attrib[last[1:]] for n in nodes if last[1:] in n.attrib]
    return [t for t in ("".join(n.itertext()).strip() if not last else (n.text or "").strip() for n in nodes) if t]


class Context:
    """Variables of one document; they live from field to field and row to row."""

    def __init__(self, base: str, scripts: dict[str, Script] | None = None, **values: str):
        self.base, self.scripts, self.values = base, scripts or {}, dict(values)


def field(rule: str | None, node: object, ctx: Context) -> str | None:
    """A field rule on a node: variables, templates, selection, scripts, replacements; blank is null."""
    rule = (rule or "").strip()
    if not rule:
        return None
    m = re.search(r"@put:\{(.*)\}", rule, re.S)
    if m:
        for pair in m.group(1).split(","):
            name, _, inner = pair.partition(":")
            ctx.values[name.strip().strip("\"'")] = field(inner.strip().strip("\"'"), node, ctx) or ""
        rest = rule.replace(m.group(), "").strip()
        return field(rest, node, ctx) if rest else ""
    filled = re.sub(r"@get:\{([^}]*)\}", lambda x: ctx.values.get(x.group(1).strip(), ""), rule)
    if filled != rule and not re.search(r"[@.#\[]", filled):
        return filled or None
    filled = re.sub(r"\{\{(.*?)\}\}", lambda x: _expression(x.group(1), node, ctx), filled, flags=re.S)
    filled = re.sub(r"\{(\$\.[^{}]+)\}", lambda x: _expression(x.group(1), node, ctx), filled)
    literal = filled != rule
    body, *posts = filled.split("##")
    script = None
    m = re.search(r"<js>(.*?)</js>|@js:(.*)$", body, re.S)
    if m:
        script, body = (m.group(1) or m.group(2)).strip(), body[: m.start()].strip()
    value = _selected(body, node, literal)
    if not value and literal:
        value = body
    if script is not None:
        if script not in ctx.scripts:
            raise UnknownScript(script)
        value = ctx.scripts[script](value or "", ctx.values)
    return (replaced(value or "", posts) or "").strip() or None


def _expression(text: str, node: object, ctx: Context) -> str:
    text = text.strip()
    m = re.fullmatch(r"@get:\{?([^}]*)\}?", text)
    if m:
        return ctx.values.get(m.group(1).strip(), "")
    if text.startswith("$"):
        return "\n".join(filter(None, map(jsonpath.as_text, jsonpath.select(node, text)))) if not isinstance(node, (dom.Node, str)) else ""
    if text in ctx.values:
        return ctx.values[text]
    if text in ctx.scripts:
        return ctx.scripts[text]("", ctx.values)
    return (_selected(text, node, False) or "") if re.fullmatch(r"[\w.@\-\[\]#]+", text) else ""


def _selected(rule: str, node: object, literal: bool) -> str | None:
    if isinstance(node, dom.Node):
        if literal and re.match(r"https?://|/", rule):
            return None
        if mode_of(rule) in ("xpath", "json"):
            return None
        return next(iter(css_values(node, strip_mode(rule))), None) if rule else extract(node, "text")
    if isinstance(node, str):
        return next(iter(xpath_values(node, rule)), None)
    rule = strip_mode(rule)
    if re.search(r"[/?&=,]", rule) and not rule.startswith("$[?"):
        return rule  # a JSON rule with marks of an address is one
    if rule.startswith("$"):
        return "\n".join(filter(None, map(jsonpath.as_text, jsonpath.select(node, rule)))) or None
    return jsonpath.as_text(node.get(rule)) if isinstance(node, dict) else None


def replaced(value: str, posts: list[str]) -> str:
    """Pairs of pattern and replacement; a last ### replaces the first match only; a lone pattern does nothing."""
    if len(posts) < 2:
        return value
    first_only = posts[-1].startswith("#") or (len(posts) % 2 == 1 and posts[-1] == "")
    pairs = [(posts[k], posts[k + 1].rstrip("#")) for k in range(0, len(posts) - 1, 2)]
    for n, (pattern, put) in enumerate(pairs):
        try:
            groups = re.compile(pattern).groups
        except re.error:
            continue
        repl = re.sub(r"\\\$", "$", re.sub(r"(?<!\\)\$(\d+)", r"\\\1", java_replacement(put, groups)))
        value = re.sub(pattern, repl, value, count=1 if first_only and n == len(pairs) - 1 else 0)
    return value


def rows(body: str, rules: dict[str, str], base: str = "", scripts: dict[str, Script] | None = None) -> list[dict[str, str | None]]:
    """Rows of a list rule `list` and field rules (P1, R26); `-` before the list rule turns the order round."""
    listing = (rules.get("list") or "").strip()
    back = listing.startswith("-")
    listing = listing.lstrip("-+").strip()
    ctx, mode = Context(base, scripts), mode_of(listing, body)
    if mode == "json":
        try:
            found: list = jsonpath.select(json.loads(body), strip_mode(listing))
        except ValueError:
            found = []
    elif mode == "xpath":
        found = _xml_nodes(body, listing)
    elif mode == "regex":
        return _regex_rows(body, strip_mode(listing), rules, base)
    else:
        found = elements(dom.parse(body), strip_mode(listing))
    out = [{name: _finished(name, field(rule, node, ctx), base) for name, rule in rules.items() if name != "list"} for node in found]
    return out[::-1] if back else out


def search_rows(body: str, rules: dict[str, str], detail: dict[str, str] | None = None, base: str = "", pattern: str | None = None, scripts: dict[str, Script] | None = None) -> list[dict[str, str | None]]:
    """Rows of a search page; the page itself as a detail page where the list has none and no pattern of addresses speaks against it.

    The fallback needs a name; its address is the page's own.
    """
    found = rows(body, rules, base, scripts)
    if found or not detail or (pattern or "").strip():
        return found
    one = info(body, detail, base, scripts)
    if not (one.get("name") or "").strip():
        return []
    return [{**{n: None for n in rules if n != "list"}, **{n: v for n, v in one.items() if n in rules}, **({"book_url": base} if "book_url" in rules else {})}]


def explore_rows(body: str, explore: dict[str, str] | None, search: dict[str, str], base: str = "", scripts: dict[str, Script] | None = None) -> list[dict[str, str | None]]:
    """Rows of an explore page by its own rules, by those of search where its list rule is blank; never a detail page."""
    own = explore if explore and (explore.get("list") or "").strip() else search
    return rows(body, own, base, scripts)


def _finished(name: str, value: str | None, base: str) -> str | None:
    return resolve(base, value) if value is not None and name.endswith("url") else value


def _xml_nodes(body: str, rule: str) -> list[str]:
    try:
        root = xml.fromstring(body)
        path = strip_mode(rule)
        return [xml.tostring(n, encoding="unicode") for n in root.findall("." + path if path.startswith("//") else "./" + path.lstrip("/").partition("/")[2])]
    except (xml.ParseError, SyntaxError):
        return []


def _regex_rows(body: str, pattern: str, rules: dict[str, str], base: str) -> list[dict[str, str | None]]:
    try:
        found = re.finditer(pattern, body)
    except re.error:
        return []
    put = lambda rule, m: re.sub(r"\$([1-9]\d?)", lambda g: (m.group(int(g.group(1))) or "") if int(g.group(1)) <= (m.re.groups or 0) else g.group(), rule or "")
    out = []
    for m in found:
        row = {n: _finished(n, put(r, m).strip() or None, base) for n, r in rules.items() if n != "list"}
        if row.get("name", "x"):
            out.append(row)
    return out


def _scope(body: str, init: str | None, ctx: Context) -> object:
    """The node fields start from: the document, or what `init` narrows it to."""
    mode = mode_of(init or "", body)
    if mode == "json":
        try:
            value = json.loads(body)
        except ValueError:
            return {}
        found = jsonpath.select(value, strip_mode(init)) if init and strip_mode(init).startswith("$") else [value]
        return found[0] if found else {}
    root = dom.parse(body)
    if not init:
        return root
    if "@put:" in init:
        field(init, root, ctx)
        return root
    return next(iter(elements(root, strip_mode(init))), root)


def info(body: str, rules: dict[str, str], base: str = "", scripts: dict[str, Script] | None = None) -> dict[str, str | None]:
    """One row of fields of a detail page, `init` first (R28); toc_url falls back to the page."""
    ctx = Context(base, scripts)
    node = _scope(body, rules.get("init"), ctx)
    out = {n: _finished(n, field(r, node, ctx), base) for n, r in rules.items() if n != "init"}
    if "toc_url" in rules:
        out["toc_url"] = out["toc_url"] or base
    return out


def toc(body: str, rules: dict[str, str], base: str = "", scripts: dict[str, Script] | None = None) -> list[dict]:
    """Chapters of a contents page (R29): titles, absolute addresses, flags, numbered from 0.

    Of equal addresses markup keeps the last, other forms the first; a volume heading
    without an address is named by its title and number.
    """
    listing = (rules.get("list") or "").strip()
    found = rows(body, {k: v for k, v in rules.items()}, base, scripts)
    keep_last = mode_of(listing.lstrip("-+"), body) in ("css", "xpath")
    out: dict[str, dict] = {}
    for n, r in enumerate(found):
        volume = truth(r.get("is_volume"))
        title = r.get("name") or ""
        url = r.get("url") or (f"{title}{n}" if volume else base)
        if url in out and not keep_last:
            continue
        out.pop(url, None)
        out[url] = {"title": title, "url": url, "is_volume": volume, "is_vip": truth(r.get("is_vip")), "is_pay": truth(r.get("is_pay")), "tag": r.get("update_time")}
    return [{"index": n, **c} for n, c in enumerate(out.values())]


def truth(value: str | None) -> bool:
    return (value or "").strip().lower() not in ("", "0", "false", "null", "none", "no", "off")


def content(body: str, rules: dict[str, str], base: str = "", scripts: dict[str, Script] | None = None) -> tuple[str, str | None]:
    """(text, next page's address) of a content page: all values by line, then replacements."""
    rule, ctx = (rules.get("content") or "").strip(), Context(base, scripts)
    node = _scope(body, None, ctx)
    if isinstance(node, dom.Node):
        plain, *posts = rule.split("##")
        text = "\n".join(css_values(node, strip_mode(plain))) if plain.strip() else extract(node, "text") or ""
        text = replaced(text, posts)
    else:
        text = field(rule, node, ctx) or ""
    text = replaced(text, (rules.get("replace") or "").lstrip("#").split("##")) if rules.get("replace") else text
    following = field(rules.get("next_url"), node, ctx) if rules.get("next_url") else None
    return text.strip(), resolve(base, following) if following else None


# ---- DataFrame forms ----------------------------------------------------------------------


def extract_rows(docs: DataFrame, rules: dict[str, str], key: str, body: str, base: Column | None = None, scripts: dict[str, Script] | None = None, detail: dict[str, str] | None = None) -> DataFrame:
    """(key, pos, field...) of every row that a rule set finds in every document; detail: rules of the page itself where it has no rows."""
    names = [n for n in rules if n != "list"]
    kind = dict(docs.dtypes)[key]
    d = docs.select(F.col(key), F.col(body).cast("string").alias("body"), (base if base is not None else F.lit("")).cast("string").alias("base")).filter("body is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, n, *(r[c] for c in names)) for k, text, at in zip(b[key], b["body"], b["base"]) for n, r in enumerate(search_rows(text, rules, detail, at or "", None, scripts))]
            yield pd.DataFrame(out, columns=[key, "pos", *names])

    return d.mapInPandas(run, ", ".join([f"`{key}` {kind}", "pos int", *(f"`{n}` string" for n in names)]))


def regex_list(docs: DataFrame, pattern: str, key: str, body: str, fields: dict[str, str]) -> DataFrame:
    """A regular-expression list rule whose fields are single groups, as plain Columns."""
    groups = sorted({int(r[1:]) for r in fields.values()})
    lists = [F.regexp_extract_all(F.col(body), F.lit(pattern), g).alias(f"g{g}") for g in groups]
    z = docs.select(key, F.posexplode(F.arrays_zip(*lists)).alias("pos", "m"))
    return z.select(key, "pos", *[F.col("m")[f"g{r[1:]}"].alias(n) for n, r in fields.items()])


def extract_toc(docs: DataFrame, rules: dict[str, str], key: str, body: str, base: Column, scripts: dict[str, Script] | None = None) -> DataFrame:
    """(key, index, title, url, is_volume, is_vip, is_pay, tag) of every chapter of every contents page."""
    names = ["index", "title", "url", "is_volume", "is_vip", "is_pay", "tag"]
    d = docs.select(F.col(key), F.col(body).cast("string").alias("body"), base.cast("string").alias("base")).filter("body is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *(c[n] for n in names)) for k, text, at in zip(b[key], b["body"], b["base"]) for c in toc(text, rules, at or "", scripts)]
            yield pd.DataFrame(out, columns=[key, *names])

    return d.mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, index int, title string, url string, is_volume boolean, is_vip boolean, is_pay boolean, tag string")


def extract_content(docs: DataFrame, rules: dict[str, str], key: str, body: str, base: Column, scripts: dict[str, Script] | None = None) -> DataFrame:
    """(key, text, next_url) of every content page."""
    d = docs.select(F.col(key), F.col(body).cast("string").alias("body"), base.cast("string").alias("base")).filter("body is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *content(text, rules, at or "", scripts)) for k, text, at in zip(b[key], b["body"], b["base"])], columns=[key, "text", "next_url"])

    return d.mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, text string, next_url string")
