"""URL functions: hosts and pages as Columns, template compilation as vectorised UDFs."""

from __future__ import annotations

import json
import re
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REQUEST = "struct<url string, http_method string, headers array<struct<name string, value string>>, body string, retry int, response_type string, charset string, web_view boolean>"
_IP = r"^\d{1,3}(\.\d{1,3}){3}$"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def root_domain(url: Column) -> Column:
    """The second last label of the host."""
    labels = F.split(host(url), r"\.")
    return F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, -1))


def cookie_domain(url: Column) -> Column:
    """The last two labels of a host, three behind a two-level suffix; addresses stay."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    deep = (n >= 3) & F.element_at(labels, -2).isin("com", "net", "org", "gov", "edu", "co") & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(h.rlike(_IP) | (n <= 2), h).when(deep, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def page_stem(url: Column) -> Column:
    """A content page's path without query, extension and page number from 2 on."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.regexp_replace(path, r"[-_](?:[2-9]|[1-9]\d+)$", "")


def follows(current: Column, following: Column) -> Column:
    """Whether a link leads to a further page of the same content."""
    base = F.regexp_replace(F.regexp_replace(current, r"[?#].*$", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return (current != following) & ((page_stem(following) == base) | (page_stem(following) == page_stem(current)))


def page_choice(template: Column, page: Column) -> Column:
    """<first,second,...> in a template gives way to the page's part, the last one beyond the end."""
    inner = F.regexp_extract(template, r"<([^<>]*,[^<>]*)>", 1)
    parts = F.transform(F.split(inner, ","), F.trim)
    chosen = F.coalesce(F.get(parts, page - 1), F.element_at(parts, -1))
    return F.when(inner != "", F.concat(F.regexp_extract(template, r"^([^<]*)<", 1), chosen, F.regexp_extract(template, r">([^>]*)$", 1))).otherwise(template)


def resolve(base: str | None, link: str | None) -> str:
    """An absolute URL of a link found on a page."""
    link = (link or "").strip()
    link = re.sub(r"##\$##.*$|,\{\s*['\"]webView.*$", "", link)
    if not link:
        return base or ""
    if link.startswith("data:"):
        return link
    if link.lower().startswith("javascript"):
        return ""
    if link.startswith("//"):
        return "https:" + link
    return urljoin(re.sub(r",\{.*$", "", base or ""), link)


def resolve_url(base: Column, link: Column) -> Column:
    return F.pandas_udf(_resolve_all, "string")(base, link)


def _resolve_all(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, x) for b, x in zip(base, link)])


def relaxed_json(text: str) -> dict:
    """An options object, with raw control characters in strings or single quotes forgiven."""
    for attempt in (text, re.sub(r"[\x00-\x1f]", lambda m: json.dumps(m.group())[1:-1], text), text.replace("'", '"')):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        return value if isinstance(value, dict) else {}
    return {}


def parse_headers(value: object) -> list[tuple[str, str]]:
    """Headers of an object, a JSON text, or lines of name: value."""
    if isinstance(value, dict):
        return [(str(k), str(v)) for k, v in value.items()]
    text = str(value or "").strip()
    if text.startswith("{"):
        return parse_headers(relaxed_json(text))
    pairs = [x.split(":", 1) for x in re.split(r"[\n;]", text) if ":" in x]
    return [(k.strip(), v.strip()) for k, v in pairs]


def percent(text: str, charset: str) -> str:
    """Percent encoding in a charset; a text already encoded stays as it is in UTF-8."""
    if charset.lower() in ("utf-8", "utf8", "") and re.search(r"%[0-9A-Fa-f]{2}", text):
        return text
    return quote(text.encode(charset or "utf-8", "replace"), safe="-_.!~*'()")


def js_escape(text: str) -> str:
    """The escape() of scripts."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "@*_+-./") else f"%{ord(c):02X}" if ord(c) < 256 else f"%u{ord(c):04X}" for c in text)


def analyze(template: str | None, key: str | None, page: int | None, base: str | None, header: str | None) -> dict:
    """A request from a template: placeholders, page choice, options after a comma, encoded query and body."""
    text, key, page = (template or "").strip(), key or "", int(page or 1)
    options: dict = {}
    m = re.search(r"\s*,\s*(\{.*\})\s*$", text, re.S)
    if m:
        options, text = relaxed_json(m.group(1)), text[: m.start()]
    charset = str(options.get("charset") or "utf-8")
    if charset.lower() != "escape":
        try:
            "".encode(charset)
        except LookupError:
            charset = "utf-8"

    def put(value: str, encode: bool) -> str:
        shown = (js_escape(key) if charset.lower() == "escape" else percent(key, charset)) if encode else key
        value = re.sub(r"\{\{\s*(?:key|searchKey)\s*\}\}|\{(?:key|searchKey)\}|searchKey", lambda _: shown, value)
        value = re.sub(r"\{\{\s*(?:page|searchPage)\s*([+\-]\s*\d+)?\s*\}\}", lambda x: str(page + int((x.group(1) or "0").replace(" ", ""))), value)
        return re.sub(r"\{(?:page|searchPage)\}|searchPage", str(page), value)

    def choose(m: re.Match) -> str:
        parts = [p.strip() for p in m.group(1).split(",")]
        return parts[page - 1] if 0 < page <= len(parts) else parts[-1]

    text = re.sub(r"<([^<>]*,[^<>]*)>", choose, text)
    url = resolve(base, put(text, True))
    body = options.get("body")
    if body is not None:
        body = put(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), not str(body).lstrip().startswith(("{", "[")))
    headers: dict[str, tuple[str, str]] = {}
    for name, value in [*parse_headers(header), *parse_headers(options.get("headers"))]:
        headers[name.lower()] = (name, value)
    return {
        "url": url, "http_method": str(options.get("method") or "GET").upper(), "headers": [{"name": n, "value": v} for n, v in headers.values()], "body": body,
        "retry": int(options.get("retry") or 0), "response_type": options.get("type"), "charset": options.get("charset"), "web_view": bool(options.get("webView")),
    }


def analyze_url(template: Column, key: Column, page: Column, base: Column, header: Column) -> Column:
    """A request struct compiled from a template column."""
    return F.pandas_udf(_analyze_all, REQUEST)(template, key, page, base, header)


def _analyze_all(template: pd.Series, key: pd.Series, page: pd.Series, base: pd.Series, header: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([analyze(*x) for x in zip(template, key, page, base, header)], columns=["url", "http_method", "headers", "body", "retry", "response_type", "charset", "web_view"])


def decode_body(data: bytes | None, charset: str | None, content_type: str | None) -> str | None:
    """Bytes to text: the given charset, else the header's, else the page's own, else UTF-8."""
    if data is None:
        return None
    names = [charset, *re.findall(r"charset\s*=\s*[\"']?([\w\-]+)", content_type or "", re.I), *[x.decode("ascii", "ignore") for x in re.findall(rb"charset\s*=\s*[\"']?([\w\-]+)", data[:4096], re.I)]]
    for name in names:
        name = (name or "").strip().lower()
        name = "gb18030" if name in ("gb2312", "gbk") else name
        try:
            if name:
                return data.decode(name, "replace")
        except LookupError:
            continue
    return data.decode("utf-8", "replace")


def decode_bytes(data: Column, charset: Column, content_type: Column) -> Column:
    return F.pandas_udf(_decode_all, "string")(data, charset, content_type)


def _decode_all(data: pd.Series, charset: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_body(*x) for x in zip(data, charset, content_type)])




# Types of content by the ending of an address.
CONTENT_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml"}


def ending(url: Column) -> Column:
    """What stands behind the last point of an address without query and fragment: one to eight characters, else null."""
    found = F.regexp_extract(url, r"^[^?#]*\.([^?#.]{1,8})(?:[?#].*)?$", 1)
    return F.when(found != "", F.lower(found))


def content_type(url: Column) -> Column:
    """The type of content an address names."""
    kind = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kind, F.coalesce(ending(url), F.lit(""))), F.lit("application/octet-stream"))
