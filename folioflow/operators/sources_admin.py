"""Definitions of sources: filters, migration of flat ones, explore categories."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import utrim

# Rule groups of a definition with their fields; a flat definition names them with the group's prefix.
RULE_FIELDS = {
    "ruleSearch": ("bookList", "name", "author", "intro", "kind", "lastChapter", "updateTime", "bookUrl", "coverUrl", "wordCount"),
    "ruleExplore": ("bookList", "name", "author", "intro", "kind", "lastChapter", "updateTime", "bookUrl", "coverUrl", "wordCount"),
    "ruleBookInfo": ("init", "name", "author", "intro", "kind", "lastChapter", "updateTime", "coverUrl", "wordCount", "tocUrl"),
    "ruleToc": ("chapterList", "chapterName", "chapterUrl", "nextTocUrl"),
    "ruleContent": ("content", "nextContentUrl", "replaceRegex"),
}


# Names of older definitions, each with the field that has its value now.
OLDER_FIELDS = {"ruleBookUrlPattern": "bookUrlPattern", "serialNumber": "customOrder", "ruleFindUrl": "exploreUrl", "ruleSearchUrl": "searchUrl", "enable": "enabled"}
# Names of older rules by the group they belong to now; the first of two names for a field wins.
OLDER_RULES = {
    "ruleSearch": {
        "ruleSearchList": "bookList", "ruleSearchName": "name", "ruleSearchAuthor": "author", "ruleSearchIntro": "intro", "ruleSearchKind": "kind", "ruleSearchLastChapter": "lastChapter",
        "ruleSearchUpdateTime": "updateTime", "ruleSearchNoteUrl": "bookUrl", "ruleSearchBookUrl": "bookUrl", "ruleSearchCoverUrl": "coverUrl", "ruleSearchWordCount": "wordCount",
    },
    "ruleExplore": {
        "ruleFindList": "bookList", "ruleFindName": "name", "ruleFindAuthor": "author", "ruleFindIntro": "intro", "ruleFindKind": "kind", "ruleFindLastChapter": "lastChapter",
        "ruleFindUpdateTime": "updateTime", "ruleFindNoteUrl": "bookUrl", "ruleFindBookUrl": "bookUrl", "ruleFindCoverUrl": "coverUrl", "ruleFindWordCount": "wordCount",
    },
    "ruleBookInfo": {
        "ruleBookInfoInit": "init", "ruleBookName": "name", "ruleBookAuthor": "author", "ruleIntroduce": "intro", "ruleBookIntro": "intro", "ruleBookKind": "kind", "ruleBookLastChapter": "lastChapter",
        "ruleBookUpdateTime": "updateTime", "ruleCoverUrl": "coverUrl", "ruleBookCoverUrl": "coverUrl", "ruleBookWordCount": "wordCount", "ruleChapterUrl": "tocUrl", "ruleBookTocUrl": "tocUrl",
    },
    "ruleToc": {
        "ruleChapterList": "chapterList", "ruleChapterName": "chapterName", "ruleContentUrl": "chapterUrl", "ruleChapterUrl": "chapterUrl", "ruleChapterUpdateTime": "updateTime",
        "ruleChapterUrlNext": "nextTocUrl", "ruleTocUrlNext": "nextTocUrl",
    },
    "ruleContent": {"ruleBookContent": "content", "ruleBookContentReplace": "replaceRegex", "ruleContentUrlNext": "nextContentUrl", "ruleContentTitle": "title"},
}


def capable(explore_url: Column, enabled: Column, enabled_explore: Column) -> Column:
    """Whether a source can be explored."""
    return F.coalesce(enabled, F.lit(True)) & F.coalesce(enabled_explore, F.lit(False)) & (utrim(F.coalesce(explore_url, F.lit(""))) != "")


def matching(name: Column, url: Column, groups: Column, words: str, group: str = "") -> Column:
    """Sources whose name or address has the words, in a group if one is given."""
    w = words.strip().lower()
    found = F.lit(True) if not w else F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(w)) | F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit(w))
    return found & (F.lit(True) if not group else F.contains(F.coalesce(groups, F.lit("")), F.lit(group)))


def migrated(item: dict) -> dict:
    """A definition with nested rule objects, whatever form it came in: nested, nested as JSON text, or flat."""
    out = dict(item)
    for old, new in OLDER_FIELDS.items():
        if old in out and new not in out:
            out[new] = out.pop(old)
    if isinstance(out.get("bookSourceType"), str):
        out["bookSourceType"] = int(out["bookSourceType"].upper() == "AUDIO")
    agent = out.get("httpUserAgent")
    if "header" not in out and isinstance(agent, str) and agent.strip():
        out["header"] = json.dumps({"User-Agent": agent}, ensure_ascii=False)
    for group, fields in RULE_FIELDS.items():
        value = out.get(group)
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                value = None
        rules = dict(value) if isinstance(value, dict) else {}
        # a blank older value is taken off without taking the field's place
        for name, f in [*OLDER_RULES[group].items(), *((f"{group}{f[0].upper()}{f[1:]}", f) for f in fields)]:
            if f not in rules and name in out:
                old = out.pop(name)
                if old is not None and (not isinstance(old, str) or old.strip()):
                    rules[f] = old
        if rules:
            out[group] = rules
        else:
            out.pop(group, None)
    for field in ("lastUpdateTime", "customOrder", "weight"):
        if isinstance(out.get(field), str):
            out[field] = int(out[field]) if re.fullmatch(r"-?\d+", out[field].strip()) else None
    if isinstance(out.get("searchUrl"), str):
        out["searchUrl"] = flat_url(out["searchUrl"])
    return out


def flat_url(url: str) -> str:
    """Older address forms: |charset= and @body become options, {a,b} a page choice, searchKey and searchPage placeholders."""
    options: dict[str, str] = {}
    m = re.search(r"\|charset=([\w-]+)", url, re.I)
    if m:
        options["charset"], url = m.group(1), url.replace(m.group(), "")
    m = re.match(r"([^@]*)@(?!get|put|js)(.+)$", url, re.S)
    if m and "http" in m.group(1):
        url, options["method"], options["body"] = m.group(1), "POST", m.group(2)
    put = lambda t: re.sub(r"\{([^{}:]*,[^{}:]*)\}", r"<\1>", t).replace("searchKey", "{{key}}").replace("searchPage", "{{page}}")
    options = {k: put(v) if k == "body" else v for k, v in options.items()}
    return put(url) + (f",{json.dumps(options, ensure_ascii=False)}" if options else "")


def migrate(items: DataFrame, column: str = "item") -> DataFrame:
    """JSON definitions in one form; texts that aren't objects are dropped."""
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                value = json.loads(t) if t else None
            except ValueError:
                return None
            return json.dumps(migrated(value), ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None
        return texts.map(one)

    return items.withColumn(column, F.pandas_udf(run, "string")(F.col(column))).filter(F.col(column).isNotNull())


def categories(text: Column) -> Column:
    """array<struct<title, url>> of an explore setting: title::url parts, or JSON with angle brackets for braces."""
    return F.pandas_udf(_categories, "array<struct<title string, url string>>")(text)


def _categories(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: category_list(t) if t else [])


def category_list(text: str) -> list[dict]:
    t = text.strip()
    if t[:1] in "[<{":
        relaxed, quoted = [], False
        for k, c in enumerate(t):
            if c == '"' and (k == 0 or t[k - 1] != "\\"):
                quoted = not quoted
            relaxed.append({"<": "{", ">": "}"}.get(c, c) if not quoted else c)
        try:
            value = json.loads("".join(relaxed))
            return [{"title": str(x.get("title", "")), "url": x.get("url")} for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
        except ValueError:
            pass
    out = []
    for part in re.split(r"&&|\n", t):
        title, mark, url = part.strip().partition("::")
        if title:
            out.append({"title": title.strip(), "url": url.strip() if mark else None})
    return out
