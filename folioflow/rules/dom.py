"""A forgiving HTML tree and CSS selectors on the standard library."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
#: opening one of these ends an open paragraph
BLOCKS = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: an element of the first kind ends an open one of the second
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_PIECE = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Every element below this one, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.texts()

    def inner(self) -> str:
        return "".join(c.outer() if isinstance(c, Node) else c if self.tag in RAW else html.escape(c, quote=False) for c in self.children)

    def outer(self) -> str:
        attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{self.inner()}</{self.tag}>"


def parse(text: str) -> Node:
    """The tree of a page; unclosed and stray tags are forgiven."""
    root = Node("#document")
    at, k = root, 0

    def put(piece: str) -> None:
        if piece:
            at.children.append(piece if at.tag in RAW else html.unescape(piece))

    while True:
        m = _PIECE.search(text, k)
        put(text[k : m.start() if m else len(text)])
        if not m:
            return root
        k = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            node = at
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                at = node.parent
            continue
        if tag in BLOCKS or tag in ENDS:
            ended = ENDS.get(tag, ()) + (("p",) if tag in BLOCKS else ())
            node, holder = at, None
            while node.parent and node.tag not in ("div", "table", "ul", "ol", "dl", "body", "section", "article", "main"):
                if node.tag in ended:
                    holder = node
                node = node.parent
            if holder is not None:
                at = holder.parent
        node = Node(tag, {a.group(1).lower(): html.unescape(next((x for x in a.groups()[1:] if x is not None), "")) for a in _ATTR.finditer(m.group(3).rstrip("/"))}, at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, k)
            node.children.append(text[k : end.start() if end else len(text)])
            k = end.end() if end else len(text)
        elif tag not in VOID and not m.group(3).rstrip().endswith("/"):
            at = node


_SIMPLE = re.compile(r"""\s*(?:(\*|[\w\-]+)|\#([\w\-]+)|\.([\w\-]+)|\[\s*([\w\-:]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]|:([\w\-]+)(?:\(((?:[^()]|\([^()]*\))*)\))?)""")


class SelectorError(ValueError):
    pass


def _compound(text: str) -> list[tuple]:
    tests, k = [], 0
    while k < len(text):
        m = _SIMPLE.match(text, k)
        if not m or m.end() == k:
            raise SelectorError(text)
        k = m.end()
        tests.append(m.groups())
    if not tests:
        raise SelectorError(text)
    return tests


def _chain(text: str) -> list[tuple[str, list[tuple]]]:
    """(combinator, tests) from left to right."""
    parts = re.findall(r"""\s*([>+~])\s*|(\s+)|((?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+)""", text.strip())
    chain, link = [], " "
    for comb, space, compound in parts:
        if compound:
            chain.append((link, _compound(compound)))
            link = " "
        elif comb:
            link = comb
    if not chain:
        raise SelectorError(text)
    return chain


def _place(node: Node) -> tuple[int, int]:
    siblings = node.parent.elements() if node.parent else [node]
    return siblings.index(node), len(siblings)


def _nth(spec: str, n: int) -> bool:
    spec = {"odd": "2n+1", "even": "2n"}.get(spec.strip(), spec.replace(" ", ""))
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", spec)
    if not m:
        return spec.lstrip("+-").isdigit() and n == int(spec)
    a = int(m.group(1) + "1") if m.group(1) in ("", "+", "-") else int(m.group(1))
    b = int(m.group(2) or 0)
    return n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0


def _fits(node: Node, tests: list[tuple]) -> bool:
    for tag, ident, cls, attr, op, v1, v2, v3, pseudo, arg in tests:
        if tag:
            ok = tag == "*" or node.tag == tag.lower()
        elif ident:
            ok = node.attrs.get("id") == ident
        elif cls:
            ok = cls in node.attrs.get("class", "").split()
        elif attr:
            have, want = node.attrs.get(attr.lower()), next((v for v in (v1, v2, v3) if v is not None), None)
            ok = have is not None and (
                not op or op == "=" and have == want or op == "~=" and want in have.split() or op == "^=" and bool(want) and have.startswith(want)
                or op == "$=" and bool(want) and have.endswith(want) or op == "*=" and bool(want) and want in have or op == "|=" and (have == want or have.startswith(f"{want}-"))
            )
        else:
            i, n = _place(node)
            if pseudo == "first-child":
                ok = i == 0
            elif pseudo == "last-child":
                ok = i == n - 1
            elif pseudo == "nth-child":
                ok = _nth(arg or "", i + 1)
            elif pseudo == "nth-last-child":
                ok = _nth(arg or "", n - i)
            elif pseudo == "not":
                ok = not any(_matches(node, _chain(p)) for p in (arg or "").split(","))
            elif pseudo == "contains":
                ok = (arg or "").strip("\"'") in "".join(node.texts())
            elif pseudo == "empty":
                ok = not node.children
            else:
                raise SelectorError(pseudo)
        if not ok:
            return False
    return True


def _matches(node: Node, chain: list[tuple[str, list[tuple]]]) -> bool:
    link, tests = chain[-1]
    if not _fits(node, tests):
        return False
    if len(chain) == 1:
        return True
    rest = chain[:-1]
    if link == ">":
        return bool(node.parent and node.parent.parent) and _matches(node.parent, rest)
    if link in "+~":
        before = node.parent.elements()[: _place(node)[0]] if node.parent else []
        return any(_matches(b, rest) for b in (before[-1:] if link == "+" else before))
    up = node.parent
    while up is not None and up.parent is not None:
        if _matches(up, rest):
            return True
        up = up.parent
    return False


def select(node: Node, selector: str) -> list[Node]:
    """Elements below a node that a selector list fits, in document order; [] for a selector that doesn't parse."""
    try:
        chains = [_chain(p) for p in re.split(r",(?![^\[(]*[\])])", selector)]
        return [n for n in node.walk() if any(_matches(n, c) for c in chains)]
    except SelectorError:
        return []
