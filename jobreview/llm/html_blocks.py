"""Blocks of a web page in page order: their text and the path of tags above them.

A small reader in the manner of browsers: elements whose end tag is left out are
closed by what follows, end tags without a start are ignored, scripts and styles
are skipped as raw text, and a page may be cut off anywhere.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Their content is not shown as text of the page.
UNSHOWN = frozenset("head template svg math select datalist canvas audio video object".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCK = ENDS_P | frozenset("html body head li dt dd tr td th thead tbody tfoot caption legend option optgroup template".split())
# What a start tag closes, and the element beyond which it closes nothing.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"""
    r"""(?:(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^>]*(?:>|\Z))""",
    re.S,
)
_ATTR = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME_PART = re.compile(r"[a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


class Block(NamedTuple):
    path: tuple[tuple[str, ...], ...]  # each element: its name, then words of class, id and role
    text: str
    linked: float  # share of its characters inside links


def _element(name: str, attrs: str | None) -> tuple[str, ...]:
    if not attrs or "=" not in attrs:
        return (name,)
    words = [w for value in _ATTR.findall(attrs) for w in _NAME_PART.findall(value.lower())]
    return (name, *dict.fromkeys(words))


def blocks(html: str | None) -> list[Block]:
    """The blocks with text, white space inside them drawn together."""
    html = html or ""
    found: list[Block] = []
    stack: list[tuple[str, ...]] = []
    held: list[str] = []
    path: tuple = ()
    in_link = chars = 0

    def flush():
        nonlocal in_link, chars
        if held:
            text = " ".join("".join(held).split())
            if text and not any(element[0] in UNSHOWN for element in path):
                found.append(Block(path, text, in_link / max(1, chars)))
            held.clear()
        in_link = chars = 0

    def close_to(names, barrier=frozenset()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    def read(text):
        nonlocal path, in_link, chars
        text = unescape(text)
        size = len(text.strip())
        if size:
            if not chars:
                path = tuple(stack)
            chars += size
            if any(element[0] == "a" for element in stack):
                in_link += size
        if size or held:
            held.append(text)

    at = 0
    while at < len(html):
        tag = _TAG.search(html, at)
        if tag is None:
            read(html[at:])
            break
        if tag.start() > at:
            read(html[at : tag.start()])
        at = tag.end()
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        if name == "br":
            read(" ")
            continue
        if name in BLOCK:
            flush()
        if tag["end"]:
            if name in BLOCK or name != "p":
                close_to({name})
            continue
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in ENDS_P:
            close_to({"p"}, {"button", "td", "th", "table", "caption", "template", "object"})
        if name in CLOSES:
            close_to(*CLOSES[name])
        if name not in VOID and not (tag["attrs"] or "").endswith("/"):
            stack.append(_element(name, tag["attrs"]))
    flush()
    return found
