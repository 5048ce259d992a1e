"""Text and HTML columns."""

from __future__ import annotations

from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# What counts as a line end, a tag and white space. ``(?d)`` makes
# the dot stop at "\n" only. A pair of carriage return and line feed is one line
# end. The single ones are listed in two parts because a pattern class of
# single-byte characters is a bit set, several times faster than a mixed one.
BYTE_LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85"
WIDE_LINE_ENDS = "\u2028\u2029"
TAG = r"(?d)<.*?>"
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LIST_ITEM_OPEN = r"(?i)<li(?=[\s/>])"
LIST_ITEM = r"(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>"
# What ends a piece of text and has none of its own: comments, declarations, and
# elements that are read as raw text. A tag stands for each of them afterwards.
NOT_READ = r"(?is)<!--.*?-->|<(script|style)(?=[\s/>])[^>]*>.*?</\1\s*>|<!doctype[^>]*>"
NO_TEXT = "<_>"
# What is left of such markup, or could hold items that do not count: cut-off
# comments and scripts, and templates.
SWALLOWS = r"(?is)<!|<(?:script|style|template)(?=[\s/>])"
# What an item must not hold if pattern matching is to read it exactly.
NEEDS_WALK = r"(?is)&|<(?:rt|rp)(?=[\s/>])"


def flatten_lines(text: Column) -> Column:
    """Lines joined by one space; a line end at the very end adds nothing."""
    single = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    ends_line = F.right(single, F.lit(1)).isin(*BYTE_LINE_ENDS, *WIDE_LINE_ENDS)
    inner = F.when(ends_line, F.left(single, F.length(single) - 1)).otherwise(single)
    flat = F.regexp_replace(inner, f"[{BYTE_LINE_ENDS}]", " ")
    for wide in WIDE_LINE_ENDS:
        flat = F.replace(flat, F.lit(wide), F.lit(" "))
    return flat


def strip_tags(text: Column) -> Column:
    """Text without anything between ``<`` and the next ``>`` on its line."""
    return F.regexp_replace(text, TAG, "")


def clean_description(text: Column) -> Column:
    """Line flattening first, so that a tag may span lines, then tag removal."""
    return strip_tags(flatten_lines(text))


def _read_part(html: Column) -> Column:
    """The text with markup that has no text of its own replaced by a tag."""
    return F.regexp_replace(html, NOT_READ, NO_TEXT)


def _items(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LIST_ITEM), F.lit(1))


def _item_text(item: Column) -> Column:
    """Every text piece trimmed, pieces joined with nothing between them."""
    joined = F.regexp_replace(item, rf"{SPACE}*<[^>]*>{SPACE}*", "")
    return F.regexp_replace(joined, rf"^{SPACE}+|{SPACE}+\z", "")


def is_flat_list(html: Column) -> Column:
    """True if pattern matching reads the list items exactly as a parser would:
    one match per item, and nothing hard within the items. The rest of the text
    may hold what it likes, but for what could swallow an item."""

    def flat(read: Column) -> Column:
        one_match_per_item = F.regexp_count(read, F.lit(LIST_ITEM_OPEN)) == F.regexp_count(
            read, F.lit(LIST_ITEM)
        )
        hard = F.exists(_items(read), lambda item: item.rlike(NEEDS_WALK))
        return one_match_per_item & ~read.rlike(SWALLOWS) & ~hard

    # A one-element transform evaluates the part that is read once.
    return F.get(F.transform(F.array(_read_part(html)), flat), F.lit(0))


def flat_list_bullets(html: Column) -> Column:
    """``- item`` lines of a flat list, in native expressions only."""
    return F.array_join(
        F.transform(_items(_read_part(html)), lambda item: F.concat(F.lit("- "), _item_text(item))), "\n"
    )


# A walk over the tags --------------------------------------------------------

# Elements without an end tag, and elements whose text is no text
# of an item.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
UNREAD = "script style template rt rp".split()
TOKEN = r"""(?s)</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|<[_!?/][^>]*>|[^<]+|<"""


def _entity_pattern() -> str:
    """Every named reference of the standard, the longest first, and numbers."""
    names = sorted(html5, key=len, reverse=True)
    return "&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|" + "|".join(names) + ")"


def _decoded_reference(reference: Column) -> Column:
    """The text of one reference: of a number by its code point, of a name by the
    map of the standard."""
    named = F.create_map(*[F.lit(x) for name, text in html5.items() for x in ("&" + name, text)])
    digits = F.regexp_extract(reference, r"^&#[xX]?([0-9a-fA-F]+)", 1)
    code = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    # Fixed value: numbers that stand for no character.
    known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    number = F.when(known, char).otherwise("\ufffd")
    return F.when(reference.startswith("&#"), number).otherwise(F.try_element_at(named, reference))


def decode_references(text: Column) -> Column:
    """Character references replaced by their characters. Only a text with an
    ampersand is looked into."""
    pattern = _entity_pattern()
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s){pattern}|[^&]+|&"), F.lit(0))
    parts = F.transform(
        tokens, lambda token: F.when(token.rlike("^" + pattern), _decoded_reference(token)).otherwise(token)
    )
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def walked_items(html: Column) -> Column:
    """The texts of all list items, nested ones also in those around them: one
    pass over tags and texts that keeps the open elements.

    An open element is its name and the number of its item, or -1. A text piece
    goes, trimmed, to every open item; an end tag closes down to the nearest
    element of its name, or nothing.
    """
    element = "struct<tag:string,item:int>"
    start = F.struct(
        F.array().cast("array<string>").alias("items"), F.array().cast(f"array<{element}>").alias("open")
    )

    def opened(state: Column, name: Column, closed: Column) -> Column:
        is_item = name == "li"
        items = F.when(is_item, F.array_append(state["items"], F.lit(""))).otherwise(state["items"])
        number = F.when(is_item, F.size(state["items"])).otherwise(-1)
        new = F.struct(name.alias("tag"), number.cast("int").alias("item"))
        stays = ~(closed | name.isin(*VOID))
        stack = F.when(stays, F.array_append(state["open"], new)).otherwise(state["open"])
        return F.struct(items.alias("items"), stack.alias("open"))

    def ended(state: Column, name: Column) -> Column:
        at = F.array_position(F.reverse(F.transform(state["open"], lambda e: e["tag"])), name)
        left = (F.size(state["open"]) - at).cast("int")
        stack = F.when(at > 0, F.slice(state["open"], 1, left)).otherwise(state["open"])
        return F.struct(state["items"].alias("items"), stack.alias("open"))

    def read(state: Column, text: Column) -> Column:
        piece = F.regexp_replace(decode_references(text), rf"^{SPACE}+|{SPACE}+\z", "")
        numbers = F.transform(state["open"], lambda e: e["item"])
        unread = F.exists(state["open"], lambda e: e["tag"].isin(*UNREAD))
        items = F.transform(
            state["items"],
            lambda item, i: F.when(F.array_contains(numbers, i), F.concat(item, piece)).otherwise(item),
        )
        skip = unread | (piece == "") | ~F.exists(numbers, lambda n: n >= 0)
        return F.struct(F.when(skip, state["items"]).otherwise(items).alias("items"), state["open"].alias("open"))

    def step(state: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))
        is_markup = token.rlike(r"(?s)^<[_!?/a-zA-Z].*>\z")
        return (
            F.when(~is_markup, read(state, token))
            .when(name == "", state)
            .when(token.startswith("</"), ended(state, name))
            .otherwise(opened(state, name, token.endswith("/>")))
        )

    tokens = F.regexp_extract_all(_read_part(html), F.lit(TOKEN), F.lit(0))
    return F.aggregate(tokens, start, step, lambda state: state["items"])


def walked_bullets(html: Column) -> Column:
    """Bullet lines of any list, nested or with references, without Python.

    Well-formed comments, scripts and styles are read as what they are; a text in
    which one of them is cut off is for ``list_bullets``.
    """
    return F.array_join(F.transform(walked_items(html), lambda item: F.concat(F.lit("- "), item)), "\n")


class _ListItems(HTMLParser):
    """Text of each ``<li>``, nested items included in their parents."""

    VOID = frozenset(VOID)
    UNREAD = frozenset(UNREAD)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open_tags: list[tuple[str, int | None]] = []
        self.items: list[list[str]] = []
        self.pending: list[str] = []

    def _close_piece(self):
        piece = "".join(self.pending).strip()
        self.pending.clear()
        if piece and not any(tag in self.UNREAD for tag, _ in self.open_tags):
            for _, item in self.open_tags:
                if item is not None:
                    self.items[item].append(piece)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._close_piece()

    def unknown_decl(self, data):
        self._close_piece()
        if data.startswith("CDATA["):
            self.pending.append(data.removeprefix("CDATA["))
            self._close_piece()

    def handle_starttag(self, tag, attrs):
        self._close_piece()
        item = None
        if tag == "li":
            item = len(self.items)
            self.items.append([])
        if tag not in self.VOID:
            self.open_tags.append((tag, item))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close_piece()
        depths = [i for i, (name, _) in enumerate(self.open_tags) if name == tag]
        if depths:
            del self.open_tags[depths[-1]:]


def _bullets(html: str) -> str:
    parser = _ListItems()
    parser.feed(html)
    parser.close()
    parser._close_piece()
    return "\n".join("- " + "".join(pieces) for pieces in parser.items)


@F.pandas_udf(StringType())
def _parsed_list_bullets(html: pd.Series) -> pd.Series:
    return html.map(_bullets, na_action="ignore")


def list_bullets(html: Column, *, any_html: bool = True) -> Column:
    """Bullet lines of all list items.

    Flat lists without entities are read by native expressions; the other
    texts, and only those, go through a small parser in Arrow batches, where
    flat ones pass as NULL. ``any_html=False`` is for texts known to be flat: it
    leaves the parser out, and loses nested items.
    """
    if not any_html:
        return flat_list_bullets(html)
    flat = is_flat_list(html)
    return F.coalesce(
        F.when(flat, flat_list_bullets(html)), _parsed_list_bullets(F.when(~flat, html))
    )


def bullets_if_list(text: Column, *, any_html: bool = True) -> Column:
    """Bullet lines if the text holds a plain ``<li>``, else the text itself."""
    return F.when(text.contains("<li>"), list_bullets(text, any_html=any_html)).otherwise(text)


@F.pandas_udf(ArrayType(StringType()))
def _parsed_texts(texts: pd.Series) -> pd.Series:
    def each(items):
        return [_bullets(text) if text and "<li>" in text else text for text in items]

    return texts.map(lambda items: None if items is None else each(items))


def bullets_if_lists(texts: Column, *, any_html: bool = True) -> Column:
    """``bullets_if_list`` of each element of an array of texts.

    An array goes through the parser if one of its texts needs
    it; the others pass as NULL.
    """
    native = F.transform(texts, lambda text: bullets_if_list(text, any_html=False))
    if not any_html:
        return native
    return F.coalesce(_parsed_texts(F.when(need_parser(texts), texts)), native)


def need_parser(texts: Column) -> Column:
    """True if a text of the array holds a list that patterns cannot read exactly."""
    hard = F.exists(texts, lambda text: text.contains("<li>") & ~is_flat_list(text))
    return F.coalesce(hard, F.lit(False))
