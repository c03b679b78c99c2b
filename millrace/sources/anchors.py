"""Anchors of a message's HTML with what surrounds them, and places of anchor texts in plain text."""

from __future__ import annotations

from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lines import cleaned_field
from .dom import Node, block_text, elements, joined, page_text, tree, tree_and_anchors

# Tags that may hold one posting, the longest text of such a holder, and the tags and number of following lines.
HOLDERS = {"table", "tr", "td", "li", "div", "p", "section", "article", "ul", "ol"}
HOLDER_CHARS = 900
LINE_TAGS = {"p", "div", "span", "td", "li"}
LINES = 10

PAGE = "struct<text: string, found: array<struct<pos: int, url: string, anchor_text: string, holder: string, above: string, below: string, first: boolean>>>"
_ANCHORS = pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("url", "anchor_text", "holder", "above", "below")), ("first", pa.bool_())]))
_PAGE = pa.struct([("text", pa.string()), ("found", _ANCHORS)])


def _holder(anchor: Node, seen: dict[int, str]) -> str | None:
    """Text of the nearest ancestor with two lines at least and no more characters than a card has."""
    node = anchor.parent
    while node is not None and node.tag not in ("", "html", "body"):
        if node.tag in HOLDERS:
            text = seen.get(id(node))
            if text is None:
                text = seen[id(node)] = block_text(node)
            lines = text.split("\n")
            size = sum(map(len, lines))
            if size > HOLDER_CHARS:
                return None
            if len(lines) >= 2 and size:
                return text
        node = node.parent
    return None


def _above(anchor: Node) -> str | None:
    for x in reversed(anchor.parent.kids[: anchor.place]):
        if isinstance(x, Node) and x.tag == "p" and len(text := joined(x)) > 2:
            return text
    return None


def _below(anchor: Node) -> str:
    lines: list[str] = []
    for x in anchor.parent.kids[anchor.place + 1 :]:
        if len(lines) == LINES or (isinstance(x, Node) and x.tag == "a"):
            break
        text = x.strip() if isinstance(x, str) else joined(x) if x.tag in LINE_TAGS else ""
        if len(text) > (2 if isinstance(x, str) else 0):
            lines.append(text)
    return "\n".join(lines)


def _page(html: str, plain: str | None) -> dict:
    out, holders, urls = [], {}, set()
    root, found = tree_and_anchors(html)
    for a in found:
        url = a.attrs.get("href", "").strip()
        if url.startswith(("http://", "https://")):
            out.append({"pos": len(out), "url": url, "anchor_text": joined(a), "holder": _holder(a, holders), "above": _above(a), "below": _below(a), "first": url not in urls})
            urls.add(url)
    return {"text": plain or page_text(root), "found": out}


def page(html: Column, plain: Column) -> Column:
    """struct(text, found) of a message, whose page is read once: its plain text, or where that is null or empty that of the page, and all anchors with absolute URLs in order.

    Of an anchor, holder is the text of the nearest card-like ancestor, above the paragraph
    before, below the lines after; first says that no anchor before it has its URL.
    """

    @F.arrow_udf(PAGE)
    def read(pages: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_page(h, t) if h else {"text": t or "", "found": []} for h, t in zip(pages.to_pylist(), texts.to_pylist(), strict=True)], _PAGE)

    return read(html, plain)


def _places(text: str, probes: list[str | None]) -> list[int]:
    used: set[int] = set()
    out, cursor = [], 0
    for probe in probes:
        probe = (probe or "").strip()
        at = text.find(probe, cursor) if len(probe) >= 4 else -1
        if len(probe) >= 4 and (at < 0 or at in used):
            at = text.find(probe)
            while at in used:
                at = text.find(probe, at + len(probe))
        if at >= 0:
            used.add(at)
            cursor = at + len(probe)
        out.append(at)
    return out


def anchor_places(text: Column, probes: Column) -> Column:
    """For each anchor text of four characters or more, where it stands: after the one before, else its first free occurrence, else -1."""

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([_places(t or "", p or []) for t, p in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return find(text, probes)


def unescaped(text: Column) -> Column:
    """HTML entities as characters."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unescape(t) for t in column.to_pylist()], pa.string())

    return decode(text)


def stored_field(text: Column) -> Column:
    """A field as it is stored: entities decoded, then cleaned; null without visible text."""
    return cleaned_field(unescaped(text))


def page_words(html: Column) -> Column:
    """Text of a detail page's body, its strings joined by one space; null html gives an empty text."""

    @F.arrow_udf("string")
    def read(column: pa.Array) -> pa.Array:
        return pa.array([_body_words(h) if h else "" for h in column.to_pylist()], pa.string())

    return read(html)


def _body_words(html: str) -> str:
    root = tree(html)
    return joined(next((x for x in elements(root) if x.tag == "body"), root), " ")
