"""Rendering and link extraction of HTML columns, in Arrow batches.

The tree events come from the standard library's parser; end tags are not implied.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that stand on lines of their own, and tags whose text isn't shown.
BLOCKS = {
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav",
    "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HIDDEN = {"script", "style", "noscript", "head", "title", "svg", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


_BREAK = re.compile("[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")


class Lines:
    """The line in the making and those before it. A block begins a new line, unless a blank or a line end was the last thing written; what follows a block always does."""

    def __init__(self):
        self.done: list[str] = []
        self.words: list[str] = []
        self.at_blank = True

    def _end(self) -> None:
        if not self.words:
            return
        line = "".join(self.words).replace("\t", " ")
        self.words.clear()
        if "  " in line:
            line = " ".join(filter(None, line.split(" ")))
        if line := line.strip():
            self.done.append(line)

    def _break(self) -> None:
        self._end()
        self.at_blank = True

    def open(self, tag: str) -> None:
        if tag == "br" or tag in BLOCKS and not self.at_blank:
            self._break()

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._break()

    def add(self, text: str) -> None:
        if not text:
            return
        if text.isprintable():  # holds no line end
            self.words.append(text)
        else:
            first, *rest = _BREAK.split(text)
            self.words.append(first)
            for more in rest:
                self._end()
                self.words.append(more)
        self.at_blank = text[-1] in " \n"

    def text(self) -> str:
        self._end()
        return "\n".join(self.done)


# Markup that can be read by one expression, and tags whose content isn't markup. All other pages go to the parser.
_START = r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="(?:[^"<>&\x00]|&amp;)*+")*+)>'
_PLAIN = re.compile(rf"(?:{_START.replace('([', '(?:[').replace('((?', '(?:(?')}|</[a-z][a-z0-9]*>|[^<\x00]++)*+")
_TOKENS = re.compile(rf"{_START}|</([a-z][a-z0-9]*)>|([^<]+)")
_ATTRS = re.compile(' ([a-z-]+)="([^"]*)"')
_OTHER = re.compile("<(?:script|style|textarea|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math|template)|<title(?!>[^<&]*</title>)")


def fed(page: HTMLParser, html: str) -> HTMLParser:
    """Gives a parser its events, those that feed() and close() give; plain markup is cut by an expression, which takes a fraction of the time."""
    if not _PLAIN.fullmatch(html) or _OTHER.search(html):
        page.feed(html)
        page.close()
        return page
    for start, attrs, end, text in _TOKENS.findall(html):
        if text:
            page.handle_data(unescape(text) if "&" in text else text)
        elif start:
            page.handle_starttag(start, [(k, v.replace("&amp;", "&")) for k, v in _ATTRS.findall(attrs)] if attrs else [])
        else:
            page.handle_endtag(end)
    return page


class _Page(HTMLParser):
    """Text of the first body, or of the whole where there is none, and the links of the whole."""

    def __init__(self, schemes: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.schemes, self.lines, self.hidden, self.links, self.open, self.stack = schemes, Lines(), 0, {}, [], []
        self.body = "before"

    def _shown(self) -> bool:
        return not self.hidden and self.body != "after"

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.body == "before" and not self.hidden:
            self.lines, self.body = Lines(), len(self.stack)
        if self._shown() and tag not in HIDDEN:
            self.lines.open(tag)
            if tag in VOID:
                self.lines.close(tag)
        if tag == "a":
            href = (dict(attrs).get("href") or "").strip()
            self.open.append([href, []])
        if tag not in VOID:
            self.stack.append(tag)
            self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        if tag in self.stack:
            while True:
                top = self.stack.pop()
                self.hidden -= top in HIDDEN
                if top == "a" and self.open:
                    self._close()
                if self._shown() and top not in HIDDEN:
                    self.lines.close(top)
                if self.body == len(self.stack):
                    self.body = "after"
                if top == tag:
                    break

    def handle_data(self, data):
        for link in self.open:
            link[1].append(data.strip())
        if self._shown():
            self.lines.add(data)

    def _close(self):
        href, texts = self.open.pop()
        if href.startswith(self.schemes) and href not in self.links:
            self.links[href] = "".join(texts)

    def finish(self):
        while self.open:
            self._close()
        return self


def _read(html: str, schemes: tuple[str, ...]) -> tuple[str, list[dict]]:
    page = fed(_Page(schemes), html)
    page.finish()
    return page.lines.text(), [{"url": u, "anchor_text": t} for u, t in page.links.items()]


def rendered(html: Column, schemes: tuple[str, ...] = ("http://", "https://")) -> Column:
    """struct(text, links): block-aware text, and the first anchor of every URL in order; null html gives null."""

    @F.arrow_udf("struct<text: string, links: array<struct<url: string, anchor_text: string>>>")
    def render(column: pa.Array) -> pa.Array:
        kind = pa.struct([("text", pa.string()), ("links", pa.list_(pa.struct([("url", pa.string()), ("anchor_text", pa.string())])))])
        out = [None if h is None else dict(zip(("text", "links"), _read(h, schemes), strict=True)) for h in column.to_pylist()]
        return pa.array(out, kind)

    return render(html)
