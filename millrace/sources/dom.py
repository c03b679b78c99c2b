"""A small HTML tree for the Arrow helpers that read cards and containers; end tags are not implied."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from .html import HIDDEN, VOID, Lines, fed

#: Tags whose strings belong to no text.
CODE = {"script", "style", "template"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "place")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.place = len(parent.kids) if parent else 0


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("", {}, None)
        self.anchors: list[Node] = []

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {}, self.top)
        self.top.kids.append(node)
        if tag == "a":
            self.anchors.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.top
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.top = node.parent

    def handle_data(self, data):
        self.top.kids.append(data)


def tree(html: str) -> Node:
    return fed(_Builder(), html).root


def tree_and_anchors(html: str) -> tuple[Node, list[Node]]:
    """A tree with its anchors in document order."""
    page = fed(_Builder(), html)
    return page.root, page.anchors


def elements(node: Node) -> Iterator[Node]:
    """Nodes below one, in document order."""
    stack = [k for k in reversed(node.kids) if isinstance(k, Node)]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node))


def joined(node: Node, sep: str = "") -> str:
    if len(node.kids) == 1 and isinstance(node.kids[0], str) and node.tag not in CODE:
        return node.kids[0].strip()
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x.strip())
        elif x.tag not in CODE:
            stack.extend(reversed(x.kids))
    return sep.join(s for s in out if s)


def block_text(node: Node) -> str:
    """Lines at block tags, inline text joined, white space collapsed, blank lines gone."""
    lines = Lines()
    if node.tag in HIDDEN:
        return ""
    stack: list[Node | str | tuple[str]] = node.kids[::-1]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            lines.add(x)
        elif isinstance(x, tuple):
            lines.close(x[0])
        elif x.tag not in HIDDEN:
            lines.open(x.tag)
            stack.append((x.tag,))
            stack.extend(x.kids[::-1])
    return lines.text()


def page_text(root: Node) -> str:
    """Text of the first body that is shown, or of the whole where there is none: the text of html.rendered()."""
    stack = [root]
    while stack:
        x = stack.pop()
        if x.tag == "body":
            return block_text(x)
        if x.tag not in HIDDEN:
            stack.extend(k for k in reversed(x.kids) if isinstance(k, Node))
    return block_text(root)
