"""A small element tree on the standard parser: enough for filings, tolerant of unclosed elements."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An element that a new one of the listed kinds ends, if it is still open.
ENDS = {"p": {"p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Element:
    __slots__ = ("tag", "attrs", "parent", "inner")

    def __init__(self, tag: str, attrs: dict, parent: "Element | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inner: list[Element | str] = []

    def walk(self) -> Iterator["Element"]:
        """Elements below, in document order, without recursion."""
        stack = [x for x in reversed(self.inner) if isinstance(x, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [x for x in reversed(e.inner) if isinstance(x, Element)]

    def all(self, *tags: str) -> list["Element"]:
        return [e for e in self.walk() if e.tag in tags]

    def children(self, *tags: str) -> list["Element"]:
        return [e for e in self.inner if isinstance(e, Element) and e.tag in tags]

    def text(self, skip: frozenset = frozenset()) -> str:
        """All text below, white space collapsed; elements in skip don't count."""
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.tag not in skip or e is self:
                stack += reversed(e.inner)
                out.append(" ")
        return " ".join("".join(out).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in ENDS and tag in ENDS[self.at.tag]:
            self.at = self.at.parent
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inner.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.inner.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.inner.append(data)


def tree(page: str) -> Element:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root
