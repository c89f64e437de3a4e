"""A small element tree of XHTML documents, with a stable number for every element."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str]
    node_id: int
    parent: Element | None = None
    children: list[Element] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)  # direct text, in order

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(reversed(e.children))

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {}, -1)
        self.now = self.root
        self.n = 0

    def _open(self, tag, attrs) -> Element:
        e = Element(tag.lower().rpartition(":")[2], {k.lower(): v or "" for k, v in reversed(attrs)}, self.n, self.now)
        self.n += 1
        self.now.children.append(e)
        return e

    def handle_starttag(self, tag, attrs):
        e = self._open(tag, attrs)
        if e.tag not in VOID:
            self.now = e

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)

    def handle_endtag(self, tag):
        e = self.now
        while e is not self.root and e.tag != tag.lower().rpartition(":")[2]:
            e = e.parent
        if e is not self.root:
            self.now = e.parent

    def handle_data(self, data):
        self.now.texts.append(data)


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root
