"""Pages as trees: a small parser and the selectors that site rules are written in.

Selectors: tag, .class, #id, [attribute], [attribute=value], joined (``p.date``)
and nested by a blank (``.content h3``); several after commas are tried in turn.
Broken mark-up gives what could be read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = frozenset(("script", "style", "noscript", "template"))
BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article main header footer nav aside blockquote".split())
_PART = re.compile(r"([#.]?[\w-]+)|\[([\w:-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        """Text with a line per block, blanks joined, soft hyphens out."""
        out: list[str] = []
        self._text(out)
        lines = [" ".join(x.split()) for x in "".join(out).replace("­", "").split("\n")]
        return "\n".join(x for x in lines if x)

    def _text(self, out: list[str]) -> None:
        if self.tag in SKIP:
            return
        if self.tag in BLOCK:
            out.append("\n")
        for c in self.children:
            if isinstance(c, Node):
                c._text(out)
            else:
                out.append(c)
        if self.tag in BLOCK:
            out.append("\n")

    def fits(self, step: str) -> bool:
        for name, attr, value in _PART.findall(step):
            if name.startswith("."):
                ok = name[1:] in (self.attrs.get("class") or "").split()
            elif name.startswith("#"):
                ok = self.attrs.get("id") == name[1:]
            elif name:
                ok = self.tag == name.lower()
            else:
                ok = attr in self.attrs and (not value or self.attrs[attr] == value)
            if not ok:
                return False
        return True

    def select(self, selector: str) -> list[Node]:
        """Nodes below this one, in document order."""
        for one in selector.split(","):
            steps = [x for x in one.split() if x != ">"]
            found = []
            for n in self.walk():
                if steps and n.fits(steps[-1]):
                    up, k = n.parent, len(steps) - 2
                    while up is not None and k >= 0:
                        k -= up.fits(steps[k])
                        up = up.parent
                    if k < 0:
                        found.append(n)
            if found:
                return found
        return []

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # what no parser reads ends the page
        pass
    return b.root
