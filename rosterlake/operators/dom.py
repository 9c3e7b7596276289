"""A small document tree over the standard library's parser. Script and style content is text of its element; elements
that HTML leaves open are closed where their successors imply it; stray end tags are ignored, and what follows the end of a body is
still of it. A named character reference without its semicolon, or that HTML doesn't know, is text as it is written."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag ends these open elements, unless one of the listed containers is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"div", "td", "li", "article", "section"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}
HIDDEN = {"script", "style", "noscript", "template"}
CODE = {"pre", "code", "samp", "kbd", "svg"}
_REFERENCE = re.compile(r"&(#?[A-Za-z0-9]+;?)")


class Node:
    """settled is what a row's reader kept of what was below it, which then goes while the page is still read."""

    __slots__ = ("tag", "attrs", "children", "parent", "settled")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.settled = None
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def strings(self, hidden: frozenset = frozenset()) -> Iterator[tuple[str, Node]]:
        """Text pieces with their elements, in document order."""
        stack: list = [(c, self) for c in reversed(self.children)]
        while stack:
            c, at = stack.pop()
            if isinstance(c, str):
                yield c, at
            elif c.tag not in hidden:
                stack += [(x, c) for x in reversed(c.children)]

    def text(self) -> str:
        return "".join(s for s, _ in self.strings())

    def shown(self) -> str:
        """Text of a cell: no scripts, whitespace squeezed."""
        return " ".join(" ".join(s for s, _ in self.strings(frozenset(HIDDEN))).split())

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""


class _Builder(HTMLParser):
    """settle is told each row of a table when it is closed; `bare` stands for an ampersand that begins no reference."""

    def __init__(self, bare: str, settle: Callable[[Node], None] | None = None):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root
        self.bare, self.settle = bare, settle
        self.said: list[str] = []

    def leave(self, last: Node) -> None:
        """Close the open elements up to last."""
        if self.settle:
            n = self.at
            while n is not last.parent:
                if n.tag == "tr":
                    self.settle(n)
                n = n.parent
        self.at = last.parent

    def handle_starttag(self, tag, attrs):
        self.flush()
        closes, stops = ENDS.get(tag, (set(), set()))
        n, last = self.at, None
        while n.parent is not None and n.tag not in stops:
            if n.tag in closes:
                last = n
            n = n.parent
        if last is not None:
            self.leave(last)
        new = Node(tag, {k: (v or "").replace(self.bare, "&") for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if tag in ("body", "html"):
            return
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.leave(n)

    def handle_data(self, data):
        self.said.append(data.replace(self.bare, "&"))

    def flush(self) -> None:
        """The parser gives a text in pieces (at a bare "<"), which are one text here."""
        if self.said:
            self.at.children.append("".join(self.said))
            self.said = []

    def between(self, _) -> None:
        self.flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = between


def parse(html: str | None, settle: Callable[[Node], None] | None = None, references: Sequence[str] | None = None) -> Node:
    """The tree of a page. Where references are given, only these are read as characters (lt, amp ...), no numeric ones."""
    html = html or ""
    bare = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in html)
    reads = lambda x: (x[0] == "#" or (x[-1] == ";" and x in html5)) if references is None else x[-1] == ";" and x[:-1] in references
    b = _Builder(bare, settle)
    b.feed(_REFERENCE.sub(lambda m: m[0] if reads(m[1]) else bare + m[1], html))
    b.close()
    b.flush()
    return b.root


def visible_text(root: Node, blank: str = r"\s+") -> str:
    """The copy of a page; what blank matches is squeezed to one space."""
    body = next(iter(root.find("body")), root)
    out = []
    for s, at in body.strings():
        if at.tag in HIDDEN or at.tag in CODE or any(a.tag in CODE for a in at.ancestors()):
            continue
        out.append(s)
    return re.sub(blank, " ", " ".join(out)).strip(" ")
