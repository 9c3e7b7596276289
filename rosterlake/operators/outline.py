"""Which heading stands over each element of a page, found in one walk in document order.

What is heard on the way down is the nearest usable heading so far; an element hands what it says on to what comes after it when it
is left: itself if it is a heading, else the last heading inside it. An element that holds one person's details says
nothing, as its heading is their name. So the cost is that of the walk, at any depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from rosterlake.functions import vocabulary as V
from rosterlake.operators.dom import Node

_GENERIC = re.compile(V.GENERIC_HEADING)
_INSIDE = ("h1", "h2", "h3", "h4", "caption")
_ITSELF = (*_INSIDE, "h5")
MANY = object()


class _Open:
    """An element on the way: what has been heard when its next child is met, and what it holds so far."""

    __slots__ = ("node", "heard", "last", "mails", "names", "profile")

    def __init__(self, node: Node, heard: str | None):
        self.node, self.heard = node, heard
        self.last: Node | None = None
        self.mails = self.names = 0
        self.profile: object = None

    def one_person(self) -> bool:
        return self.mails == 1 or self.names == 1 or self.profile not in (None, MANY)

    def take_profile(self, other: object) -> None:
        if other is not None:
            self.profile = other if self.profile in (None, other) else MANY


class Outline:
    """profile says what address of a person's own page a link has, if any; the card's name element is V.CARD_NAME."""

    def __init__(self, root: Node, profile: Callable[[str], str | None]):
        self._over: dict[int, str | None] = {}
        self._said: dict[int, str | None] = {}
        way = [_Open(root, None)]
        todo: list[tuple[Node, bool]] = [(c, True) for c in reversed(root.children) if isinstance(c, Node)]
        while todo:
            node, entering = todo.pop()
            if entering:
                self._over[id(node)] = way[-1].heard
                way.append(_Open(node, way[-1].heard))
                todo.append((node, False))
                todo += [(c, True) for c in reversed(node.children) if isinstance(c, Node)]
            else:
                self._leave(way.pop(), way[-1], profile)

    def _leave(self, it: _Open, up: _Open, profile: Callable[[str], str | None]) -> None:
        node = it.node
        if node.settled:
            it.mails += node.settled.mails
            for href in node.settled.profiles:
                it.take_profile(href)
        if not it.one_person():
            own = node if node.tag in _ITSELF else None
            said = next((s for h in (own, it.last) if h is not None and (s := self._usable(h))), None)
            up.heard = said or up.heard
        up.last = it.last or (node if node.tag in _INSIDE else up.last)
        href = node.get("href") if node.tag == "a" else ""
        up.mails += it.mails + href.startswith("mailto:")
        up.names += it.names + (node.get("data-test-id") == V.CARD_NAME)
        up.take_profile(it.profile)
        up.take_profile(profile(href) if href else None)

    def _usable(self, heading: Node) -> str | None:
        if id(heading) not in self._said:
            text = heading.shown()
            self._said[id(heading)] = text[:120] if text and not _GENERIC.match(text) else None
        return self._said[id(heading)]

    def over(self, node: Node) -> str | None:
        return self._over.get(id(node))
