"""HTML as a tree: elements and texts in page order, with the start and end tags that pages leave out put in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: What holds no text of a page.
UNSEEN = frozenset("script style title head iframe xmp noembed noframes template svg object select textarea button datalist audio video canvas map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li "
    "main menu nav ol p pre search section summary table ul".split()
)
#: Which open elements a start tag closes, and beyond which elements it does not look for them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)), "thead": (("caption",), ("table",)),
}
_P_SCOPE = ("table", "td", "th", "caption", "button", "object")

# An attribute's quotes may hold ">". Possessive, so that a tag is tried once.
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Tree:
    """Nodes in page order; node 0 is the page. A text node has the tag ``#text``."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    #: Words of ``class``, ``id`` and ``role``, and names of attributes that say something.
    cues: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str] = field(default_factory=lambda: [""])
    #: Whether a text begins a new block or line.
    apart: list[bool] = field(default_factory=lambda: [True])

    def add(self, parent: int, tag: str, cues: tuple[str, ...] = (), text: str = "", apart: bool = False) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.cues, cues), (self.text, text), (self.apart, apart)):
            column.append(value)
        return len(self.parent) - 1


def cues(attributes: str) -> tuple[str, ...]:
    """The words in the attributes that name what an element is for."""
    found: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            found.extend(w.lower() for w in _TOKEN.findall(html.unescape(value)))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found.append("hidden")
        elif name.startswith("data-label-"):
            found.append(name)
    return tuple(dict.fromkeys(found))


class _Builder:
    def __init__(self) -> None:
        self.tree = Tree()
        self.stack: list[int] = [0]
        self.places: dict[str, list[int]] = {"#page": [0]}
        self.blocks = [0]  # places in the stack of what is not inline
        self.apart = True

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, place: int) -> None:
        """Close the elements from ``place`` of the stack on."""
        while len(self.stack) > place:
            tag = self.tree.tag[self.stack.pop()]
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                self.apart = True

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        if tag in CLOSES_P and (at := self._last(("p",))) > self._last(_P_SCOPE):
            self.close(at)
        if tag in ENDS:
            closed, beyond = ENDS[tag]
            if (at := min((self.places[t][-1] for t in closed if self.places.get(t) and self.places[t][-1] > self._last(beyond)), default=-1)) > 0:
                self.close(at)
        if tag not in INLINE:
            self.apart = True
        if tag in VOID:
            return
        node = self.tree.add(self.stack[-1], tag, cues(attributes) if attributes else ())
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def end(self, tag: str) -> None:
        at = self._last((tag,))
        # An inline element does not close the blocks that were opened within it.
        if at > 0 and (tag not in INLINE or at > self.blocks[-1]):
            self.close(at)
        elif tag not in INLINE:
            self.apart = True

    def text(self, raw: str) -> None:
        if raw:
            self.tree.add(self.stack[-1], "#text", text=html.unescape(raw) if "&" in raw else raw, apart=self.apart)
            self.apart = self.apart and raw.isspace()


def parse(page: str) -> Tree:
    """The tree of ``page``. What is not well-formed is read as browsers read it, as far as texts are concerned."""
    made, at, end = _Builder(), 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0 or mark + 1 == end:
            made.text(page[at:])
            break
        follows = page[mark + 1]
        if not (follows in "/!?" or (follows.isascii() and follows.isalpha())):
            made.text(page[at : mark + 1])
            at = mark + 1
            continue
        made.text(page[at:mark])
        if follows in "/!?":
            if page.startswith("<!--", mark):
                stop = page.find("-->", mark + 2)
                at = stop + 3 if stop >= 0 else end
                continue
            stop = page.find(">", mark)
            if stop < 0:
                break
            if follows == "/" and (name := re.match(r"[a-zA-Z][^\s/>]*", page[mark + 2 : min(stop, mark + 66)])):
                made.end(name[0].lower())
            at = stop + 1
            continue
        found = _TAG.match(page, mark)
        if found is None:  # the page ends in a tag
            break
        tag, at = found[1].lower(), found.end()
        made.start(tag, found[2])
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else end
    return made.tree
