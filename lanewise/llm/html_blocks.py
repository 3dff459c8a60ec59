"""Leaf blocks of a web page: runs of text between block boundaries, with their ancestors.

A forgiving reader of tag soup: implied ends of paragraphs, items, cells and options, void and
raw-text elements, unclosed comments and tags. Tags are read by the states of the HTML tokenizer, so a quote opens a
string only after ``=``; a string that no quote ends lasts to the first ``>``. Scripts, styles, templates and the like never yield text; formulas and the content of
object, noscript, audio, video and canvas are inline text. An unclosed raw-text element lasts to the end of the page, any other swallows nothing. Character
references are decoded and white space in a block becomes one space.

Time and memory are linear in the page: open elements are found by their places, and blocks share their ancestors.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

#: The rest of a well-formed tag after its name; any other goes through ``_Page.attributes``.
_PLAIN = re.compile(r"""((?:\s++[^\s/>="'<]++(?:="[^"]*+"|='[^']*+'|=[^\s>"'=<`]++)?+)*+\s*+/?)>""")
_PLAIN_ATTRIBUTE = re.compile(r"""([^\s/>="'<]++)(?:="([^"]*+)"|='([^']*+)'|=([^\s>"'=<`]++))?+""")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE_VALUE = re.compile(r"[^\s>]*+")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes textarea title".split())
SILENT = RAW | frozenset("template svg datalist".split())
#: An open element of the second set ends when one of the first begins, unless one of the third lies between.
_IMPLIED = (
    (frozenset("li".split()), frozenset("li".split()), frozenset("ul ol menu dir".split())),
    (frozenset("dt dd".split()), frozenset("dt dd".split()), frozenset("dl".split())),
    (frozenset("option optgroup".split()), frozenset("option".split()), frozenset("select".split())),
    (frozenset("td th".split()), frozenset("td th".split()), frozenset("table tr".split())),
    (frozenset("tr".split()), frozenset("tr td th".split()), frozenset("table".split())),
    (frozenset("tbody tfoot thead".split()), frozenset("tbody tfoot thead tr td th".split()), frozenset("table".split())),
)
_CLOSES_P = BLOCKS - frozenset("button label option optgroup select td th tr tbody tfoot thead caption".split())
_SHUTS_P_IN = ("button", "td", "th", "table")
_PLACED = frozenset(_SHUTS_P_IN) | {"p"} | frozenset().union(*(b | c for _, b, c in _IMPLIED))
_NOTED = frozenset("class id role itemprop hidden style aria-hidden href".split())


@dataclass(eq=False, slots=True)
class Place:
    """An open block element: its tag, the names that it gives itself, and what it adds to its ancestors' features."""

    tag: str
    names: tuple[str, ...]  # words of class, id, role and itemprop; "hidden!"
    up: Place | None
    new: tuple[str, ...]  # "has tag" and "name word" that no ancestor has
    score: float | None = field(default=None, repr=False)  # kept by the field that reads the page
    inner: float | None = field(default=None, repr=False)

    def path(self) -> tuple[str, ...]:
        """This place and its ancestors, outermost first, as "tag name name ..."."""
        out, at = [], self
        while at is not None:
            out.append(" ".join((at.tag, *at.names)))
            at = at.up
        return tuple(reversed(out))


@dataclass(slots=True)
class Block:
    text: str
    place: Place | None
    linked: int  # characters inside links


def _names(attributes: list[tuple[str, str]]) -> tuple[tuple[str, ...], bool]:
    """Words of class, id, role and itemprop, "hidden!", and whether there is a href."""
    names: dict[str, None] = {}
    linked = False
    for key, value in attributes:
        value = value.lower()
        if key in ("class", "id", "role", "itemprop"):
            names.update(dict.fromkeys(n for n in _NAME.findall(value) if n.isalpha() and len(n) > 1))
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            names["hidden!"] = None
        elif key == "href":
            linked = True
    return tuple(names), linked


def _listed(text: str) -> list[tuple[str, str]]:
    """The attributes of a plain tag."""
    out = []
    for name, a, b, c in _PLAIN_ATTRIBUTE.findall(text):
        if (name := name.lower()) in _NOTED:
            value = a or b or c
            out.append((name, unescape(value) if "&" in value else value))
    return out


@lru_cache(maxsize=1 << 12)
def _plain(text: str) -> tuple[tuple[str, ...], bool]:
    return _names(_listed(text))


class _Page:
    def __init__(self, html: str):
        self.html, self.n = html, len(html)
        self.last = {q: html.rfind(q) for q in "\"'>"}

    def find(self, text: str, at: int) -> int:
        """Where the next ``text`` (a quote or >) is, or -1; free where there is none."""
        return self.html.find(text, at) if at <= self.last[text] else -1

    def attributes(self, at: int, wanted: bool) -> tuple[list[tuple[str, str]], int]:
        """The attributes of a tag from ``at``, where its name ends, and where the tag ends; a page that ends first ends it."""
        html, n, out = self.html, self.n, []
        while True:
            at = _GAP.match(html, at).end()
            if at >= n:
                return out, n
            if html[at] == ">":
                return out, at + 1
            m = _ATTRIBUTE_NAME.match(html, at)
            name, at, value = m[0], m.end(), ""
            if equals := _EQUALS.match(html, at):
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ("'", '"'):
                    end = self.find(quote, at + 1)
                    if end < 0:
                        end = self.find(">", at + 1)
                        if end < 0:
                            return out, n
                        value, at = html[at + 1 : end], end
                    else:
                        value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE_VALUE.match(html, at)
                    value, at = bare[0], bare.end()
            if wanted and (name := name.lower()) in _NOTED:
                out.append((name, unescape(value) if "&" in value else value))

    def tag(self, at: int, wanted: bool) -> tuple[tuple[str, ...], bool, int]:
        """The names that a tag gives its element, whether it has a href, and where it ends. Most tags are plain and need one match."""
        html = self.html
        if html.startswith(">", at):
            return (), False, at + 1
        if m := _PLAIN.match(html, at):
            if wanted and m[1]:
                return *(_plain(m[1]) if len(m[1]) < 200 else _names(_listed(m[1]))), m.end()
            return (), False, m.end()
        found, at = self.attributes(at, wanted)
        return *_names(found), at


class _Open:
    """The open block elements, innermost last."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: list[Place] = []
        self.at: dict[str, list[int]] = {t: [] for t in _PLACED}
        self.count: Counter = Counter()
        self.features: Counter = Counter()

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        own = [f"has {tag}", *(f"name {n}" for n in names)]
        new = tuple(f for f in own if not self.features[f])
        if tag in _PLACED:
            self.at[tag].append(len(self.tags))
        self.places.append(Place(tag, names, self.places[-1] if self.places else None, new))
        self.tags.append(tag)
        self.count[tag] += 1
        for f in new:
            self.features[f] += 1

    def cut(self, size: int) -> None:
        """Close the elements from the outside in, down to ``size`` of them."""
        while len(self.tags) > size:
            tag, place = self.tags.pop(), self.places.pop()
            if tag in _PLACED:
                self.at[tag].pop()
            self.count[tag] -= 1
            for f in place.new:
                self.features[f] -= 1

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def close(self, tag: str) -> None:
        if self.count[tag]:
            size = len(self.tags) - 1
            while self.tags[size] != tag:
                size -= 1
            self.cut(size)

    def make_room(self, tag: str) -> None:
        """Close what ``tag`` implies the end of."""
        if tag in _CLOSES_P and self.at["p"] and self.last(_SHUTS_P_IN) < self.at["p"][-1]:
            self.cut(self.at["p"][-1])
        for begins, ends, scope in _IMPLIED:
            if tag in begins:
                floor = self.last(scope) + 1
                inside = [a[i] for t in ends if (a := self.at[t]) and (i := bisect_left(a, floor)) < len(a)]
                if inside:
                    self.cut(min(inside))


def leaf_blocks(html: str) -> list[Block]:
    out: list[Block] = []
    page, opened = _Page(html), _Open()
    held: list[str] = []
    endless: set[str] = set()  # elements that no end tag follows
    linked, in_link, at, n = 0, False, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if held:
            text = "".join(held)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, opened.places[-1] if opened.places else None, linked))
            held.clear()
        linked = 0

    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at:
            held.append(html[at:start])
            if in_link:
                linked += start - at
        if start >= n - 1:
            if start == n - 1:
                held.append("<")
            break
        sign = html[start + 1]
        closing = sign == "/"
        name = _TAG_NAME.match(html, start + 2 if closing else start + 1)
        if name is None:
            if html.startswith("<!--", start):
                if html.startswith((">", "->"), start + 4):
                    at = html.index(">", start) + 1
                else:
                    end = html.find("-->", start + 4)
                    at = end + 3 if end >= 0 else n
            elif sign in "!?/":
                end = page.find(">", start + 2)
                at = end + 1 if end >= 0 else n
            else:
                held.append("<")
                at = start + 1
            continue
        tag = name[0].lower()
        names, linking, at = page.tag(name.end(), not closing and (tag in BLOCKS or tag == "a"))
        if closing:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                flush()
                opened.close(tag)
        elif tag in SILENT:
            if tag not in endless and not (tag == "svg" and html[at - 2 : at] == "/>"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).search(html, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = n
                else:
                    endless.add(tag)
        elif tag == "a":
            in_link = linking
        elif tag in ("br", "annotation", "annotation-xml"):
            held.append("\n")
        elif tag in BLOCKS:
            flush()
            opened.make_room(tag)
            if tag != "hr":
                opened.push(tag, names)
    flush()
    return out
