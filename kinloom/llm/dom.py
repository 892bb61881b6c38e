"""A small reader of HTML: elements with parents, text blocks, and features of elements."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style noscript template head title svg select textarea iframe object".split())
RAW = frozenset("script style textarea title".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Start tags that end an open element of the same group, inside the nearest element of the second set.
SIBLING = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: For pages with an unclosed quotation mark: a tag ends at the next ``>``.
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")

#: Attribute tokens that templates commonly use.
MAIN_TOKENS = frozenset("article content main body entry post story text prose page document".split())
SIDE_TOKENS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo promotion nav navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar "
    "comment comments reply replies disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login form search share social related recommended more widget tags meta author legal copyright skip pagination pager".split()
)
SIDE_TAGS = frozenset("nav aside footer form menu dialog button fieldset".split())


class Page:
    """Elements in page order: ``tag, parent, tokens``; blocks of text: ``(element, text)``.

    Reading takes time in proportion to the page: each element knows its nearest block element, and for each tag the
    places of its open elements are at hand, so nothing searches the open elements.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.depth = ["#root"], [-1], [frozenset()], [0]
        self.blocks: list[tuple[int, str]] = []
        self.link_chars: Counter = Counter()
        self._stack, self._open, self._hidden, self._run = [0], {}, 0, []
        self._block, self._tag, self._stray = [0], _TAG, 0
        self._read(source)

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(t for _, t in self._run).split())
            if text:
                self.blocks.append((self._run[0][0], text))
            self._run = []

    def _text(self, raw: str) -> None:
        if self._hidden or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if self._run or not text.isspace():
            node = self._block[self._stack[-1]] or self._implied()
            self._run.append((node, text))
            if self._open.get("a"):
                self.link_chars[node] += len(text.strip())

    def _implied(self) -> int:
        """The body that a page does not mark: all text outside any block element is in it."""
        if not self._stray:
            self._stray = len(self.tag)
            for have, new in ((self.tag, "body"), (self.parent, 0), (self.tokens, frozenset()), (self.depth, 1), (self._block, self._stray)):
                have.append(new)
        return self._stray

    def _pop(self) -> None:
        node = self._stack.pop()
        tag = self.tag[node]
        if tag not in INLINE:
            self._flush()
        self._open[tag].pop()
        self._hidden -= tag in HIDDEN

    def _close(self, tag: str) -> None:
        if self._open.get(tag):
            self._pop_to(self._open[tag][-1])

    def _pop_to(self, place: int) -> None:
        """Close all elements from ``place`` on the stack upwards."""
        while len(self._stack) > place:
            self._pop()

    def _last(self, tags: tuple[str, ...]) -> int:
        """Place on the stack of the last open element of these tags."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)

    def _start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag not in INLINE:
            self._flush()
        if tag in ENDS_P and self._open.get("p"):
            self._close("p")
        if tag in SIBLING:
            ends, inside = SIBLING[tag]
            place = self._last(ends)
            if place > self._last(inside):
                self._pop_to(place)
        if tag in VOID:
            return
        words: set[str] = set()
        for m in _NAMES.finditer(attributes):
            words.update(_TOKEN.findall((m[1] or m[2] or m[3] or "").lower()))
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.tokens.append(frozenset(words))
        self.depth.append(len(self._stack))
        self._block.append(self._block[self._stack[-1]] if tag in INLINE else len(self.tag) - 1)
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        self._hidden += tag in HIDDEN

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                break
            if lt > at:
                self._text(source[at:lt])
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            if source[lt + 1 : lt + 2] in ("!", "?"):
                end = source.find(">", lt)
                at = size if end < 0 else end + 1
                continue
            m = self._tag.match(source, lt)
            if not m and self._tag is _TAG and source[lt + 1 : lt + 3].strip("/")[:1].isalpha():
                self._tag = _PLAIN_TAG  # a quotation mark stays open to the end: it is not tried again
                m = self._tag.match(source, lt)
            if not m and source.find(">", lt) < 0:  # no tag can follow
                self._text(source[lt:])
                break
            if not m:
                self._text("<")
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._start(tag, m[3], m[3].endswith("/"))
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(source, at)
                stop = size if end is None else end.start()
                at = stop
        while len(self._stack) > 1:
            self._pop()
        self._flush()


FEATURES = (
    "chars", "link_share", "tags_per_char", "depth", "sibling_place", "siblings", "page_share", "mean_block", "stops", "paragraphs",
    "main_tokens", "side_tokens", "main_above", "side_above", "side_tag", "article_tag", "paragraph_tag", "heading_tag", "list_tag", "parent_chars",
)


def node_features(page: Page) -> tuple[list[int], list[list[float]]]:
    """(elements that are not inline, their features)."""
    n = len(page.tag)
    chars, blocks, stops, links, tags, paragraphs = ([0] * n for _ in range(6))
    for node, text in page.blocks:
        chars[node] += len(text)
        blocks[node] += 1
        stops[node] += text.count(".") + text.count(",")
    for node, c in page.link_chars.items():
        links[node] += c
    children = [0] * n
    place = [0] * n
    main_above, side_above = [0] * n, [0] * n
    for v in range(1, n):
        u = page.parent[v]
        if page.tag[v] not in INLINE:
            children[u] += 1
            place[v] = children[u]
        main_above[v] = main_above[u] or page.tag[v] in ("article", "main") or (bool(page.tokens[v] & MAIN_TOKENS) and not page.tokens[v] & SIDE_TOKENS and page.tag[v] != "body")
        side_above[v] = side_above[u] or page.tag[v] in SIDE_TAGS or bool(page.tokens[v] & SIDE_TOKENS)
    for v in range(n - 1, 0, -1):
        u = page.parent[v]
        tags[v] += 1
        paragraphs[v] += page.tag[v] == "p"
        for count in (chars, blocks, stops, links, tags, paragraphs):
            count[u] += count[v]
    kept = [v for v in range(1, n) if page.tag[v] not in INLINE and chars[v]]
    total = max(chars[0], 1)
    rows = []
    for v in kept:
        u, tag, own = page.parent[v], page.tag[v], page.tokens[v]
        rows.append([
            math.log1p(chars[v]), min(links[v] / chars[v], 1.0), tags[v] / chars[v], page.depth[v], place[v] / max(children[u], 1), math.log1p(children[u]),
            chars[v] / total, math.log1p(chars[v] / max(blocks[v], 1)), stops[v] / chars[v], math.log1p(paragraphs[v]),
            float(bool(own & MAIN_TOKENS)), float(bool(own & SIDE_TOKENS)), float(main_above[v]), float(side_above[v]),
            float(tag in SIDE_TAGS), float(tag in ("article", "main")), float(tag == "p"), float(tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(tag in ("ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th")), math.log1p(chars[u]),
        ])
    return kept, rows
