"""A flat, forgiving DOM: block elements of a page in document order.

The page is read once from front to back.  Searches for an end that is not there
happen once a page and kind, and what an element closes is looked up by name, so
the time is linear in the page whatever it holds.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np

#: HTML element names by role.
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
SKIPPED = "button datalist iframe noembed noframes option script select style template textarea title".split()
VOID = "area base br col embed frame hr img input link meta param source track wbr".split()
RAW = "script style textarea title iframe noembed noframes".split()
#: Starts of these end an open paragraph.
_ENDS_P = frozenset(BLOCKS) - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A start on the left ends open elements on the right, up to a container that holds them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
#: Kinds of block that features tell apart.
KINDS = ["#text", "article", "main", "section", "div", "p", "h", "li", "list", "cell", "table", "nav", "header", "footer", "aside", "form", "quote", "body", "other"]
_KIND = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "tr": "table", "tbody": "table", "thead": "table", "fieldset": "form", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote"}
#: Hash buckets of the words in class, id and role attributes.
BUCKETS = 512
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_IS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


def bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % BUCKETS


def attribute_words(attributes: dict[str, str]) -> list[str]:
    """Words of class, id and role, camel case taken apart."""
    return [w for name in ("class", "id", "role") if name in attributes for w in _WORDS.findall(attributes[name])]


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or ("style" in attributes and _NOT_SHOWN.search(attributes["style"]) is not None)


class Scanner:
    """Text, start tags and end tags of a page, in order."""

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.absent: set[str] = set()  # what was searched for in vain: it does not come later either

    def _find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def _attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes from ``at`` on, and the place behind the tag; the page's end if the tag has none."""
        html, out = self.html, {}
        n = len(html)
        while True:
            at = _GAP.match(html, at).end()
            if at >= n:
                return out, n + 1
            if html[at] == ">":
                return out, at + 1
            m = _ATTRIBUTE.match(html, at)
            name, value, at = m[0].lower(), "", m.end()
            if m := _IS.match(html, at):
                at = m.end()
                quote = html[at : at + 1]
                if quote in ("'", '"'):
                    end = self._find(quote, at + 1)
                    if end < 0:  # a quote that never ends: the tag ends where it can
                        end = self._find(">", at)
                        return out, end + 1 if end >= 0 else n + 1
                    value, at = html[at + 1 : end], end + 1
                else:
                    m = _BARE.match(html, at)
                    value, at = m[0], m.end()
            out.setdefault(name, value)

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """("text", text, {}), ("start", name, attributes) or ("end", name, {})."""
        html, n = self.html, len(self.html)
        begin = 0  # of text not yet passed on
        while self.at < n:
            lt = self._find("<", self.at)
            if lt < 0 or lt + 1 >= n:
                break
            c = html[lt + 1]
            if c in "!?/" and not (c == "/" and _NAME.match(html, lt + 2)):
                if html.startswith("<!--", lt):
                    end = self._find("-->", lt + 2)
                    end = n if end < 0 else end + 3
                else:
                    end = self._find(">", lt)
                    end = n if end < 0 else end + 1
                found = None
            elif m := _NAME.match(html, lt + 1 + (c == "/")):
                end = m.end()
                attributes, end = ({}, end + 1) if html.startswith(">", end) else self._attributes(end)
                found = ("end", m[0].lower(), {}) if c == "/" else ("start", m[0].lower(), attributes)
            else:
                self.at = lt + 1  # a mere character
                continue
            if lt > begin:
                yield "text", html[begin:lt], {}
            begin = self.at = end
            if found and end <= n:
                yield found
                begin = self.at  # the reader may have skipped an element
        if begin < n:
            yield "text", html[begin:], {}

    def skip(self, name: str) -> None:
        """Moves behind the end tag of an element; nested elements of the same name are part of it."""
        html, n = self.html, len(self.html)
        if name in RAW:
            missing = f"</{name}"
            m = None if missing in self.absent else re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, self.at)
            if m:
                end = self._find(">", m.end())
                self.at = n if end < 0 else end + 1
            else:
                self.absent.add(missing)
                self.at = n if name in ("script", "style") else self.at
            return
        depth, tag = 1, re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I)
        while depth and (m := tag.search(html, self.at)):
            depth += -1 if m[1] else 1
            end = self._find(">", m.end())
            self.at = n if end < 0 else end + 1


class Page:
    """Blocks in document order; block i's descendants are i+1 .. end[i]-1."""

    def __init__(self, html: str):
        self.parent, self.end, self.kind, self.depth, self.words, self.raw = [], [], [], [], [], []
        self.links, self.tags, self.breaks = [], [], []
        self._parse(html)
        self.texts = [" ".join(unescape("".join(x)).split()) if x else "" for x in self.raw]

    def _open(self, name: str, attributes: dict[str, str], parent: int) -> int:
        i = len(self.parent)
        self.parent.append(parent)
        self.end.append(0)
        kind = _KIND.get(name, name)
        self.kind.append(_KIND_INDEX.get(kind, len(KINDS) - 1))
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.words.append(0)
        self._name(i, attributes)
        self.raw.append([])
        self.links.append(0)
        self.tags.append(0)
        self.breaks.append(0)
        return i

    def _name(self, block: int, attributes: dict[str, str]) -> None:
        for word in attribute_words(attributes) if attributes else ():
            self.words[block] |= 1 << bucket(word)

    def _parse(self, html: str) -> None:
        root = self._open("body", {}, -1)
        stack: list[tuple[str, int, bool]] = [("#root", root, False)]  # name, block it belongs to, not shown
        places: dict[str, list[int]] = defaultdict(list)  # of each name on the stack
        text_at, in_link, unseen = -1, 0, 0  # the block that text goes to now, -1 if it has to be found; open links; elements not shown

        def push(name: str, block: int, away: bool = False) -> None:
            nonlocal unseen
            places[name].append(len(stack))
            stack.append((name, block, away))
            unseen += away

        def close_to(depth: int) -> None:
            nonlocal text_at, in_link, unseen
            while len(stack) > depth:
                name, block, away = stack.pop()
                places[name].pop()
                unseen -= away
                if name == "a":
                    in_link -= 1
                if block != stack[-1][1]:
                    self.end[block] = len(self.parent)
                    text_at = -1

        def say(data: str) -> None:
            nonlocal text_at
            if unseen:
                return
            if text_at < 0:
                if not data or data.isspace():
                    return
                block = stack[-1][1]
                # text beside child blocks is a block of its own
                text_at = block if len(self.parent) == block + 1 and block != root else self._open("#text", {}, block)
                if text_at != block:
                    self.end[text_at] = text_at + 1
            self.raw[text_at].append(data)
            if in_link > 0:
                self.links[text_at] += len(data)

        scanner = Scanner(html)
        for what, name, attributes in scanner:
            if what == "text":
                say(name)
            elif what == "end":
                if name == "a":  # not beyond the block it stands in
                    if stack[-1][0] == "a":
                        close_to(len(stack) - 1)
                elif name in _BLOCK_SET and places[name]:
                    close_to(places[name][-1])
            elif name in _SKIP_SET:
                scanner.skip(name)
            elif name == "br" or name == "hr":
                say(" ")
                if text_at >= 0:
                    self.breaks[text_at] += 1
            elif name not in _BLOCK_SET:
                if name not in VOID and attributes and hidden(attributes):
                    scanner.skip(name)
                    continue
                if name == "a":
                    if stack[-1][0] == "a":
                        close_to(len(stack) - 1)
                    push("a", stack[-1][1])
                    in_link += 1
                self.tags[text_at if text_at >= 0 else stack[-1][1]] += 1
            elif name in ("html", "body"):
                self._name(root, attributes)
            else:
                if name in _ENDS_P:
                    top = len(stack) - (2 if stack[-1][0] == "a" else 1)
                    if stack[top][0] == "p":
                        close_to(top)
                if name in _ENDS:
                    ends, walls = _ENDS[name]
                    wall = max((places[w][-1] for w in walls if places[w]), default=0)
                    inside = [places[e][k] for e in ends if (k := bisect_right(places[e], wall)) < len(places[e])]
                    if inside:
                        close_to(min(inside))
                if unseen or (attributes and hidden(attributes)):
                    push(name, stack[-1][1], True)
                else:
                    push(name, self._open(name, attributes, stack[-1][1]))
                    text_at = -1
        close_to(1)
        self.end[root] = len(self.parent)

    def columns(self) -> np.ndarray:
        """(blocks, columns): parent, end, kind, depth, length, link length, inline tags, breaks, sentence marks."""
        marks = [sum(map(t.count, ".,;!?")) for t in self.texts]
        return np.array([self.parent, self.end, self.kind, self.depth, [len(t) for t in self.texts], self.links, self.tags, self.breaks, marks], np.int64).T

    def buckets(self, used: np.ndarray | None = None) -> np.ndarray:
        """(blocks, 2 * BUCKETS) zeros and ones: buckets of a block's own words, and of those of all blocks around it; only the columns ``used``."""
        around = list(self.words)
        for i in range(1, len(around)):
            around[i] = self.words[self.parent[i]] | (around[self.parent[i]] if self.parent[i] else 0)
        out = []
        for at in range(0, len(around), 4_096):
            packed = b"".join(x.to_bytes(BUCKETS // 8, "little") + y.to_bytes(BUCKETS // 8, "little") for x, y in zip(self.words[at : at + 4_096], around[at : at + 4_096], strict=True))
            bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, BUCKETS // 4), axis=1, bitorder="little")
            out.append(bits if used is None else bits[:, used])
        return np.concatenate(out)


_KIND_INDEX = {k: i for i, k in enumerate(KINDS)}
_BLOCK_SET, _SKIP_SET = frozenset(BLOCKS) - {"hr"}, frozenset(SKIPPED)


def features(c: np.ndarray) -> np.ndarray:
    """One row a block, from :meth:`Page.columns`: what it holds, where it stands, what surrounds it."""
    n = len(c)
    parent, end, kind, depth = c[:, 0], c[:, 1], c[:, 2], c[:, 3]
    up = np.maximum(parent, 0)
    sums = np.zeros((n + 1, 6))
    np.cumsum(np.column_stack((c[:, 4:9], np.ones(n))), axis=0, out=sums[1:])
    here = np.arange(n)
    sub = sums[end] - sums[here]
    length, links, tags, breaks, marks, blocks = sub.T
    total = max(1.0, sums[-1, 0])
    paragraphs = np.concatenate(([0], np.cumsum(kind == _KIND_INDEX["p"])))
    paragraphs = (paragraphs[end] - paragraphs[here]).astype(float)
    above, index, seen = [0] * n, [0] * n, [0] * n  # kinds of all blocks around; place among siblings
    parents, kinds = parent.tolist(), kind.tolist()
    for i in range(1, n):
        p = parents[i]
        above[i] = above[p] | 1 << kinds[p]
        index[i] = seen[p]
        seen[p] += 1
    above, index = np.array(above), np.array(index, float)
    siblings = np.array(seen, float)[up]
    _, back, times = np.unique(up * len(KINDS) + kind, return_inverse=True, return_counts=True)
    alike = times[back].astype(float)
    inside = [(above >> _KIND_INDEX[k]) & 1 for k in ("article", "main", "nav", "header", "footer", "aside", "form", "list")]
    own = [kind == k for k in range(len(KINDS))]
    return np.column_stack((np.log1p(length), links / np.maximum(1, length), length / (tags + blocks + 1), marks / np.maximum(1, length) * 100, np.log1p(paragraphs), np.log1p(blocks), depth, index / np.maximum(1, siblings), np.log1p(siblings), np.log1p(alike), length / np.maximum(1, length[up]), length / total, sums[here, 0] / total, (paragraphs + 1) / (blocks + 1), np.log1p(breaks), *inside, *own)).astype(np.float32)
