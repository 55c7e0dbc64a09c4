"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events once.  Block elements
cut it into lines; a line's ratio is its characters outside links over its
tags.  Ratios are smoothed by a Gaussian, a threshold clusters the lines into
content and the rest, and the region of the page that holds the content lines
is selected.  What the markup itself names as a menu, advert, comment and the
like has ratio 0 and is never selected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0               # lines, of the Gaussian
RADIUS = 2
SUBTREE_SHARE = 0.8       # of the content mass that a narrower region must hold
LINK_SHARE = 0.5          # of a line's characters, above which a line outside a cluster is a menu's
SLICE_ROWS = 256

# HTML element names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset("article main section div td body center blockquote".split())
REJECTED = frozenset("script style template noscript title nav footer aside form button select textarea iframe svg canvas object dialog "
                     "menu audio video map datalist".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
                  "option": ("select",)}
# Landmark roles, and words of class and id names, of what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
                  "notification newsletter subscribe subscription paywall menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar "
                  "footer header masthead comment comments commentlist disqus reply replies respond share sharing social related recommended "
                  "popup modal overlay login signup widget toolbar pagination pager copyright".split())
HEAD_WORDS = frozenset("header banner masthead".split())      # allowed inside an article
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN_START = re.compile("<([A-Za-z][A-Za-z0-9]*)>")
_PLAIN_END = re.compile("</([A-Za-z][A-Za-z0-9]*)>")
_NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Region:
    """An element that may hold the article."""
    tag: str
    above: int                # index of the region around it, -1 for none
    article: int              # index of the outermost article or main around it or itself, -1 for none


@dataclass
class Line:
    region: int
    rejected: bool
    heading: bool = False
    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0           # characters inside links


class Lines(HTMLParser):
    """Cuts a page's events into lines at block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.regions = [Region("", -1, -1)]
        # open elements: tag, whether it is rejected, its region, whether it is a link
        self.stack: list[tuple[str, bool, int, bool]] = []
        self.open: Counter[str] = Counter()
        self.tags = 0
        self.line: Line | None = None

    # Tags without attributes are most of a page; positions are never asked for.

    def updatepos(self, i: int, j: int) -> int:
        return j

    def parse_starttag(self, i: int) -> int:
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None:
            return super().parse_starttag(i)
        tag = plain[1].lower()
        self.handle_starttag(tag, ())
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def _state(self) -> tuple[bool, int, bool]:
        return self.stack[-1][1:] if self.stack else (False, 0, False)

    def _end_line(self) -> None:
        if self.line is not None:
            self.lines.append(self.line)
            self.line = None

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in INLINE:
            self._end_line()
            self._close_implied(tag)
        self.tags += 1
        if self.line is not None:
            self.line.tags += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        rejected, region, linked = self._state()
        above = self.regions[region]
        inside = above.article >= 0
        own = tag in ("article", "main") or bool(attrs) and any(
            k == "itemprop" and v == "articleBody" or k == "role" and v in ("main", "article") for k, v in attrs)
        # an article inside another is a reader's comment
        rejected = rejected or self._names_other(tag, attrs, inside or own) or (tag == "article" and self.open["article"] > 0)
        if own or tag in REGIONS:
            n = len(self.regions)
            self.regions.append(Region(tag, region, above.article if inside else n if own and not rejected else -1))
            region = n
        self.stack.append((tag, rejected, region, linked or tag == "a"))
        self.open[tag] += 1

    @staticmethod
    def _names_other(tag: str, attrs, inside: bool) -> bool:
        if tag in REJECTED or (tag == "header" and not inside):
            return True
        if tag in ("html", "body"):
            return False
        for name, value in attrs:
            value = value or ""
            if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and value.lower() in ROLES or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
            if name in ("class", "id"):
                words = {w.lower() for w in _NAME_PARTS.split(value)} & WORDS
                if words - HEAD_WORDS or words and not inside:
                    return True
        return False

    def _close_implied(self, tag: str) -> None:
        """A block element closes an open paragraph, its inline elements, and what its kind closes."""
        while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] in INLINE and not self.stack[-1][1]):
            self._pop()
        if tag == "body" and self.open["head"]:
            self._close("head")
        within = CLOSED_BY_SAME.get(tag)
        if within and self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in within:
                    break
                if self.stack[i][0] == tag:
                    while len(self.stack) > i:
                        self._pop()
                    break

    def _close(self, tag: str) -> None:
        while self.open[tag] and self.stack:
            last = self.stack[-1][0]
            self._pop()
            if last == tag:
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
        elif self.line is not None:
            self.line.tags += 1
        self.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        rejected, region, linked = self._state()
        if self.line is None:
            if not data.strip():
                return
            heading = any(e[0] in HEADINGS for e in self.stack[-3:])
            self.line = Line(region, rejected, heading, tags=min(1, self.tags))
        line = self.line
        if rejected and not line.rejected:      # a rejected inline element inside a line
            return
        if line.rejected and not rejected:
            self._end_line()
            return self.handle_data(data)
        line.text.append(data)
        if linked:
            line.linked += len(data)


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside links over tags; rejected lines have 0."""
    return np.array([0.0 if x.rejected else max(0, sum(map(len, x.text)) - x.linked) / max(1, x.tags) for x in lines])


def smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's part inside is normalised."""
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-at ** 2 / (2 * SIGMA ** 2))
    weight = np.convolve(np.ones(len(values)), kernel)[RADIUS:RADIUS + len(values)]
    return np.convolve(values, kernel)[RADIUS:RADIUS + len(values)] / weight


def content_lines(parsed: Lines) -> list[int]:
    """Lines of the selected region, in page order."""
    lines, regions = parsed.lines, parsed.regions
    able = [not x.rejected for x in lines]
    article = [regions[x.region].article for x in lines]
    named = any(a and r >= 0 for a, r in zip(able, article))
    if named:                                    # the markup names articles: only they can be content
        able = [a and r >= 0 for a, r in zip(able, article)]
    if not any(able):
        return []
    ratio = np.where(able, ratios(lines), 0.0)
    smoothed = smooth(ratio)
    able = np.array(able)
    hit = able & (ratio > 0) & (smoothed >= smoothed.std())
    if not hit.any():
        hit = able & (ratio > 0) if (ratio > 0).any() else able
    if named:
        chosen = {r for r, h in zip(article, hit) if h}
        return [i for i, a in enumerate(able) if a and article[i] in chosen]
    mass = np.where(hit, [sum(map(len, x.text)) for x in lines], 0)
    # no article: the narrowest region that still holds most of the content
    held = np.zeros(len(regions), np.int64)
    for x, m in zip(lines, mass):
        held[x.region] += m
    for r in range(len(regions) - 1, 0, -1):     # regions stand after those around them
        held[regions[r].above] += held[r]
    best, share = 0, SUBTREE_SHARE * held[0]
    for r in range(1, len(regions)):
        if regions[r].above == best and held[r] >= share:
            best = r
    inside = np.zeros(len(regions), bool)
    inside[best] = True
    for r in range(best + 1, len(regions)):
        inside[r] = inside[regions[r].above] if regions[r].above >= best else False
    own = able & inside[[x.region for x in lines]]
    hits = np.flatnonzero(hit & own)
    first, last = hits[0], hits[-1]
    if regions[best].tag not in ("", "body"):
        ends = np.flatnonzero(own)
        first, last = ends[0], ends[-1]
    while first > 0 and able[first - 1] and lines[first - 1].heading:
        first -= 1
    mostly_links = np.array([x.linked > LINK_SHARE * sum(map(len, x.text)) for x in lines], bool)
    place = np.arange(len(lines))
    return np.flatnonzero(able & (place >= first) & (place <= last) & (hit | ~mostly_links)).tolist()


def main_text(html: str | None) -> str:
    """The main text of one page: a block's white space as one space, blocks joined by a newline."""
    parsed = Lines()
    parsed.feed(html or "")
    parsed.close()
    parsed._end_line()
    blocks = (" ".join("".join(parsed.lines[i].text).split()) for i in content_lines(parsed))
    return "\n".join(b for b in blocks if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            texts = pa.array([main_text(h) for h in part["html"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part["row"], texts], ["row", "text"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``row, text``: every page with its main text; ``row`` is a struct of its other columns.

    A null or empty html, or one without main text, gives an empty text.
    Where the markup names articles, their lines are the candidates; else the
    narrowest region with most of the content is taken, from its first to its
    last line.  Whole pages are parsed, nothing is cut; unclosed, misnested
    and unknown elements are allowed.  Repeated rows and nulls in other
    columns stay; columns of any name are carried in ``row``; an empty table
    gives none.
    """
    other = [c for c in pages.columns if c != html_col]
    rows = pages.select(F.struct(*other).alias("row"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"row {rows.schema['row'].dataType.simpleString()}, text string")
