"""Main text of web pages by the text-to-tag ratio of lines.

The standard library's streaming parser turns a page into lines, one per block
element.  A line's ratio is its text length over its number of tags.  Ratios are
smoothed with a Gaussian and split into two clusters; the lines above the threshold
mark the content regions.  The content is the smallest element that holds all of
those regions, whatever its tag, and all of its lines: short paragraphs of an
article stay, however low their ratio.

What an element is called is evidence, not a verdict.  Menus, forms, footers and the
like by tag, and hidden elements, have ratio 0 and are no content.  A class, id or role
that names page furniture lowers a line's ratio to a tenth.  Such lines go only where the
clusters agree: where they mark lines without such a name, or where the named
element lies inside the region; a page whose region lies in a named element keeps it.
Boxes of one line at the top level of the page (an advert, a copyright line) are no
region of their own beside an element that holds most of the marked text.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
FEED_CHARS = 1 << 20
# Elements without readable text, page furniture, block elements, elements without content.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select "
                   "textarea datalist button".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
                   "ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_LEAF = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr caption hr summary legend figcaption".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead toolbar pager pagination "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social related recommended comment comments commentlist disqus reply replies respond "
    "contentinfo complementary".split())
# Words that go with those in a compound name (site-footer, share-buttons).
CARRIERS = frozenset("site page main top bottom left right global primary secondary post article entry box bar list links "
                     "buttons container wrapper section area block widget form item items text policy".split())
LOWERED = 0.1
_NAME = re.compile(r"[A-Za-z]+")


def _named_furniture(attrs: list) -> bool:
    """Does a class, id or role name page furniture: every part of the name a known one, and one of them furniture?"""
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.split():
                parts = [p.lower() for p in _NAME.findall(name)]
                title = parts[-1:] == ["header"] and parts[0] in ("post", "article", "entry")
                if (not title and any(p in FURNITURE_NAMES for p in parts)
                        and all(p in FURNITURE_NAMES or p in CARRIERS for p in parts)):
                    return True
    return False


def _hidden(attrs: list) -> bool:
    return any(key == "hidden" or key == "aria-hidden" and value == "true"
               or key == "style" and value and "display:none" in value.replace(" ", "").lower() for key, value in attrs)


class Lines(HTMLParser):
    """Lines of a page as (text, tags, furniture by tag?, path of enclosing block elements); ``named`` are those
    elements that a class, id or role calls furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, tuple]] = []
        self.stack: list[tuple[str, int, bool]] = []  # open elements that matter: tag, number, furniture?
        self.made = 0
        self.named: set[int] = set()
        self.text: list[str] = []
        self.tags = 0
        self.silent: list[str] = []

    def updatepos(self, i: int, j: int) -> int:  # line numbers of tags are not used
        return j

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            furniture = any(f for _, _, f in self.stack)
            self.lines.append((text, self.tags, furniture, tuple(n for _, n, _ in self.stack)))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            elif tag == "body" and self.silent == ["head"]:  # a head that was never closed
                self.silent = []
            else:
                return
            if self.silent:
                return
        if tag in SILENT:
            self.silent.append(tag)
            return
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag in VOID:
            return
        page = tag in ("html", "body")
        furniture = not page and (tag in FURNITURE or _hidden(attrs))
        named = not page and tag not in ("article", "main") and _named_furniture(attrs)
        if not page and tag in BLOCKS and tag not in INLINE_LEAF or furniture or named:
            self.made += 1
            if named:
                self.named.add(self.made)
            self.stack.append((tag, self.made, furniture))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in SILENT:
            if tag in VOID:
                self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag):]
            return
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag not in BLOCKS:
                    self.flush()
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


def page_lines(html: str) -> tuple[list, set[int]]:
    """The lines of a page and the numbers of its elements that are named like furniture."""
    parser = Lines()
    for i in range(0, len(html), FEED_CHARS):
        parser.feed(html[i:i + FEED_CHARS])
    parser.close()
    parser.flush()
    return parser.lines, parser.named


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over the neighbouring lines, with weights that sum to one at the edges too."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    up = np.convolve(values, kernel)[reach:reach + len(values)]
    return up / np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters of the values."""
    low, high = float(values.min()), float(values.max())
    while True:
        cut = (low + high) / 2
        above = values > cut
        if above.all() or not above.any():
            return cut
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            return cut
        low, high = new


def region(marked: list[tuple[str, tuple]], lines_of: Counter) -> tuple:
    """Path of the smallest element with all marked (text, path) lines, but for one-line boxes at the page's top level."""
    holds = os.path.commonprefix([p for _, p in marked])
    if holds or not all(p for _, p in marked):
        return holds
    share: Counter = Counter()
    for text, p in marked:
        share[p[0]] += len(text)
    best = max(share, key=share.get)
    if 2 * share[best] > share.total() and all(k == best or lines_of[k] == 1 for k in share):
        return os.path.commonprefix([p for _, p in marked if p[0] == best])
    return ()


def main_text(html: str | None) -> str:
    """Blocks of the main content of a page, joined by an empty line; empty if there are none."""
    lines, names = page_lines(html or "")
    if not any(t and not f for t, _, f, _ in lines):
        return ""
    named = np.array([not names.isdisjoint(p) for *_, p in lines])
    ratio = np.array([0.0 if f else len(t) / max(n, 1) for t, n, f, _ in lines]) * np.where(named, LOWERED, 1.0)
    even = smoothed(ratio)
    cut = threshold(even) if even.max() > even.min() else 0.0
    # a short line that only its neighbours lift stays if the region holds it, but does not widen the region
    marked = [(t, p, low) for (t, _, f, p), low, on in zip(lines, named, (even > cut) & (ratio > cut), strict=True)
              if on and t and not f]
    plain = [(t, p) for t, p, low in marked if not low]
    lines_of = Counter(k for t, _, f, p in lines if t and not f for k in p)
    holds = region(plain or [(t, p) for t, p, _ in marked], lines_of)
    return "\n\n".join(t for t, _, f, p in lines
                       if t and not f and p[:len(holds)] == holds and names.isdisjoint(p[len(holds):]))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text, the main content of each page.

    Defined results: the empty text for a null or empty page or one without content;
    equal pages have equal texts.  A column of the input named text is replaced.
    """
    @F.pandas_udf("string")
    def content(values: pd.Series) -> pd.Series:
        return pd.Series([main_text(v) for v in values], dtype="object")

    pages = pages.drop(*[c for c in pages.columns if c.lower() == "text" and c != html])
    return pages.withColumn("text", content(F.col(html)))
