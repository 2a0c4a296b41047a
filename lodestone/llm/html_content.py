"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events.  Block-level tags, line breaks and
newlines of the source end a line; for each line the characters of text and the
tags are counted.  The ratios of characters to tags are smoothed over
neighbouring lines with a Gaussian.  A threshold, a share of the standard
deviation of the page's smoothed ratios, parts the lines into content and the
rest; runs of content lines, joined over gaps of up to GAP lines, are regions, and
a region is selected if its own ratio, all its characters to all its tags, is
above the threshold too.

Contents of script, style, title, noscript, template and svg aren't text.  An
element of the last four that is never closed hides nothing.  Tags that HTML lets
authors leave out, such as </head> and <body>, aren't needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .cluster import need

SIGMA, SHARE, GAP = 1.0, 0.5, 1
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CODE = frozenset(("script", "style"))
SKIPPED = CODE | frozenset("noscript template svg title".split())
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Collects lines: text pieces and tags.

    What is inside of a skipped element is collected too, and given up when the
    element is closed, so an element without its end tag loses no text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.piece: list[str] = []
        self.n = 0
        self.skip: list[tuple[str, int, list[str], int]] = []

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.piece)).strip() if self.piece else ""
        if text or self.n:
            self.texts.append(text)
            self.tags.append(self.n)
        self.piece, self.n = [], 0

    def _give_up(self) -> str:
        tag, lines, self.piece, self.n = self.skip.pop()
        del self.texts[lines:], self.tags[lines:]
        return tag

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.skip and self.skip[0][0] == "title":
            self.skip = []  # a title is over where the body begins
        if tag not in INLINE:
            self.end_line()
        self.n += 1
        if tag in SKIPPED:
            self.skip.append((tag, len(self.texts), self.piece[:], self.n))

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.end_line()
        self.n += 1

    def handle_endtag(self, tag):
        if any(tag == s[0] for s in self.skip):
            while self._give_up() != tag:
                pass
        self.n += 1
        if tag not in INLINE:
            self.end_line()

    def handle_data(self, data):
        first, *rest = data.split("\n")
        self.piece.append(first)
        for line in rest:
            self.end_line()
            self.piece.append(line)

    def over(self) -> None:
        """The page's end: what is left open is text, but for code."""
        while any(s[0] in CODE for s in self.skip):
            self._give_up()
        self.end_line()


def lines_of(html: str) -> tuple[list[str], np.ndarray]:
    """The page's lines, and the tags in each."""
    p = _Lines()
    p.feed(html)
    p.close()
    p.over()
    return p.texts, np.array(p.tags, np.float64)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean of neighbours; at the ends, of those that there are."""
    if not len(x) or sigma <= 0:
        return x
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    full = lambda y: np.convolve(y, k)[r : r + len(y)]
    return full(x) / full(np.ones(len(x)))


def regions(chars: np.ndarray, tags: np.ndarray, sigma: float = SIGMA, share: float = SHARE, gap: int = GAP) -> list[tuple[int, int]]:
    """Content regions of a page's lines, as (first, end)."""
    ratio = chars / np.maximum(tags, 1)
    s = smoothed(ratio, sigma)
    if not len(s) or s.max() <= 0:
        return []
    level = share * s.std()
    over = np.flatnonzero(s >= level)
    cut = np.flatnonzero(np.diff(over) > gap + 1)
    runs = zip(over[np.append(0, cut + 1)].tolist(), (over[np.append(cut, len(over) - 1)] + 1).tolist())
    return [(a, b) for a, b in runs if (n := chars[a:b].sum()) and n / max(1, tags[a:b].sum()) >= level]


def content(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> tuple[str, int, int]:
    """The content text, its lines joined by newlines; the lines of the page, and those that are content."""
    if not html:
        return "", 0, 0
    texts, tags = lines_of(html)
    if not texts:
        return "", 0, 0
    chosen = [t for a, b in regions(np.array([len(t) for t in texts]), tags, sigma, share) for t in texts[a:b] if t]
    return "\n".join(chosen), len(texts), len(chosen)


def _pages(sigma: float, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "html"):
                rows = [content(x, sigma, share) for x in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["page_id", "url", "text", "n_lines", "n_content_lines"])

    return run


def extract(pages: DataFrame, sigma: float = SIGMA, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_lines, n_content_lines: one row for each row of pages, without a shuffle.

    pages: page_id, url, html; other columns aren't used.  A null or empty page,
    and one without text, has the text ''.  On a page whose lines all have the
    same ratio all are content.  Null and repeated ids are kept as they are.
    """
    need(pages, "page_id", "url", "html")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(_pages(sigma, share), "page_id bigint, url string, text string, n_lines int, n_content_lines int")
