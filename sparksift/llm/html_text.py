"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block elements and line breaks end a line. Text in an element
that is never content (``SKIP``, or a class, id or role that says so, or hidden) makes no line. A line knows its
characters, those of them in links, its tags, its block and the innermost container around it.

Lines' ratios of characters to tags are smoothed with a Gaussian along the page; lines at or above the threshold
(a share of the smoothed ratios' standard deviation) are content, and runs of them are the page's clusters. The
article is the innermost container with ``SHARE`` of the clusters' characters. Of its lines those in a cluster are
text, and outside clusters those that are no menu (two or more lines in a row that are mostly links); where the
article is the page itself or its body, lines before the first and after the last cluster go too, unless they are
headings or paragraphs. Without a cluster (a threshold above all ratios) there is no text.

A null or empty page gives an empty text; a page without any container is one container itself. Tags left
open end with their container; an end tag without a start is ignored. Ties between containers go to the innermost.
Time and memory are linear in the page, however deep its elements lie or however many end tags match nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select option textarea input label menu dialog head title".split())
#: Their start tags have no end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HOLDERS = frozenset("article main section div td body".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
SHARE = 0.6


@dataclass(slots=True)
class Line:
    text: str
    linked: int
    tags: int
    block: str
    holder: int


class Lines(HTMLParser):
    """Lines of a page, and each container's parent and tag (0: the page)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parent, self.kind = [0], [""]
        self.open: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, noise, container
        self.held = Counter()  # open holders, by tag
        self.scopes = [Counter()]  # open elements since each open holder, by tag
        self.text: list[str] = []
        self.block, self.tags, self.linked = "", 0, 0

    def _end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.linked, max(1, self.tags), self.block, self.open[-1][2]))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_line()
            if tag != "br":
                self.block = tag
                if self.scopes[-1]["p"]:
                    self._close("p")
        self.tags += 1
        if tag in VOID:
            return
        _, noise, holder = self.open[-1]
        if not noise:
            about = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and HIDDEN.search(v or "") for k, v in attrs)
            noise = tag in SKIP or hidden or (tag not in ("body", "html", "article", "main") and bool(NOISE.search(about)))
        if tag in HOLDERS:
            if not noise and not self.held["article"]:  # an article is not looked into
                self.parent.append(holder)
                self.kind.append(tag)
                holder = len(self.parent) - 1
            self.held[tag] += 1
            self.scopes.append(Counter())
        else:
            self.scopes[-1][tag] += 1
        self.open.append((tag, noise, holder))

    def _close(self, tag: str) -> None:
        """Ends the innermost open ``tag`` with all in it; other elements do not end beyond their container."""
        if not (self.held if tag in HOLDERS else self.scopes[-1])[tag]:
            return
        while True:
            last = self.open.pop()[0]
            if last in HOLDERS:
                self.held[last] -= 1
                self.scopes.pop()
            else:
                self.scopes[-1][last] -= 1
            if last == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][1]:
            self.text.append(data)
            if self.scopes[-1]["a"]:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(x: np.ndarray, radius: int = 2) -> np.ndarray:
    """A Gaussian average along a page's lines; the ends are repeated."""
    w = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * max(radius / 2, 0.5) ** 2))
    return np.convolve(np.pad(x, radius, mode="edge"), w / w.sum(), "valid")


def clusters(lines: list[Line], threshold: float) -> np.ndarray:
    """Which lines lie in a cluster: a smoothed ratio of characters to tags of ``threshold`` standard deviations or more."""
    ratio = smoothed(np.array([len(x.text) / x.tags for x in lines]))
    return ratio >= threshold * ratio.std()


def article(lines: list[Line], parent: list[int], content: np.ndarray) -> tuple[int, int]:
    """The innermost container with ``SHARE`` of the content's characters, and the last one within it (containers are numbered from the outermost on)."""
    weight, last = [0] * len(parent), list(range(len(parent)))
    for x, yes in zip(lines, content.tolist(), strict=True):
        weight[x.holder] += len(x.text) * yes
    for h in range(len(parent) - 1, 0, -1):
        weight[parent[h]] += weight[h]
        last[parent[h]] = max(last[parent[h]], last[h])
    best = max(h for h, w in enumerate(weight) if w >= SHARE * weight[0])
    return best, last[best]


def _menus(linked: np.ndarray) -> np.ndarray:
    """Lines in runs of two or more."""
    pad = np.pad(linked, 1)
    return linked & (pad[:-2] | pad[2:])


def main_text(html: str | None, threshold: float = 0.5) -> str:
    """The lines of a page's article, joined by a line feed."""
    page = Lines()
    page.feed(html or "")
    page.close()
    lines = page.lines
    if not lines:
        return ""
    content = clusters(lines, threshold)
    if not content.any():
        return ""
    first, last = article(lines, page.parent, content)
    mine = np.array([first <= x.holder <= last for x in lines])
    menu = _menus(~content & [2 * x.linked > len(x.text) for x in lines])
    keep = mine & ~menu
    inside = np.flatnonzero(mine & content)
    if page.kind[first] in ("", "body") and len(inside):  # nothing but the clusters tells where the article begins and ends
        place = np.arange(len(lines))
        told = [x.block == "p" or x.block in HEADINGS for x in lines]
        keep &= ((place >= inside[0]) & (place <= inside[-1])) | told
    return "\n".join(x.text for x, yes in zip(lines, keep, strict=True) if yes)


def extract(pages: DataFrame, *, html: str = "html", keep: list[str] | None = None, output: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep`` columns (all but the html, if None) and ``output``, the main text."""
    names = [c for c in (pages.columns if keep is None else keep) if c not in (html, output)]

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: main_text(x, threshold))

    return pages.select(*names, run(F.coalesce(F.col(html).cast("string"), F.lit(""))).alias(output))
