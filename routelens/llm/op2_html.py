"""Operator 2: main text of HTML pages by smoothed text-to-tag ratios.

The standard library's streaming parser gives events; block elements end a
line. Each line has a ratio of text characters to tags. The ratios, smoothed
with a Gaussian, are clustered by a threshold into content and the rest; lines
in menus, headers, footers, sidebars, notices, adverts, forms and comments (by
element, role or class) never count as content; but a class or id is not
believed if the content is under it (see ``_usable``), and a word in it that
follows "has", "no" and the like says nothing. The content lines choose the
region: the articles or the main element if all of them lie there, else the
smallest element (or the page) that holds them all. All lines of the region that aren't
boilerplate are the text, so short paragraphs between long ones stay.

Null and empty pages have empty text; a page without any content line too. A
null ``page_id`` and repeated rows pass through; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, texts_of

#: Width of the Gaussian over lines.
SIGMA = 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label link mark meta nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: In a table row, cells follow one another in one block.
SPACED = frozenset("td th br".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
DROPPED = frozenset("head title nav footer aside script style noscript template button select textarea iframe object svg canvas dialog menu audio video map".split())
REGIONS = frozenset("article main section div td body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table p span aside article figure header center".split())
WORDS_OF_BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
    sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification alert popup modal overlay
    newsletter subscribe subscription signup login register share sharing social related recommended recommendations comment comments commentlist
    disqus reply replies respond form search pagination pager toolbar widget skip copyright disclaimer""".split())
#: Words that say nothing more beside a word of boilerplate: a comment list is comments.
NEUTRAL_WORDS = frozenset("list body area section post item wrapper banner bar box".split())
#: A line outside a mark is text if it has this share of the mean length of the content lines under it.
SHARE_OUTSIDE = 0.2
HEADER_WORDS = frozenset("header masthead topbar".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
#: A word after one of these in a name says what the element has or lacks, not what it is.
MODIFIERS = frozenset("has have with without no not non".split())
_SPLIT = re.compile(r"[^a-z0-9]+").split
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Mark(NamedTuple):
    """What the class names and id of an element say: it may be boilerplate."""

    words: frozenset[str]                                       # of all its names, without the numbers in them
    whole: bool                                                 # a name has no other words than neutral ones
    header: bool                                                # only words of a header


FORM = _Mark(frozenset({"form"}), True, False)


@lru_cache(1 << 12)
def mark_of(names: str) -> _Mark | None:
    words, found, whole = set(), set(), False
    for name in names.split():
        parts = [w for w in _SPLIT(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
        own = [w for before, w in zip(["", *parts], parts, strict=False)
               if before not in MODIFIERS and (w in WORDS_OF_BOILERPLATE or w in HEADER_WORDS)]
        words.update(w.strip("0123456789") for w in parts)
        found.update(own)
        whole = whole or bool(own) and all(w in own or w in NEUTRAL_WORDS for w in parts)
    return _Mark(frozenset(words), whole, found <= HEADER_WORDS) if found else None


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, path of open regions, boilerplate by element or role, marks by class or id)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool, _Mark | None]] = []     # tag, number if a region, dropped, header, mark
        self.lines: list[tuple[str, int, tuple[int, ...], bool, frozenset[_Mark]]] = []
        self.regions: dict[int, str] = {0: ""}                  # the page itself is region 0
        self.text: list[str] = []
        self.tags, self.dropped, self.headers, self.articles, self.headings = 0, 0, 0, 0, 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i + 3)                     # <![...]> of any kind is markup
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open and tag not in HEAD_ONLY and any(x[0] == "head" for x in self.open):
            self._close_to("head")
        if tag in ("p", "li", "tr", "dt", "dd", "option") or tag not in INLINE and tag not in SPACED and tag not in VOID and self.open and self.open[-1][0] == "p":
            self._implied(tag)
        self._mark(tag)
        if tag in VOID:
            return
        dropped, header, mark = self._kind(tag, dict(attrs))
        number = 0
        if tag in REGIONS:
            number = len(self.regions)
            self.regions[number] = tag
        self.open.append((tag, number, dropped, header, mark))
        self.dropped += dropped
        self.headers += header
        self.articles += tag in ("article", "main")
        self.headings += tag in HEADINGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self._mark(tag)

    def handle_endtag(self, tag: str) -> None:
        self._mark(tag)
        if any(x[0] == tag for x in self.open):
            self._close_to(tag)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][0] in ("script", "style")):
            self.text.append(data)

    def finish(self) -> None:
        self.close()
        self._line()

    def _mark(self, tag: str) -> None:
        if tag in SPACED:
            self.text.append(" ")
        elif tag not in INLINE:
            self._line()
        self.tags += 1

    def _kind(self, tag: str, attrs: dict[str, str | None]) -> tuple[bool, bool, _Mark | None]:
        unseen = "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        if tag in DROPPED or unseen or (attrs.get("role") or "").lower() in DROPPED_ROLES:
            return True, False, None
        if tag == "form":                                       # pages of some kinds lie in one form
            return False, False, FORM
        named = tag in CONTAINERS and (attrs.get("class") or attrs.get("id"))
        return False, tag == "header", mark_of(f"{attrs.get('class') or ''} {attrs.get('id') or ''}") if named else None

    def _implied(self, tag: str) -> None:
        """A new p, li, ... ends an open one of its kind; a block ends an open p."""
        if tag in ("li", "tr", "dt", "dd", "option"):
            for name, *_ in reversed(self.open):
                if name == tag:
                    return self._close_to(tag)
                if name in ("ul", "ol", "table", "dl", "select"):
                    return
        else:
            for name, *_ in reversed(self.open):
                if name == "p":
                    return self._close_to("p")
                if name not in INLINE:
                    return

    def _close_to(self, tag: str) -> None:
        self._line()
        while self.open:
            name, _, dropped, header, _ = self.open.pop()
            self.dropped -= dropped
            self.headers -= header
            self.articles -= name in ("article", "main")
            self.headings -= name in HEADINGS
            if name == tag:
                return

    def _line(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            heading = self.headings and self.articles           # an article's own title, even in its header
            boilerplate = bool(self.dropped or self.headers and not heading)
            marks = frozenset(x[4] for x in self.open if x[4] and not (x[4].header and heading))
            self.lines.append((text, self.tags, (0, *(x[1] for x in self.open if x[1])), boilerplate, marks))
            self.tags = 0


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach:reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The border between two clusters: halfway between their means, until it stays."""
    border = (values.min() + values.max()) / 2
    for _ in range(100):
        low, high = values[values < border], values[values >= border]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else values.min()
        if abs(new - border) < 1e-9:
            break
        border = new
    return float(border)


def main_blocks(html: str) -> list[str]:
    """The blocks of the page's main text, in page order."""
    page = _Lines()
    page.feed(html)
    page.finish()
    open_ = np.array([not x[3] for x in page.lines], bool)
    if not open_.any():
        return []
    ratio = smoothed(np.array([len(x[0]) / max(1, x[1]) for x in page.lines]))
    usable, content = _usable(page, ratio, open_)
    inside = _region(page, np.flatnonzero(content).tolist())
    return [x[0] for x, u in zip(page.lines, usable, strict=True) if u and inside & set(x[2])]


def _content(ratio: np.ndarray, usable: np.ndarray) -> np.ndarray:
    return usable & (ratio >= threshold(ratio[usable])) if usable.any() else usable


def _usable(page: _Lines, ratio: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines that aren't boilerplate, and those of them that are content. A
    mark doesn't count if all content and every longer line lie under it, or most
    of the content where its names have other words too; if no line is left, no
    mark counts."""
    marks = [x[4] for x in page.lines]
    if not any(marks):
        return open_, _content(ratio, open_)
    size = np.array([len(x[0]) for x in page.lines])
    void: set[_Mark] = set()

    def without(ignored: set[_Mark], whole: bool) -> np.ndarray:
        return open_ & np.array([all(m in ignored or whole and not m.whole for m in own) for own in marks], bool)

    strict = without(void, False)
    for whole in (True, False):
        content = _content(ratio, without(void, True) if not whole else open_)
        total = size[content].sum()
        for mark in {m for own in marks for m in own if m.whole == whole}:
            under = np.array([mark in own for own in marks], bool)
            held = size[content & under]
            around = size[open_ & ~under]
            if total and (held.sum() == total and around.max(initial=0) < SHARE_OUTSIDE * held.mean() if whole else 2 * held.sum() > total):
                void.add(mark)
    usable = without(void, False)
    if not usable.any():
        return open_, _content(ratio, open_)
    return usable, _content(ratio, strict) | _content(ratio, usable)


def _region(page: _Lines, content: list[int]) -> set[int]:
    """Numbers of the regions that hold all of the content."""
    paths = [page.lines[i][2] for i in content]
    for tag in ("article", "main"):
        outer = {next((r for r in path if page.regions[r] == tag), 0) for path in paths}
        if 0 not in outer:
            return outer
    return {max(set.intersection(*map(set, paths)))}           # regions are numbered outside in


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(``keep`` columns, ``text``, ``n_chars``) for each row."""
    prepare(pages.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [f"{n} {pages.schema[k].dataType.simpleString()}" for n, k in zip(names, keep, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                text = ["\n\n".join(main_blocks(h)) if h else "" for h in texts_of(part.column("html"))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                    names=[*names, "text", "n_chars"])

    out = (pages.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.col(html_col).alias("html"))
           .mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"])))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], "text", "n_chars")
