"""Main text of web pages: text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A streaming parser turns a page into lines, one per block of running text, each
with its text length, its number of tags and its innermost element. Lines
in elements that never hold the article (menus, headers and footers of the
page, asides, forms, adverts, notices, comments, scripts) are boilerplate by
kind; a class word that may as well be a topic, or is only part of a name, counts
where the element is sparse, and never where it wraps the dense text. The smoothed ratio of text to tags splits the others in two clusters; lines
of running text are dense however long the longest line is. The smallest
container of all dense lines is the content region, and every line of it that is
not boilerplate by kind belongs to the text. Where article and main elements hold
most of the dense text, the dense lines outside them do not widen the region.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from barcast.llm.common import row_map

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas audio video math".split())
BOILERPLATE = frozenset("nav footer aside form button select textarea input label menu dialog fieldset search".split())
CLOSES_P = BLOCKS - {"br", "option", "head", "html", "body"}
# Words of class, id and role names that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs footer header masthead sidebar aside complementary contentinfo related recommended comment comments commentlist disqus "
    "replies respond cookie cookies consent notice notices notification alert gdpr popup modal overlay newsletter subscribe signup login "
    "share sharing social toolbar pagination pager form search skip".split()
)
# Marks that are topics of articles too.
TOPICS = frozenset("form search related header skip social sharing promotion navigation menu login".split())
COMMENTS = frozenset("comment comments".split())
KEEPS = frozenset({"article", "main", "body", "html"})  # a mark on these does not make them boilerplate
SIGMA = 1.0
RUNNING = 40.0  # characters a tag from which a line is running text, whatever the other lines are
WRAPS = 0.9  # share of the dense text from which an element is a wrapper


@dataclass
class Line:
    text: str
    tags: int
    element: int  # the innermost open one, -1 outside all
    plain: bool  # not boilerplate by kind
    inside: bool  # of an article or main element


def _names(attrs: list[tuple[str, str | None]]) -> tuple[set[str], set[str]]:
    """Whole class, id and role names, and the words they are made of."""
    values = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
    if not values:
        return set(), set()
    return set(values.lower().split()), set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", values).lower()))


class Lines(HTMLParser):
    """Collects the lines of a page from parser events.

    Elements are numbered as they open, so those within an element are the
    numbers from its own to its ``last``. Open elements are kept by name and
    counted by kind, so an event takes the same time at any depth.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.names: list[str] = []
        self.above: list[int] = []  # the element around each
        self.last: dict[int, int] = {}
        self.marked: dict[int, bool] = {}  # elements with a doubtful mark; true where density decides
        self.open: list[tuple[int, bool, bool]] = []  # number, hidden, boilerplate
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # places of open elements, by name
        self.blocks: list[int] = []  # places of open blocks
        self.hidden = self.boilerplate = self.inside = 0  # open elements of each kind
        self.parts: list[str] = []
        self.tags = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            element = self.open[-1][0] if self.open else -1
            self.lines.append(Line(text, self.tags, element, not self.boilerplate, self.inside > 0))
            self.tags = 0
        self.parts = []

    def _push(self, tag: str, hidden: bool, boilerplate: bool) -> None:
        self.above.append(self.open[-1][0] if self.open else -1)
        self.places[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((len(self.names), hidden, boilerplate))
        self.names.append(tag)
        self._count(tag, hidden, boilerplate, 1)

    def _count(self, tag: str, hidden: bool, boilerplate: bool, step: int) -> None:
        self.hidden += step * hidden
        self.boilerplate += step * boilerplate
        self.inside += step * (tag in ("article", "main"))

    def _close_to(self, at: int) -> None:
        while len(self.open) > at:
            number, hidden, boilerplate = self.open.pop()
            tag = self.names[number]
            self.last[number] = len(self.names) - 1
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self._count(tag, hidden, boilerplate, -1)

    def _top(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _implied_ends(self, tag: str) -> None:
        """Elements that an opening tag ends without an end tag."""
        if tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
            ends = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,))
            stop = self._top({"li": ("ul", "ol", "menu"), "tr": ("table",), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("tr", "table")))
        elif tag in CLOSES_P:
            ends, stop = ("p",), self.blocks[-1] - 1 if self.blocks else -1
        else:
            return
        at = self._top(ends)
        if at > stop:
            self._close_to(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            self._implied_ends(tag)
        self.tags += 1
        if tag in VOID:
            return
        hidden = tag in HIDDEN or any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        # a header within the article holds its headline
        boilerplate = tag in BOILERPLATE or (tag == "header" and not self.inside)
        whole, words = _names(attrs)
        marks = words & MARKS
        doubtful = False
        if marks and tag in KEEPS:
            boilerplate |= tag == "article" and bool(whole & COMMENTS)
        elif marks and not boilerplate and not (self.inside and marks <= {"header"}):
            boilerplate = bool((whole & MARKS) - TOPICS)
            doubtful = not boilerplate and (block or not self.inside)
        if doubtful:
            self.marked[len(self.names)] = bool(self.inside) or marks <= TOPICS
        if (boilerplate or doubtful) and not block:
            self._flush()
        self._push(tag, hidden, boilerplate)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self._top((tag,))
        if tag in BLOCKS or (at >= 0 and (self.open[at][2] or self.open[at][0] in self.marked)):
            self._flush()
        if at < 0:
            return
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > at:
            return  # an inline end tag does not end the blocks within
        self._close_to(at)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)

    def finish(self) -> list[Line]:
        self.close()
        self._flush()
        self._close_to(0)
        return self.lines

    def without_marked(self) -> list[Line]:
        """The lines that are not boilerplate by kind, with the doubtful marks decided."""
        lines = [line for line in self.lines if line.plain]
        if not lines or not self.marked:
            return lines
        elements = np.array([line.element for line in lines])
        order = np.argsort(elements, kind="stable")
        lengths = np.array([len(line.text) for line in lines], dtype=float)[order]
        tags = np.array([line.tags for line in lines], dtype=float)[order]
        running = np.where(_dense_lines(lines)[order], lengths, 0.0)
        sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (lengths, tags, running)]
        change = np.zeros(len(lines) + 1)
        for number, by_density in self.marked.items():
            low, high = np.searchsorted(elements, [number, self.last[number] + 1], sorter=order)
            text, marks, dense_text = (float(s[high] - s[low]) for s in sums)
            wrapper = 0 < WRAPS * float(sums[2][-1]) <= dense_text
            if not wrapper and not (by_density and text >= RUNNING * max(1.0, marks)):
                change[low] += 1
                change[high] -= 1
        gone = np.empty(len(lines), dtype=bool)
        gone[order] = np.cumsum(change[:-1]) > 0
        return [line for line, drop in zip(lines, gone) if not drop]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, with the ends repeated."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def dense(ratios: np.ndarray) -> np.ndarray:
    """Two clusters of the values: those at or above the threshold halfway between the cluster means."""
    threshold = ratios.mean()
    for _ in range(20):
        above = ratios >= threshold
        if above.all():
            break
        moved = (ratios[above].mean() + ratios[~above].mean()) / 2
        if abs(moved - threshold) < 1e-9:
            break
        threshold = moved
    return ratios >= threshold


def _dense_lines(lines: list[Line]) -> np.ndarray:
    lengths = np.array([len(line.text) for line in lines], dtype=float)
    ratios = smoothed(lengths / np.maximum(1, [line.tags for line in lines]))
    return dense(ratios) | (ratios >= RUNNING)


def extract(html: str | None) -> str:
    """Main text of a page: its blocks, one per line."""
    parser, page = Lines(), html or ""
    parser.feed(page + "-->" if page.rfind("<!--") > page.rfind("-->") else page)  # an open comment ends with the page
    parser.finish()
    plain = parser.without_marked()
    if not plain:
        return ""
    found = [line for line, is_dense in zip(plain, _dense_lines(plain)) if is_dense]
    marked = [line for line in found if line.inside]
    if sum(len(line.text) for line in marked) >= 0.6 * sum(len(line.text) for line in found):
        found = marked
    # the smallest container that holds all dense lines
    low, high = min(line.element for line in found), max(line.element for line in found)
    shared, at = [], low
    while at >= 0:
        if parser.last[at] >= high:
            shared.append(at)
        at = parser.above[at]
    named = [n for n in shared if parser.names[n] in ("article", "main")]
    boxes = [n for n in shared if parser.names[n] in BLOCKS and parser.names[n] not in ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "dt")]
    region = max(named or boxes, default=None)  # numbers grow inwards
    return "\n".join(line.text for line in plain if region is None or region <= line.element <= parser.last[region])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    A null or empty page, or one without any article text, has the empty text.
    Rows are independent: repeated rows and ids keep their rows, and other
    columns are ignored.
    """

    def start():
        def one(page_id, url, html):
            text = extract(html)
            return page_id, url, text, len(text)

        return one

    kind = pages.schema["page_id"].dataType.simpleString()
    return row_map(pages.select("page_id", "url", "html"), start, f"page_id {kind}, url string, text string, n_chars bigint")
