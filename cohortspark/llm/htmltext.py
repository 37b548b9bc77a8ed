"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that start and end a block; elements whose content is never text of the article;
# elements without content; words of class, id and role that mark what stands beside an article.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("applet audio button canvas datalist embed head iframe input map meter noscript object option progress script select style svg template textarea title video".split())
BESIDE = frozenset("aside dialog footer form menu nav".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus dialog footer footnav form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar toc widget widgets replies reply respond".split())
# Words that say nothing in a class name beside a mark, and those that turn one round ("no-sidebar", "has-menu").
NEUTRAL = frozenset("site page main top bottom left right global primary secondary wrapper wrap container area bar box block list section inner outer links link buttons button icons icon items item post posts article articles panel column col row group slot space zone label small large fixed sticky".split())
NEGATING = frozenset("no not non without with has have is show hide".split())
ROLES = frozenset("banner navigation complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset(["article", "main"])
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Elements that can be the region of an article, if they hold blocks of their own.
CONTAINERS = frozenset("article body center div html main section td".split())
# What an open element of the key is closed by when it meets such a start tag.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that wall off the siblings of others.
HOLDERS = ("ul", "ol", "dl", "table", "select", "tbody", "thead")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
#: Evidence that an element is no part of the article.
NONE, WEAK, STRONG, HIDDEN = range(4)


def _named(value: str) -> int:
    """What a class or id says: all of a name is marks and neutral words, a part of it is a mark, or nothing."""
    found = NONE
    for name in value.split():
        parts = _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if MARKS.isdisjoint(parts) or not NEGATING.isdisjoint(parts):
            continue
        found = max(found, STRONG if set(parts) <= MARKS | NEUTRAL else WEAK)
    return found


class _Blocks(HTMLParser):
    """Blocks in page order: text, tags met in it, its letters in links, and the open elements around it.

    Only what is never text (scripts, styles, form controls, hidden elements) is left out here; what stands beside an
    article is kept with its evidence.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # element, its number, whether text in it is left out
        self.where: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
        self.around: list[int] = []  # places in the stack of open blocks
        self.sections = True  # whether a CDATA section may end in what is still to come
        self.parent: list[int] = [-1]
        self.kind: list[str] = ["#root"]
        self.evidence: list[int] = [NONE]
        self.holds: set[int] = {0}  # elements with blocks of their own
        self.blocks: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.out = 0

    def _cut(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((text, self.tags, self.linked, self.stack[-1][1] if self.stack else 0))
                self.tags = 0
            self.parts, self.linked = [], 0

    def _marked(self, tag: str, attrs: list) -> int:
        if tag in NEVER:
            return HIDDEN
        inside = any(self.where.get(c) for c in CONTENT)
        found = STRONG if tag in BESIDE or (tag == "header" and not inside) else NONE
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return HIDDEN
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return HIDDEN
            if name == "role" and (value or "").lower() in ROLES:
                found = STRONG
            if name in ("class", "id") and value and tag not in ("html", "body", "article", "main") and not (inside and value.lower() == "header"):
                found = max(found, _named(value))
        return found

    def _last(self, names: Iterable[str]) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def _pop(self, at: int) -> None:
        for tag, _, out in reversed(self.stack[at:]):
            self.out -= out
            self.links -= tag == "a"
            self.where[tag].pop()
            if tag in BLOCKS:
                self.around.pop()
        del self.stack[at:]

    def _implied(self, tag: str) -> None:
        """End what a start tag ends by itself: a paragraph with no block in it, or the sibling of the same list or table."""
        if tag in CLOSES_P:
            at, wall = self._last(["p"]), self.around[-1] if self.around else -1
        elif tag in SIBLINGS:
            at, wall = self._last(SIBLINGS[tag]), self._last(["table"] if tag == "tr" else HOLDERS)
        else:
            return
        if at >= 0 and at >= wall:
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._cut()
            self._implied(tag)
            if tag not in VOID and self.stack:
                self.holds.add(self.stack[-1][1])
        self.tags += 1
        if tag not in VOID:
            evidence = self._marked(tag, attrs)
            if evidence:
                self._cut()
            self.parent.append(self.stack[-1][1] if self.stack else 0)
            self.kind.append(tag)
            self.evidence.append(evidence)
            self.where.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCKS:
                self.around.append(len(self.stack))
            self.stack.append((tag, len(self.kind) - 1, evidence == HIDDEN))
            self.out += evidence == HIDDEN
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "article", "main", "body", "html", "section"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._cut()
        self.tags += 1
        if (at := self._last([tag])) >= 0:
            if self.stack[at][2]:
                self.parts = []
            elif self.evidence[self.stack[at][1]]:
                self._cut()
            self._pop(at)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A CDATA section ends with its own mark, any other at the next ">", as in browsers; none stops the parser."""
        self.sections = self.sections and self.rawdata.find("]]>", i) >= 0
        if self.sections and self.rawdata[i : i + 9].upper() == "<![CDATA[":
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, 0)

    def handle_data(self, data: str) -> None:
        if self.out:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    padded = np.pad(x, r, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _masses(p: _Blocks, value: np.ndarray) -> np.ndarray:
    """The sum of a value of blocks over each element and what is in it."""
    out = np.zeros(len(p.kind))
    for b, v in zip(p.blocks, value):
        out[b[3]] += v
    for at in range(len(p.kind) - 1, 0, -1):  # children have greater numbers
        out[p.parent[at]] += out[at]
    return out


def _excluded(p: _Blocks, free: np.ndarray, ratio: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which elements are left out with all in them.

    Strong evidence holds unless the element has an article or main element, or the larger part of the page's text
    outside links and no article stands beside it (a wrapper with a telling name, an element never closed). Weak evidence holds only where
    the text-to-tag ratio says the same: most of its text is in lines below the threshold.
    """
    mass, low = _masses(p, free), _masses(p, np.where(high, 0.0, free))
    has = np.zeros(len(p.kind), bool)
    for at in range(len(p.kind) - 1, 0, -1):
        has[p.parent[at]] |= has[at] or p.kind[at] in CONTENT
    within = np.zeros(len(p.kind), bool)
    for at in range(1, len(p.kind)):
        within[at] = within[p.parent[at]] or p.kind[at] in CONTENT
    written = any(p.kind[at] in CONTENT and mass[at] > 0 for at in range(len(p.kind)))
    evidence = np.array(p.evidence)
    out = (evidence == STRONG) & ~has & ((mass <= 0.5 * mass[0]) | (written & ~within))
    out |= (evidence == WEAK) & ~has & (low > 0.5 * mass)
    for at in range(1, len(p.kind)):
        out[at] |= out[p.parent[at]]
    return out


def _closable(html: str) -> str:
    """``html`` with marks that nothing after them can close as text, which is what the parser makes of them one by one."""
    tail = html.rfind(">") + 1
    html = html[:tail] + html[tail:].replace("<", "&lt;")
    tail = max(html.rfind("-->"), html.rfind("--!>"), 0)
    return html[:tail] + html[tail:].replace("<!--", "&lt;!--")


def extract(html: str | None, sigma: float = 1.0) -> str:
    """The article's text: blocks in page order, joined by one space; empty for null.

    Each block is a line with a ratio of letters outside links to tags. The ratios are smoothed over neighbouring
    lines; lines above a threshold (half their spread) are content. What names itself navigation, advert, form,
    comment and the like is left out on the terms of ``_excluded``. The region is the smallest container that holds
    all other content lines (a paragraph or another leaf is none), an article or main element if one is around it or a
    single one inside; all its blocks are kept, short ones too. Of a menu that was never closed, lines that are links
    only and come before the first content line are left out.
    """
    if not html:
        return ""
    p = _Blocks()
    p.feed(_closable(html))
    p.close()
    p._cut()
    if not p.blocks:
        return ""
    size = np.array([len(b[0]) for b in p.blocks], float)
    free = np.maximum(size - [b[2] for b in p.blocks], 0.0)
    ratio = _smooth(free / np.array([b[1] + 1 for b in p.blocks]), sigma)
    high = ratio >= 0.5 * ratio.std()
    gone = _excluded(p, free, ratio, high)
    kept = np.array([not gone[b[3]] for b in p.blocks])
    content = high & kept
    if not content.any():
        content = kept
    if not kept.any():
        return ""
    weight = _masses(p, np.where(content, size, 0.0))
    region, best = 0, 0
    for at in range(1, len(p.kind)):
        if weight[at] >= weight[0]:
            region = at  # later elements of those that hold all are deeper
    while region and not (p.kind[region] in CONTAINERS and region in p.holds):
        region = p.parent[region]
    at = region
    while at > 0:
        if p.kind[at] in CONTENT:
            best = at
        at = p.parent[at]
    if not best:
        named = [i for i in range(1, len(p.kind)) if p.kind[i] in CONTENT and weight[i] > 0.4 * weight[0] and not any(p.kind[j] in CONTENT for j in _up(p.parent, i))]
        best = named[0] if len(named) == 1 else region
    inside = [best == 0] * len(p.kind)
    for at in range(1, len(p.kind)):
        inside[at] = inside[at] or at == best or inside[p.parent[at]]
    menu = [False] * len(p.kind)  # in a menu that evidence did not exclude
    for at in range(1, len(p.kind)):
        menu[at] = menu[p.parent[at]] or (p.kind[at] in ("nav", "menu") and not gone[at])
    first = int(np.argmax(content))
    out = []
    for i, b in enumerate(p.blocks):
        if inside[b[3]] and kept[i] and not (menu[b[3]] and i < first and free[i] == 0):
            out.append(b[0])
    return " ".join(out)


def _up(parent: list[int], at: int) -> Iterator[int]:
    while (at := parent[at]) > 0:
        yield at


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html), from its whole html.

    Null and empty html have an empty text; rows may repeat ids. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
