"""Main text of web pages: text-to-tag ratios per line, smoothed and clustered, over standard-library parser events.

A page is read as one stream of parser events. Block elements cut it into lines; each line has its text, its number of
tags, the region (article or main) and the container it lies in, and whether it lies in page furniture. The ratio of
text to tags of the lines is smoothed by a Gaussian and split in two clusters by a threshold. Each region that holds a
line of the upper cluster is selected, or else the lowest container around all such lines: all lines in it come out,
but for furniture.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a line, those without content, and those that hold no article text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
FURNITURE = frozenset("head title script style noscript template nav footer aside menu form button select option textarea dialog iframe object svg canvas audio video map datalist applet fieldset search".split())
REGIONS = frozenset("article main".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd li td th tr figcaption blockquote summary caption".split())
#: An element is closed by the start of another of these, up to the nearest holder.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
HOLDERS = frozenset("ul ol dl table div section article main body html nav aside footer header form menu".split())
#: Words in class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus donate footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promoted promotion related replies respond recommended recommendations share sharing sidebar sidebars skip social sponsor sponsored sponsors subscribe subscription teaser toolbar trending widget widgets".split()
)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SIGMA = 1.0
#: Pages that a task holds at a time.
BATCH = 64


@dataclass
class Line:
    text: str
    tags: int
    links: int
    furniture: bool
    region: int
    container: int
    heading: bool
    marks: tuple[int, ...]


class LineReader(HTMLParser):
    """Parser events to lines. Open elements are (tag, is or lies in furniture, region, container, marked elements around).

    Whether a mark makes its element furniture is known at the end only: `spared` ones are or hold a region.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, int, tuple[int, ...]]] = [("", False, 0, 0, ())]
        self.parts: list[str] = []
        self.tags = self.links = self.made = self.in_link = 0
        self.parents: dict[int, int] = {0: 0}
        self.spared: set[int] = set()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tag, furniture, region, container, marks = self.open[-1]
            self.lines.append(Line(text, self.tags, self.links, furniture, region, container, tag[:1] == "h" and tag[1:].isdigit(), marks))
            self.tags = self.links = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "a":
            self.in_link = 1
        block, leaves_out = tag in BLOCKS, tag in FURNITURE
        if not (block or leaves_out):
            if tag not in VOID and _hidden(attrs):
                self.flush()
                self.open.append((tag, True, *self.open[-1][2:]))
            return
        if block:
            self.flush()
        if tag in VOID:
            return
        if block and self.open[-1][0] == "p":
            self.open.pop()
        ends = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in ends:
                del self.open[i:]
                break
            if self.open[i][0] in HOLDERS:
                break
        _, inside, region, container, marks = self.open[-1]
        if tag == "header":
            leaves_out = region == 0
        if tag not in ("html", "body") and not leaves_out:
            leaves_out = _hidden(attrs)
        self.made += 1
        if tag not in ("html", "body", "main") and not (inside or leaves_out) and _marked(attrs):
            marks = (*marks, self.made)
        if tag in REGIONS and not (tag == "article" and region):
            if not (inside or leaves_out or region):
                self.spared.update(marks)
            self.parents[self.made] = region
            region = self.made
        if tag not in LEAVES:
            self.parents[self.made] = container
            container = self.made
        if leaves_out and not block:
            self.flush()
        self.open.append((tag, inside or leaves_out, region, container, marks))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, a slash doesn't close an element

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link = 0
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.flush()
                del self.open[i:]
                return
            if tag not in BLOCKS and self.open[i][0] in HOLDERS:
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.in_link:
            self.links += len(data)


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marked(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a whole token is a mark, or all words of it are."""
    return any(value and any((w := WORD.findall(CAMEL.sub(" ", token).lower())) and MARKS.issuperset(w) for token in value.split()) for name, value in attrs if name in ("class", "id", "role", "aria-label"))


def _smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[radius : radius + len(ratio)]
    return np.convolve(ratio, kernel, "full")[radius : radius + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """Split of the values in two clusters with the least squared distance within them (on a log scale); below all if they are one."""
    x = np.sort(np.log1p(values))
    if not len(x) or x[-1] - x[0] < 1e-9:
        return -1.0
    n = np.arange(1, len(x))
    total, left = x.sum(), np.cumsum(x)[:-1]
    between = left**2 / n + (total - left) ** 2 / (len(x) - n)
    i = int(np.argmax(between))
    return float(np.expm1((x[i] + x[i + 1]) / 2))


def main_text(html: str | None) -> str:
    """The article of one page, blocks joined by an empty line; empty for null, and for pages without text."""
    if not html:
        return ""
    reader = LineReader()
    reader.feed(html)
    reader.close()
    reader.flush()
    lines = reader.lines
    if not lines:
        return ""
    spared = reader.spared
    if not any(x.region and not x.furniture and spared.issuperset(x.marks) for x in lines):
        # a marked element with most of the page's text holds the article
        total = sum(len(x.text) for x in lines if not x.furniture)
        held: dict[int, int] = {}
        for x in lines:
            for m in x.marks if not x.furniture else ():
                held[m] = held.get(m, 0) + len(x.text)
        spared |= {m for m, n in held.items() if 2 * n > total}
    for x in lines:
        x.furniture |= not spared.issuperset(x.marks)
    ratio = np.asarray([0.0 if x.furniture else max(0, len(x.text) - x.links) / max(1, x.tags) for x in lines])
    smooth = _smoothed(ratio)
    cut = threshold(smooth)
    content = [not x.furniture and s > cut for x, s in zip(lines, smooth.tolist(), strict=True)]
    if not any(content):
        content = [not x.furniture for x in lines]
    regions = {x.region for x, c in zip(lines, content, strict=True) if c and x.region}
    if regions:
        return "\n\n".join(x.text for x in lines if x.region in regions and not x.furniture)
    # the lowest container that all of the upper cluster lies in
    paths = []
    for at in {x.container for x, c in zip(lines, content, strict=True) if c}:
        path = [at]
        while path[-1]:
            path.append(reader.parents[path[-1]])
        paths.append(path[::-1])
    chosen = 0
    for level in zip(*paths, strict=False):
        if len(set(level)) > 1:
            break
        chosen = level[0]
    inside = []
    for x in lines:
        at = x.container
        while at and at != chosen:
            at = reader.parents[at]
        inside.append(at == chosen and not x.furniture)
    first = next((i for i, a in enumerate(inside) if a), 0)
    while first and lines[first - 1].heading and not lines[first - 1].furniture:
        first -= 1
        inside[first] = True
    return "\n\n".join(x.text for x, a in zip(lines, inside, strict=True) if a)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page row; nothing is cut or dropped.

    Null or empty html gives an empty text and 0; null ids and urls stay null; repeated rows each get their row. A page
    without article or main falls back to the lowest container that holds all of the upper cluster. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
