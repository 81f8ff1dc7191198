"""Operator 9: the main text of web pages, by text density over standard-library parser events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed names of HTML.
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title".split())
FRAME = frozenset("nav header footer aside form menu dialog button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd pre td th tr address figcaption summary legend option center br hr".split())
LISTS = frozenset("ul ol dl dir table tbody thead tfoot figure".split())
REPLIES = frozenset("comment comments commentlist replies disqus".split())
FRAME_WORDS = REPLIES | frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent "
    "alert popup modal newsletter subscribe signup login share sharing social related recommended recommendations pagination pager toolbar notice notices".split()
)
# Words that tell of a frame only outside an article.
DOUBTFUL = frozenset("side search widget tags copyright legal disclaimer skip".split())
# Words that say nothing: where a thing stands, what it looks like, what it holds.
NEUTRAL = frozenset(
    "site page main global top bottom left right center primary secondary first last inner outer wrapper wrap container box block section area zone region slot unit panel module widget bar row col column list item items group "
    "link links button buttons btn icon icons post posts article articles story stories content body text form input field fields message messages msg media desktop mobile small medium large sm md lg xl js is fixed sticky open closed active".split()
)
# Names that only tell of a frame elsewhere, and parts of the article itself.
NOT_FRAMES = re.compile(r"^(?:with|without|has|no)[-_]|^(?:article|post|entry|story|content|main|page)[-_](?:header|head|title|body|text|content|main)$")
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# How a line's markup weighs its density against the threshold, and the least weighted density of content: links alone have none.
IN_FRAME, IN_DOUBT, IN_ARTICLE, INHERITED, FLOOR = 0.12, 0.5, 1.5, 0.75, 0.05


class Element:
    """An open element that holds lines: what its markup says, and what its own lines add up to."""

    __slots__ = ("parent", "tag", "framed", "named", "doubtful", "main", "holds_main", "chars", "tags", "frame", "inside", "density", "scope")

    def __init__(self, parent: Element | None, tag: str, framed: bool, named: bool, doubtful: bool, main: bool):
        self.parent, self.tag, self.framed, self.named, self.doubtful, self.main = parent, tag, framed, named, doubtful, main
        self.holds_main = False
        self.chars = self.tags = 0


class Lines(HTMLParser):
    """Blocks of text in page order, each a line: [text, tags since the line before, characters in links, element, heading]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.top = Element(None, "html", False, False, False, False)
        self.elements = [self.top]
        self.open: list[tuple[str, Element]] = []  # tag, the element that was on top before
        self.silent = self.links = self.heading = 0

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            home = self.top
            linked = min(self.linked, len(text))
            self.lines.append([text, self.tags, linked, home, bool(self.heading)])
            home.chars += len(text) - linked
            home.tags += self.tags
            self.tags = self.linked = 0
        self.parts.clear()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag in VOID:
            return
        if tag == "p" or tag in ("li", "td", "tr", "dt", "dd", "option"):
            self.close_implied(tag)
        framed, named, doubtful = tag in FRAME, False, False
        main = tag in ("article", "main")
        for name, value in attrs:
            if name in ("class", "id") and value and tag not in ("body", "html"):
                kind = names_frame(value, main)
                named |= kind == 2
                doubtful |= kind == 1
            elif name == "role" and value in FRAME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                framed = True
            elif name == "role" and value == "main":
                main = True
        self.open.append((tag, self.top))
        if framed or named or doubtful or main or tag in BLOCKS and tag not in LEAVES:
            if main:
                up = self.top
                while up is not None and not up.holds_main:
                    up.holds_main, up = True, up.parent
            self.top = Element(self.top, tag, framed, named, doubtful, main)
            self.elements.append(self.top)
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.heading += tag in HEADINGS

    def close_implied(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                self.shut(k)
                return
            if name in BLOCKS and name != tag or name in ("table", "ul", "ol"):
                return

    def shut(self, k):
        for name, _ in self.open[k:]:
            self.silent -= name in SILENT
            self.links -= name == "a"
            self.heading -= name in HEADINGS
        self.top = self.open[k][1]
        del self.open[k:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.shut(k)
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def settle(self):
        """Hands what elements say down to those inside them; parents come before their children."""
        for e in self.elements:
            up = e.parent
            above = up is not None
            # The head of an article is its own; a name does not make a frame of what holds the article.
            own_head = e.tag == "header" and above and up.inside
            e.frame = above and up.frame or e.framed and not own_head or e.named and not e.holds_main
            e.inside = not e.frame and (e.main or above and up.inside)
            e.doubtful = not e.inside and (e.doubtful and not e.holds_main or above and up.doubtful)
            own = float(np.sqrt(e.chars / max(1, e.tags)))
            e.density = max(own, INHERITED * up.density) if above and up.tag not in ("html", "body") else own
            e.scope = up.scope if above and (e.tag in LISTS or e.inside and up.inside) else e


def names_frame(names: str, article: bool = False, known: dict[tuple[str, bool], int] = {}) -> int:  # noqa: B006  names repeat from page to page
    """2 if a class or id attribute names a frame, 1 if it may, 0 if not. One of its names does if all its words do, but for
    those that say nothing, and it is no name of an article's part: ``site-footer`` is one, ``share-price`` is not. Of an
    article itself, only names of readers' comments count."""
    found = known.get((names, article))
    if found is None:
        tokens = [t for t in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split() if not NOT_FRAMES.search(t)]
        telling = [{w.rstrip("0123456789") for w in re.split(r"[-_]+", t)} - NEUTRAL - {""} for t in tokens]
        frames = REPLIES if article else FRAME_WORDS
        sure = any(words and words <= frames for words in telling)
        found = 2 if sure else int(not article and any(words and words <= FRAME_WORDS | DOUBTFUL for words in telling))
        if len(known) < 100_000:
            known[names, article] = found
    return found


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """``x`` under a Gaussian of ``sigma`` lines, cut at three sigmas and normed at both ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]
    return np.convolve(x, kernel, "full")[reach : reach + len(x)] / over


def two_means(x: np.ndarray, rounds: int = 20) -> float:
    """The threshold between two clusters of ``x``; below all of them if they are the same."""
    low, high = float(x.min()), float(x.max())
    for _ in range(rounds):
        cut = (low + high) / 2
        below, above = x[x <= cut], x[x > cut]
        if not len(above) or not len(below):
            return -1.0
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def line_densities(lines: list[list], sigma: float) -> np.ndarray:
    """The smoothed text-to-tag ratio of each line, or that of its element's lines if higher; markup has no say in it.

    Ratios are under a square root, so that a few long paragraphs do not make all others thin. Either counts less
    the more of the text around the line is in links: so lines of links do not pass for the prose beside them, but a
    single one does not leave it.
    """
    whole = np.array([len(x[0]) for x in lines], float)
    size = whole - np.array([x[2] for x in lines], float)
    ratio = np.sqrt(size / np.maximum(1, np.array([x[1] for x in lines], float)))
    prose = smoothed(size / whole, sigma)
    return prose * np.maximum(smoothed(ratio, sigma), np.array([x[3].density for x in lines]))


def line_weights(lines: list[list]) -> np.ndarray:
    """How far the markup of each line speaks for content."""
    return np.array([IN_FRAME if x[3].frame else IN_ARTICLE if x[3].inside else IN_DOUBT if x[3].doubtful else 1.0 for x in lines])


def content_lines(lines: list[list], density: np.ndarray) -> np.ndarray:
    """True for the lines of the content regions.

    Two clusters of the densities alone set the threshold, at most half the highest weighed density of an element outside
    frames (a few long lines do not raise it). A line whose
    weighed density is over it is content; where all lines are equally dense, there are no two clusters, and all with any
    text outside links are. Thin lines between two dense ones of their own scope (an article, else an element that is no
    list) belong to the region, as does a heading right before it; lines of frames do neither. A page of frames has none.
    """
    weights = line_weights(lines)
    weighed = density * weights
    free = [k for k, x in enumerate(lines) if not x[3].frame]
    if not free:
        return np.zeros(len(lines), bool)
    home = max(w * lines[k][3].density for k, w in zip(free, weights[free]))
    cut = max(FLOOR, min(two_means(density), home / 2))
    region = weighed > cut
    dense = np.flatnonzero(region).tolist()
    for a, b in zip(dense, dense[1:]):
        for k in range(a + 1, b):
            home = lines[k][3]
            if not home.frame and home.scope is lines[a][3].scope and home.scope is lines[b][3].scope:
                region[k] = True
    for k in range(len(lines) - 2, -1, -1):
        if lines[k][4] and region[k + 1] and not lines[k][3].frame:
            region[k] = True
    return region


def main_text(html: str, sigma: float = 1.0) -> str:
    """The main content's blocks, joined by blank lines; see ``extract_text``."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    parser.settle()
    if not parser.lines:
        return ""
    region = content_lines(parser.lines, line_densities(parser.lines, sigma))
    return "\n\n".join(x[0] for x, r in zip(parser.lines, region) if r)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, text (main content, empty if none) and n_chars (code points) of every row.

    The parser's events are cut into lines at block tags. A line's text-to-tag ratio (characters outside links over
    tags since the line before, square root) is smoothed by a Gaussian over its neighbours; that of all lines of its
    element counts instead if higher. Two-means clustering of these densities sets the threshold. Markup only weighs a line
    against it: frames by tag, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms, comments)
    little, lines in ``article`` or ``main`` more. Thin lines between dense ones of the same scope belong to the region.
    Character references are decoded, white space in a block becomes one space, blocks are joined by a blank line. Null
    html is empty. Whole pages are read; nothing is shuffled; repeated rows and null ids and urls are kept; empty tables
    give no rows.
    """
    kinds = dict(pages.dtypes)
    found = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_extracted, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
