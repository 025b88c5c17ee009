"""Main text of web pages: text-to-tag ratios per line, smoothed and split by a threshold.

The standard library's parser streams events; no tree is built. Text between block boundaries is
one line (a block). Each line has its characters and the tags inside and before it, links counted as
markup, so prose has a high ratio and menus a low one. Ratios are smoothed with a Gaussian, so that
a short paragraph between long ones counts with them.

Regions of the page (what stands directly in one article or main element, or in none) are weighed by
their ratios and text; being an article or main only adds to the weight. Two clusters of the weights
decide which regions are content; outside marked elements two clusters of the lines' ratios then decide
which lines are.

What a page declares to be no article (menus, asides, page headers and footers, forms, adverts,
notices, comments; by element, role, or words in class and id) never takes part.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpuskit.llm.common import map_batches

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas audio video title".split())
OUTSIDE = frozenset("nav aside footer form menu dialog select button textarea fieldset datalist".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footers masthead topbar "
    "toolbar pagination pager cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments respond reply replies disqus "
    "search skip widget copyright disclaimer".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
#: A name with one of these says what the page has beside the element: has-sidebar, no-comments.
BESIDE = frozenset("has with without no".split())
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def names_furniture(value: str, in_article: bool) -> bool:
    """Whether a class or id says menu, advert, comment or the like, at the start or end of a name."""
    for name in value.split():
        words = WORDS.findall(CAMEL.sub(" ", name).lower())
        if words and BESIDE.isdisjoint(words):
            if words[0] in NAMES or words[-1] in NAMES or words[-1] == "header" and not in_article:
                return True
    return False


class Lines(HTMLParser):
    """Turns parser events into lines: (text, tags, linked characters, 2 in an article or 1 in main, region)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.open: list[tuple[str, bool]] = []  # name, whether it leaves the page's content
        self.places: dict[str, list[int]] = {}  # of each name, where it is open
        self.walls: list[int] = []  # where elements are open that implied ends do not go beyond
        self.blocks: list[int] = []
        self.regions: list[int] = []  # numbers of the open articles and mains
        self.n_regions = 0
        self.out = 0
        self.articles = 0
        self.mains = 0
        self.links = 0
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def finish_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((
                text, self.tags, self.linked, 2 if self.articles else 1 if self.mains else 0, self.regions[-1] if self.regions else 0,
            ))
            self.tags = 0
        self.parts, self.linked = [], 0

    def leaves(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in RAW or tag in OUTSIDE:
            return True
        if tag == "header" and not self.articles:
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and value and value.lower() in ROLES:
                return True
            if name in ("class", "id") and value and names_furniture(value, self.articles > 0):
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, out = self.open.pop()
            self.places[tag].pop()
            for held in (self.walls, self.blocks):
                if held and held[-1] == len(self.open):
                    held.pop()
            if not self.out and tag in BLOCKS:
                self.finish_line()
            self.out -= out
            self.articles -= tag == "article"
            self.mains -= tag == "main"
            if tag in ("article", "main"):
                self.regions.pop()
            self.links -= tag == "a"

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES or tag in ENDS_P:
            self.implied_end(tag)
        if not self.out:
            if tag in BLOCKS:
                self.finish_line()
            elif tag == "br":
                self.parts.append(" ")
            self.tags += 1
        if tag in VOID:
            return
        out = self.leaves(tag, attrs)
        if out and not self.out and tag not in BLOCKS:
            self.parts.append(" ")
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS and tag != "p" or tag in OUTSIDE:
            self.walls.append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, out))
        if tag in ("article", "main"):
            self.n_regions += 1
            self.regions.append(self.n_regions)
        self.out += out
        self.articles += tag == "article"
        self.mains += tag == "main"
        self.links += tag == "a"

    def implied_end(self, tag: str) -> None:
        """A new paragraph ends an open one, a new item the item before it."""
        wall = self.walls[-1] if self.walls else -1
        last = max((self.places[n][-1] for n in CLOSES.get(tag, ("p",)) if self.places.get(n)), default=-1)
        # what ends may itself be the innermost block
        if last >= wall >= 0 or last > wall:
            self.close_to(last)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "p" and not self.places.get("p") and not self.out:
            self.finish_line()
        held = self.places.get(tag)
        # a stray inline end tag closes no block around it
        inline = tag not in BLOCKS and tag not in RAW and tag not in OUTSIDE
        if not held or inline and self.blocks and self.blocks[-1] > held[-1]:
            return
        if not self.out:
            self.tags += 1
        self.close_to(held[-1])

    def handle_data(self, data):
        if not self.out:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def unknown_decl(self, data):
        pass


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean over neighbouring lines, weights renewed at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    # "same" would give the kernel's length where there are fewer lines
    total = np.convolve(values, kernel)[reach:reach + len(values)]
    weight = np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]
    return total / weight


def two_means(values: np.ndarray) -> float:
    """Threshold midway between the means of the two clusters of the values."""
    low, high = float(values.min()), float(values.max())
    while True:
        cut = (low + high) / 2
        above = values > cut
        if not above.any() or above.all():
            return cut
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            return cut
        low, high = new


#: what an article or a main element adds to the logarithm of a region's weight
PRIOR = (0.0, math.log(2), math.log(4))
#: values that are closer are one cluster: ratios of lines, weights of regions
FLAT_LINES, FLAT_REGIONS = 0.7, 1.5


def chosen_regions(lines: list[tuple[str, int, int, int, int]], smoothed: np.ndarray) -> set[int]:
    """The regions of a page that hold its content.

    A region is what stands directly in one article or main element, or in none. It weighs as much as its
    text outside links times its mean smoothed ratio; its element only adds to that. Two clusters of the
    weights' logarithms decide, so a page's story wins over teasers that are articles.
    """
    at: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        at.setdefault(line[4], []).append(i)
    weight = np.array([
        math.log1p(sum(max(0, len(lines[i][0]) - lines[i][2]) for i in own)) + math.log1p(float(smoothed[own].mean()))
        + PRIOR[lines[own[0]][3]] for own in at.values()
    ])
    if weight.max() - weight.min() < FLAT_REGIONS:
        return set(at)
    cut = two_means(weight)
    return {r for r, w in zip(at, weight, strict=True) if w > cut}


def content(lines: list[tuple[str, int, int, int, int]], sigma: float = 1.0, link_share: float = 0.5) -> list[str]:
    """The lines that are content, in page order.

    Every line has a ratio of text outside links to tags; ratios are smoothed along the page. Regions are
    chosen first, then lines: those of an article or main element all, others by two clusters of their ratios.
    """
    if not lines:
        return []
    ratio = np.array([max(0, len(t) - linked) / max(1, tags) for t, tags, linked, _, _ in lines])
    smoothed = smooth(ratio, sigma)
    regions = chosen_regions(lines, smoothed)
    inside = np.array([line[4] in regions for line in lines])
    level = np.log1p(smoothed)
    own = level[inside]
    cut = two_means(own)
    flat = own.max() - own.min() < FLAT_LINES
    return [
        t for (t, _, linked, kind, _), s, there in zip(lines, level, inside, strict=True)
        if there and (kind or (flat or s > cut) and linked <= link_share * len(t))
    ]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Main text of a page; empty for null, for an empty page and where nothing is content."""
    if not html:
        return ""
    lines = Lines()
    lines.feed(html)
    lines.close()
    lines.close_to(0)
    lines.finish_line()
    return " ".join(content(lines.lines, sigma))


def extract(pages: DataFrame, html: str = "html", sigma: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` to pages; all other columns stay unless named like these.

    Null pages give the empty text; pages of any length are read whole, each in one task; repeated
    rows give repeated rows and no rows give none.
    """

    def run(data):
        texts = [main_text(h, sigma) for h in data[html]]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_batches(pages, [html], run, fields, keep)
