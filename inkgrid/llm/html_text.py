"""Main text of web pages.

The standard library's parser streams its events; block elements cut a page into lines of text, each with the tags met, the text
inside links and the container (article, division, cell) it stands in.  A line's ratio of text outside links to tags is smoothed
with a Gaussian over neighbours of its own kind; two-means clustering of the smoothed values sets the threshold that selects
content lines.  The smallest container that holds nearly all selected text, widened to the article it lies in, is the content
region; inside it short paragraphs and headings stay, and containers that are mostly links or mostly tags go.

Element names, roles and class names are a prior only: text under navigation, headers, footers, asides, forms, notices, adverts or
comments counts a fifth, so it goes where the page holds denser text outside them, and stays where it is all the page has (an
article inside a page-wide form).  Scripts, styles, controls and hidden elements are no text at all.

Defined results: a null or empty page has an empty text, and so has a page of nothing but menus, footers and the like; broken,
unclosed or truncated markup is read as far as it goes; long and deep pages are read whole in time that grows with their length;
rows are independent, so repeated rows give equal texts; other columns are kept by `with_text`.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches
from ._text import settled

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never shown as text of the page: code, controls, embedded media, metadata.
NO_TEXT = frozenset("audio button canvas datalist head iframe map math noscript object option script select style svg template textarea title video".split())
#: Elements whose text seldom is content.
SELDOM = frozenset("aside dialog footer form header menu nav search".split())
#: Words of class names and ids that say the same, and words that may stand beside them in such a name.
SELDOM_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs byline carousel comment comments commentlist consent cookie cookies disclaimer discussion disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination paywall popup promo promotion reactions recommended related replies reply respond search share sharebar sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser toc toolbar topbar trending widget widgets".split()
)
PLAIN_WORDS = frozenset("a above area b bar bars below block body bottom box btn button buttons col column container content cont global google holder i inner item items left link links list main middle module more new of page pages panel panels post posts primary right row secondary section site slot sub text the thread to top unit wrap wrapper".split())
ADS = frozenset("ad ads adbox advert adverts advertisement advertising adsense comment comments sponsor sponsored".split())
SELDOM_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HOME = frozenset(("article", "main"))
#: Elements that hold regions; others belong to the container around them.
CONTAINER = frozenset("article aside body center dialog div fieldset footer form header html main menu nav search section td th".split())
#: Elements of running text, which only adverts and comments mark by their names.
RUNNING = frozenset("blockquote dd dt figcaption figure h1 h2 h3 h4 h5 h6 li p pre table tbody td th thead tr".split())
#: A start tag of the key ends an open element of the value, as browsers do.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORDS = re.compile(r"[A-Za-z]+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
SIGMA, REACH = 1.0, 2
#: What a mark makes of a line's ratio, and the share of selected text that the content region holds.
PRIOR, SHARE = 0.2, 0.9


def _named(value: str, words: frozenset[str]) -> bool:
    """Is one of the names made of these words, beside plain ones?"""
    for name in value.split():
        own = {w.lower() for w in WORDS.findall(HUMPS.sub(" ", name))}
        if own & words and own <= words | SELDOM_WORDS | PLAIN_WORDS:
            return True
    return False


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" or name == "style" and "display:none" in (value or "").replace(" ", "").lower():
            return True
    return False


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    words = ADS if tag in RUNNING else SELDOM_WORDS
    return any(value and (name in ("class", "id") and _named(value, words) or name == "role" and value.strip().lower() in SELDOM_ROLES) for name, value in attrs)


class _Lines(HTMLParser):
    """Collects lines: (text, tags met, text inside links, marks above it, container, heading); containers by (parent, home)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.open: list[tuple[str, bool, int, int]] = []  # element, whether it turns text away, marks and container around it
        self.where: dict[str, list[int]] = {}  # places of open elements by name
        self.blocks: list[int] = []
        self.homes: list[int] = []
        self.parent, self.is_home = [-1], [False]
        self.away = self.links = self.marks = self.heads = self.container = 0
        self.seen_home = False
        self.text: list[str] = []
        self.tags = self.linked = 0

    def cut(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((line, self.tags, self.linked, self.marks, self.container, self.heads > 0))
            self.text, self.linked = [], 0
        self.tags = 0

    def leave(self, place: int) -> None:
        """Closes all elements from this place of the stack on."""
        while len(self.open) > place:
            tag, away, self.marks, self.container = self.open.pop()
            self.where[tag].pop()
            self.away -= away
            self.links -= tag == "a"
            self.heads -= tag in ("h1", "h2")
            for places in (self.blocks, self.homes):
                if places and places[-1] == len(self.open):
                    places.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in ENDS and self.blocks and self.open[self.blocks[-1]][0] in ENDS[tag]:
            self.leave(self.blocks[-1])
        away = tag in NO_TEXT or tag not in ("html", "body") and _hidden(attrs)
        place = len(self.open)
        self.open.append((tag, away, self.marks, self.container))
        self.where.setdefault(tag, []).append(place)
        self.away += away
        self.links += tag == "a"
        self.heads += tag in ("h1", "h2")
        if tag in BLOCK:
            self.blocks.append(place)
        marked = tag not in ("html", "body") and (tag in SELDOM and not (tag == "header" and self.homes) or _marked(tag, attrs))
        if tag in HOME:
            if not marked and not self.seen_home and not any(self.where.get(t) for t in ("aside", "nav", "footer")):
                self.marks = 0  # the page's article does not stand inside a form, an advert or a notice: that one wraps all or was left open
            self.seen_home = True
            self.homes.append(place)
        self.marks += marked
        if tag in CONTAINER:
            self.parent.append(self.container)
            self.is_home.append(tag in HOME)
            self.container = len(self.parent) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        places = self.where.get(tag)
        # text marks left open do not reach out of an article
        if places and (tag in BLOCK or not self.homes or self.homes[-1] < places[-1]):
            self.leave(places[-1])

    def handle_data(self, data: str) -> None:
        if not self.away:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def threshold(values: np.ndarray) -> float:
    """Between two clusters of values, by two-means from the extremes; below all values if they are alike."""
    low, high = float(values.min()), float(values.max())
    if high <= 2 * low:
        return -1.0
    for _ in range(50):
        middle = (low + high) / 2
        new_low, new_high = float(values[values <= middle].mean()), float(values[values > middle].mean())
        if new_low == low and new_high == high:
            break
        low, high = new_low, new_high
    return (low + high) / 2


def smooth(values: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines of the same kind; the weights of other neighbours are left out."""
    total, out = np.ones(len(values)), values.astype(float).copy()
    for step in range(1, min(REACH, len(values) - 1) + 1):
        weight = np.exp(-(step**2) / (2 * SIGMA**2)) * (kind[step:] == kind[:-step])
        out[step:] += weight * values[:-step]
        out[:-step] += weight * values[step:]
        total[step:] += weight
        total[:-step] += weight
    return out / total


def selected(size: np.ndarray, tags: np.ndarray, linked: np.ndarray, marks: np.ndarray, container: np.ndarray, heading: np.ndarray, parent: list[int], is_home: list[bool]) -> np.ndarray:
    """Which lines are content, from what the parser saw of each."""
    plain = np.maximum(0, size - linked)
    ratio = np.log1p(plain / np.maximum(1, tags)) * PRIOR ** np.minimum(marks, 2)
    cut = threshold(ratio_smooth := smooth(ratio, marks))
    if cut < 0 and marks.all():
        return np.zeros(len(size), bool)
    chosen = ratio_smooth > cut
    home = np.full(len(parent), -1)
    for k in range(1, len(parent)):  # a container's number is above its parent's
        home[k] = k if is_home[k] else home[parent[k]]
    inside = home[container] >= 0
    if (inside & (marks == 0)).any():  # an article of thin text is still the page's article
        chosen = chosen & inside if (chosen & inside).any() else inside & (marks == 0)
    # the smallest container of nearly all selected text
    held = np.bincount(container, weights=size * chosen, minlength=len(parent))
    for k in range(len(parent) - 1, 0, -1):
        held[parent[k]] += held[k]
    region = max(k for k in range(len(parent)) if held[k] >= SHARE * held[0])
    region = home[region] if home[region] >= 0 else region
    under = np.zeros(len(parent), bool)
    for k in range(len(parent)):
        under[k] = k == region or k > 0 and under[parent[k]]
    keep = under[container]
    if inside.any() and home[region] < 0:  # several articles
        keep &= np.isin(home[container], np.unique(home[container[chosen]]))
    # containers inside it that are mostly links, or tags with hardly any text
    lines, text, open_, met = (np.bincount(container, weights=w, minlength=len(parent)) for w in (np.ones(len(size)), size, plain, np.maximum(1, tags)))
    thin = (np.arange(len(parent)) != region) & ((2 * open_ < text) | (lines > 1) & (np.log1p(open_ / np.maximum(1, met)) < cut / 2))
    keep &= chosen | (marks == 0) & ~thin[container]
    first = int(np.flatnonzero(keep)[0]) if keep.any() else 0
    for k in range(first - 1, max(-1, first - 4), -1):  # the headline just above the region
        if heading[k] and not marks[k] and not linked[k] and not inside[first]:
            keep[k] = True
            break
    return keep


def main_text(html: str | None) -> str:
    """The page's main text: lines of its content region, joined by blank lines."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    if not parser.lines:
        return ""
    text, *seen = zip(*parser.lines, strict=True)
    tags, linked, marks, container, heading = map(np.array, seen)
    keep = selected(np.array([len(x) for x in text], dtype=float), tags, linked.astype(float), marks, container, heading, parser.parent, parser.is_home)
    return "\n\n".join(x for x, k in zip(text, keep.tolist(), strict=True) if k)


def text_column(html: Column | str) -> Column:
    """string: the main text of a page's html."""

    @F.arrow_udf("string")
    @settled
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return texts(html)


def with_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages, all columns, with the main text (a same-named column is replaced); one narrow pass."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn(out_col, text_column(F.col(html_col)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    bounded_batches(pages.sparkSession)
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_column(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
