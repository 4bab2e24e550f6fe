"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. Block elements and <br> inside none end a line; every line has its
text, its number of tags, how much of its text lies in links, the landmark that encloses it and a weight. The logarithm of the ratio of text
to tags, times the weight, is smoothed along the whole page and cut at a threshold between its two clusters; content lines make regions, and
all regions are taken, with the short lines and up to three links in them. Names only weigh: an article or main landmark and text blocks count
in full, bare text of a container and text beside a landmark less, and what is by name, role or class a menu, header, footer, sidebar,
notice, advert, form or comment little. Scripts, styles and hidden elements give no text.

Null or empty html, and pages without text, give an empty text. Entities are decoded, white space inside a block becomes one
space, blocks are joined by a line break. Unclosed and stray tags, comments, and pages of any length are handled in linear time; rows repeat.
A head ends at the body or at the first thing that it cannot hold. Another silent element without end tag ends with the block around it, and what
follows the first block in it is text. A form around a landmark or around most of the page's text is a plain container; a form in a form is none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template head title svg math object iframe canvas audio video select option button textarea input datalist".split())
#: What may stand in a head whose end tag is left out; anything else ends it.
HEAD = frozenset("base link meta title style script noscript template head html".split())
CHROME = frozenset("nav aside footer dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id that make what is not the article likely.
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer"
    " sidebar side rail widget related recommended recommendations share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice popup modal"
    " overlay comment comments disqus reply replies respond discussion pagination pager toolbar copyright legal disclaimer".split()
)
#: Words that say nothing beside one of those above; any other word in a name speaks for the article.
PLACE_WORDS = frozenset(
    "area bar block bottom box container first global group inner item items last left link links list main outer page panel primary right secondary section site slot top unit wrap wrapper".split()
)
#: Blocks that hold other blocks rather than text.
CONTAINERS = BLOCK - frozenset("address article blockquote body caption dd dt figcaption h1 h2 h3 h4 h5 h6 html li main p pre summary td th".split())
#: Weights of lines: of boilerplate elements, of boilerplate class words, of a container's bare text, beside a landmark.
CHROME_WEIGHT, WORD_WEIGHT, BARE_WEIGHT, BESIDE_WEIGHT = 0.1, 0.15, 0.5, 0.15
#: Share of the content's mean value from which on bare text, or text beside a landmark, is content too.
SHARE = 0.75
#: Links in a row that may stand within a landmark's text.
LINKS = 3

#: Width of the smoothing in lines.
SIGMA = 1.5


@dataclass(slots=True)
class Line:
    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    #: Weight of its boilerplate elements, 1 outside of any; 0 if hidden.
    weight: float = 1.0
    #: Text of a container, such as a div, without a block of its own.
    bare: bool = False
    landmark: int = 0
    #: Number of the open form.
    form: int = 0
    #: Text that counts if none of the silent elements around it has an end tag: place in ``text``, its length in links, innermost element.
    muted: list[tuple[int, int, "Silent"]] = field(default_factory=list)


@dataclass(slots=True)
class Silent:
    around: "Silent | None"
    #: It or an element around it has an end tag.
    ended: bool = False


@dataclass(slots=True)
class Element:
    tag: str
    weight: float
    silent: Silent | None
    landmark: bool
    form: int
    #: Open blocks around it.
    blocks: int
    open: bool = True


def chrome_words(name: str) -> bool:
    """A class or id such as ``ad``, ``sideBar`` or ``site-footer``: boilerplate words, else only words of place."""
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
    return bool(words & CHROME_WORDS) and words <= CHROME_WORDS | PLACE_WORDS


def weigh(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> float:
    """Weight of an element by its name, role and class; 0 if it is hidden."""
    found = dict(attrs)
    if "hidden" in found or (found.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style") or "", re.I):
        return 0.0
    if tag in CHROME or tag == "header" and not inside_article or (found.get("role") or "").lower() in ROLES:
        return CHROME_WEIGHT
    names = f"{found.get('class') or ''} {found.get('id') or ''}".split()
    return WORD_WEIGHT if tag not in ("html", "body", "article", "main") and any(map(chrome_words, names)) else 1.0


class Lines(HTMLParser):
    """Collects the lines of a page from parser events. Every element is opened and closed once, so the work is linear."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines = [Line()]
        self.open: list[Element] = []
        #: Open elements by tag; closed ones leave when they come to the end.
        self.named: dict[str, list[Element]] = {}
        self.links = self.landmarks = self.levels = self.blocks = 0
        self.weights = [1.0]  # of the open boilerplate elements, each with those around it
        self.silent: list[Silent] = []
        #: Silent elements in which no block began: what follows is silent.
        self.mute: list[Silent] = []
        self.every_silent: list[Silent] = []
        self.form = self.n_forms = 0
        #: Forms that enclose a landmark.
        self.plain = {0}

    def _cut(self) -> None:
        if self.lines[-1].text or self.lines[-1].tags:
            self.lines.append(Line())
        line = self.lines[-1]
        line.weight, line.landmark, line.form = self.weights[-1], self.levels and self.landmarks, self.form
        line.bare = bool(self.open) and self.open[-1].tag in CONTAINERS

    def _last(self, tag: str) -> Element | None:
        stack = self.named.get(tag, [])
        while stack and not stack[-1].open:
            stack.pop()
        return stack[-1] if stack else None

    def _end_head(self, tag: str) -> None:
        """A head without end tag ends where the body begins, or with the first thing that a head cannot hold."""
        if tag == "body" and any(e.tag == "head" for e in self.open[:4]) or self.open and self.open[-1].tag == "head" and tag not in HEAD:
            self.handle_endtag("head")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_head(tag)
        if tag in BLOCK:
            self.mute.clear()
            if tag == "p" and any(e.tag == "p" and e.open for e in self.open[-4:]):
                self.handle_endtag("p")
            if tag in ("li", "dd", "dt", "tr", "td", "th") and self.open and self.open[-1].tag == tag:
                self.handle_endtag(tag)
        if tag not in VOID:
            role = (dict(attrs).get("role") or "").lower()
            one = Element(tag, weigh(tag, attrs, self.levels > 0), None, tag in ("article", "main") or role in ("main", "article"), 0, self.blocks)
            if tag in SILENT:
                one.silent = Silent(self.silent[-1] if self.silent else None)
                self.silent.append(one.silent)
                self.mute.append(one.silent)
                self.every_silent.append(one.silent)
            if (tag == "form" or role == "form") and not self.form:
                self.n_forms += 1
                self.form = one.form = self.n_forms
            if one.weight < 1:
                self.weights.append(min(one.weight, self.weights[-1]))
            self.levels += one.landmark
            self.landmarks += one.landmark and self.levels == 1
            if one.landmark:
                self.plain.add(self.form)
            self.links += tag == "a"
            self.blocks += tag in BLOCK
            self.open.append(one)
            self.named.setdefault(tag, []).append(one)
        if tag in BLOCK:
            self._cut()
        elif tag == "br":
            self.lines[-1].text.append(" ")
        self.lines[-1].tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # the slash means nothing on other elements than void ones
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style"):
            self.handle_endtag(tag)

    def _leave(self, one: Element, by_tag: bool) -> None:
        if not one.open:
            return
        one.open = False
        if one.weight < 1:
            self.weights.pop()
        if one.silent:
            one.silent.ended = by_tag
            self.silent.pop()
            if self.mute and self.mute[-1] is one.silent:
                self.mute.pop()
        if one.form:
            self.form = 0
        self.levels -= one.landmark
        self.links -= one.tag == "a"
        self.blocks -= one.tag in BLOCK

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        one = self._last(tag)
        if one is None:
            return
        # an inline end tag does not close blocks around it
        if tag not in BLOCK and not one.silent and one.weight == 1 and self.blocks > one.blocks:
            self._leave(one, True)
        else:
            while True:
                last = self.open.pop()
                self._leave(last, last is one)
                if last is one:
                    break
        if tag in BLOCK:
            self._cut()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head("")
        line, linked = self.lines[-1], len(data.strip()) if self.links else 0
        if not self.mute:
            if self.silent:
                line.muted.append((len(line.text), linked, self.silent[-1]))
            line.text.append(data)
            line.linked += linked

    def close(self) -> None:
        """Silent elements that have an end tag lose their text; lines in forms that hold little of the page lose weight."""
        super().close()
        for silent in self.every_silent:  # those around come first
            silent.ended |= silent.around is not None and silent.around.ended
        sizes: dict[int, int] = {}
        total = 0
        for line in self.lines:
            for at, linked, silent in line.muted:
                if silent.ended:
                    line.text[at] = ""
                    line.linked -= linked
            if line.weight == 1:
                n = len(" ".join("".join(line.text).split()))
                total += n
                sizes[line.form] = sizes.get(line.form, 0) + n
        self.plain.update(form for form, n in sizes.items() if 2 * n > total)
        for line in self.lines:
            if line.form not in self.plain:
                line.weight = min(line.weight, CHROME_WEIGHT)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian kernel of three sigmas; the ends weigh only what is there."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    ones = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / ones


def threshold(values: np.ndarray) -> float:
    """Midway between the two clusters of one-dimensional 2-means; lines without weight are the lower one from the start."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(above):
            break
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def line_values(lines: list[tuple[str, Line]]) -> np.ndarray:
    """Logarithm of the text-to-tag ratio times weight; orders of size, so one huge paragraph does not make weak lines of the others."""
    marked = any(x.landmark for _, x in lines)
    weight = [x.weight * (BARE_WEIGHT if x.bare else 1) * (BESIDE_WEIGHT if marked and not x.landmark else 1) for _, x in lines]
    return np.array(weight) * np.log1p([max(0, len(t) - 2 * x.linked) / max(1, x.tags) for t, x in lines])


def content(lines: list[tuple[str, Line]]) -> list[str]:
    """The content of a page's lines."""
    values, plain = line_values(lines), np.array([x.weight == 1 for _, x in lines])
    if not values[plain].any():
        return []
    curve = smooth(values)
    cut = min(threshold(curve), float(curve.max()) / 2)
    bare = np.array([x.bare for _, x in lines])
    beside = np.array([not x.landmark for _, x in lines]) & any(x.landmark for _, x in lines)
    # a line by itself must have its share too: a weak one is no content for its strong neighbours
    high = plain & ~beside & (curve > cut)
    if 2 * (high & ~bare).sum() >= high.sum():
        high &= ~bare
    typical = float(values[high].mean()) if high.any() else 0.0
    least = np.where(plain, np.where(bare | beside, SHARE * typical, cut / 2), max(cut, values[plain].max() / 2))
    strong = (curve > cut) & (values > least)
    if not strong[plain].any():
        strong |= plain & (values == values[plain].max())
    # boilerplate lines below the threshold are passed over from here on, so an advert inside the article does not end it
    usable = np.flatnonzero(plain | strong)
    marks = np.array([lines[i][1].landmark for i in usable])
    chosen = [np.zeros(0, int)]
    for mark in np.unique(marks):
        inside = usable[marks == mark]
        chosen.append(inside[regions(values[inside] > 0, strong[inside], bare[inside], bool(mark))])
    return [lines[i][0] for i in np.sort(np.concatenate(chosen))]


def regions(text: np.ndarray, strong: np.ndarray, bare: np.ndarray, landmark: bool) -> np.ndarray:
    """Places of the lines in regions: content lines, the text lines beside them and what is between them.

    Outside landmarks bare text of a container joins text blocks only if it is content by itself.
    """
    if not strong.any():
        return np.zeros(0, int)
    joins = text if landmark or (bare & strong).sum() * 2 > strong.sum() else text & (strong | ~bare)
    at = np.flatnonzero(joins)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at) > (LINKS + 1 if landmark else 1)) + 1])
    ends = np.concatenate([starts[1:], [len(at)]]) - 1
    runs = np.flatnonzero(np.add.reduceat(strong[at].astype(int), starts))
    out: list[list[int]] = []
    for first, last in zip(at[starts[runs]].tolist(), at[ends[runs]].tolist(), strict=True):
        if out and first - out[-1][1] <= LINKS:
            out[-1][1] = last
        else:
            out.append([first, last])
    if landmark:  # its ends count as text
        out[0][0] *= out[0][0] >= LINKS
        out[-1][1] = len(text) - 1 if out[-1][1] >= len(text) - LINKS else out[-1][1]
    return np.concatenate([np.arange(first, last + 1) for first, last in out])


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = [(" ".join("".join(x.text).split()), x) for x in parser.lines if x.weight]
    lines = [(t, x) for t, x in lines if t]
    if not lines:
        return ""
    # landmarks of nothing but links still are what the page calls its content
    return "\n".join(content(lines) or [t for t, x in lines if x.landmark and x.weight == 1])


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without the html and with its main text, which replaces a column of that name."""
    kept = [c for c in pages.columns if c not in (html, text)]
    schema = pages.select(*kept).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(h.as_py()) for h in batch.column(html)), pa.string(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], schema.fieldNames())

    return pages.mapInArrow(run, schema)
