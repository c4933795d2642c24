"""Main text of web pages from streaming parser events and text-to-tag ratios.

The parser's events build blocks (the "lines" of a page: text between two block-level tags). A block's ratio is its text
length over the number of its tags. Ratios are smoothed with a Gaussian over neighbouring blocks and parted by a
threshold into two clusters. The upper cluster is the text, with what lies between its blocks or beside them in their
common element, and with the headings and paragraphs next to it, as far as their own smoothed ratios reach a second, low
threshold; only blocks that are mostly links are left out there. Navigation, headers, footers, asides, forms and elements
named as adverts, notices or comments lower the ratio of what is in them; scripts and styles are no text. A comment or tag
that never ends takes what follows with it. All steps take time in proportion to the page, however deep its elements nest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Characters a tag below which no block is text; the part of its ratio that a block in boilerplate counts.
LEAST, BOILERPLATE = 0.01, 1e-6
#: Most tags a character that count: so no block has a smoothed ratio below LEAST for its tags alone, as its own ratio has 0.4 of the weight.
TAGS = 25
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
APART = frozenset("nav header footer aside form menu dialog button select textarea input label fieldset search".split()) | SILENT
PARTING = frozenset(("br", "img", "td", "th", "wbr"))
#: A class or id sets an element apart if it is one of these words, or is made of them and of NEUTRAL ones only.
WORDS = re.compile(r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|comment\w*|disqus|respond|replies|reply|sidebar|widget\w*|related|recommend\w*|share|sharing|social|breadcrumb\w*|menu|nav|navbar|navigation|pagination|pager|footer|header|masthead|copyright|login|search|skip")
ASIDES = re.compile(r"comment\w*|reply|replies|related|teaser\w*|advert\w*|promo\w*")  # those that tell of an article element
NEUTRAL = re.compile(r"site|page|main|global|local|primary|secondary|post|posts|article|articles|story|stories|entry|news|blog|top|bottom|left|right|side|inner|outer|list|item|items|area|bar|box|block|unit|slot|wrap|wrapper|container|holder|group|row|section|panel|button|buttons|btn|link|links|icon|icons|media|text|message|body|form|id|js|\d+")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks next to the main run that continue it.
FLOWING = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption caption".split())
SPACE = re.compile(r"\s+")
OPENING = re.compile(r"<!--|<(script|style)\b", re.IGNORECASE)
MARKUP = re.compile(r"<[a-zA-Z/!?]")
#: An open paragraph or item ends where one of these begins.
CLOSES = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}


@lru_cache(4096)
def set_apart(names: str, words: re.Pattern) -> bool:
    """Whether one of the class or id names says that its element is no part of the text; a name like has-sidebar or site-nav-open does not."""
    for name in names.lower().split():
        parts = [p for p in re.split("[-_]+", name) if p]
        named = [bool(words.fullmatch(p)) for p in parts]
        if name == "side-bar" or (any(named) and all(n or NEUTRAL.fullmatch(p) for n, p in zip(named, parts, strict=True))):
            return True
    return False


def ended(html: str) -> str:
    """``html`` up to a comment or tag that never ends, as browsers take it: all that follows is in it. One pass, so that the parser meets no markup without an end."""
    html = html.replace("<![", "<! [")  # outside foreign elements a marked section is a comment up to the next >
    html = html.replace("<!-->", "").replace("<!--->", "")  # whole comments
    at = 0
    while m := OPENING.search(html, at):
        if m[1]:  # what looks like a comment within a script is none
            close = re.compile(f"</{m[1]}", re.IGNORECASE).search(html, m.end())
            if not close:
                break
            at = close.end()
        elif (close := html.find("-->", m.end())) < 0:
            html = html[: m.start()]
            break
        else:
            at = close + 3
    cut = MARKUP.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


class _Element:
    __slots__ = ("apart", "block", "by_name", "depth", "holds", "linked", "mass", "name", "named", "parent", "prior", "silent", "within")

    def __init__(self, name: str, parent: _Element | None, apart: bool, silent: bool, by_name: bool = False):
        self.name, self.parent, self.apart, self.silent = name, parent, apart, silent
        self.by_name, self.holds = by_name, False  # set apart by its class or id; holds an article or main element
        self.linked = name == "a" or (parent is not None and parent.linked)
        self.prior = name in ("article", "main") or (parent is not None and parent.prior)
        self.depth = parent.depth + 1 if parent else 0
        self.block = parent.block if parent and name not in BLOCKS else self  # the block-level element around
        self.mass, self.named, self.within = 0, False, False  # set once the page is read


class Blocks(HTMLParser):
    """Gathers (text, tags, characters in links, element) blocks of a page while it is parsed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = self.root = _Element("", None, False, False)
        self.blocks: list[tuple[str, int, int, _Element]] = []
        self.parts: list[str] = []
        self.elements: list[_Element] = []
        self.open: dict[str, list[_Element]] = {}  # the open elements of each name
        self.tags = self.links = 0

    def _end_block(self) -> None:
        if text := SPACE.sub(" ", "".join(self.parts)).strip():
            self.blocks.append((text, self.tags, self.links, self.at))
            self.tags = 0
        self.parts = []
        self.links = 0

    def _leave(self, until: _Element) -> None:
        while self.at is not until:
            self.open[self.at.name].pop()
            self.at = self.at.parent

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        if name in BLOCKS:
            self._end_block()
            e = self.at
            while e.name in CLOSES and name in CLOSES[e.name]:
                e = e.parent
            # an inline element that is open within a paragraph does not keep it open
            if e.block.name in CLOSES and name in CLOSES[e.block.name]:
                e = e.block.parent
            self._leave(e)
        self.tags += 1
        if name in VOID:
            if name in PARTING:
                self.parts.append(" ")
            return
        apart, by_name = name in APART, False
        words = ASIDES if name == "article" else WORDS
        for key, value in attrs:
            if value and name not in ("body", "html", "main") and key in ("class", "id") and set_apart(value, words):
                by_name = True
            elif (key == "role" and value in ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and "display:none" in value.replace(" ", "")):
                apart = True
        self.at = _Element(name, self.at, self.at.apart or apart, self.at.silent or name in SILENT, by_name)
        self.elements.append(self.at)
        self.open.setdefault(name, []).append(self.at)

    def handle_startendtag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(name, attrs)
        if name in ("svg", "math") and self.at.name == name:
            self._leave(self.at.parent)

    def handle_endtag(self, name: str) -> None:
        self.tags += 1
        if name in BLOCKS:
            self._end_block()
        elif name == "br":
            self.parts.append(" ")
        own = self.open.get(name)
        # an inline end tag ends nothing outside its block
        if own and (name in BLOCKS or own[-1].depth > self.at.block.depth):
            self._leave(own[-1].parent)

    def handle_data(self, data: str) -> None:
        if not self.at.silent:
            self.parts.append(data)
            if self.at.linked:
                self.links += len(data.strip())

    def done(self) -> list[tuple[str, int, int, _Element]]:
        self.close()
        self._end_block()
        return self.blocks


def smoothed(values: list[float]) -> list[float]:
    """Values weighed with their neighbours by a Gaussian of SIGMA blocks."""
    reach = max(1, math.ceil(3 * SIGMA))
    weights = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(weights, i - reach):
            if 0 <= k < len(values):
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The value that parts values into two clusters: the middle of the clusters' means, found by repetition."""
    cut = sum(values) / len(values)
    for _ in range(30):
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not low or not high:
            return cut
        fresh = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(fresh - cut) < 1e-9:
            break
        cut = fresh
    return cut


def _scores(blocks: list[tuple[str, int, int, _Element]]) -> list[float]:
    """The smoothed ratio of each block; one that elements or their names tell to be no part of the text counts BOILERPLATE of its own, before and after smoothing, so that a long text beside it does not lift it."""
    prior = [BOILERPLATE if e.apart else 1.0 for _, _, _, e in blocks]
    ratios = smoothed([p * len(text) / max(1, min(tags, TAGS * len(text))) for p, (text, tags, _, _) in zip(prior, blocks, strict=True)])
    return [p * r for p, r in zip(prior, ratios, strict=True)]


def _upper(scores: list[float]) -> list[bool]:
    """Whether each block is in the upper cluster, and no boilerplate throughout."""
    cut = min(threshold(scores), max(scores))  # a mean of equal values may round above them
    return [s >= cut and s >= LEAST for s in scores]


def _settle(blocks: list[tuple[str, int, int, _Element]], elements: list[_Element]) -> None:
    """Sets elements apart by their names.

    A name counts for nothing if the element holds an article or main element, or, where no such element with text is
    elsewhere, more than half of the upper cluster's text.
    """
    for e in reversed(elements):  # children before their parents
        if not e.apart:
            e.by_name = e.by_name and not e.holds
            if e.holds or (not e.by_name and e.name in ("article", "main")):
                e.parent.holds = True
    if not any(e.by_name for e in elements):
        return
    for e in elements:  # parents before their children
        e.named = e.by_name or e.parent.named
    everything, prior = 0, False
    for (text, _, _, e), u in zip(blocks, _upper(_scores(blocks)), strict=True):
        prior = prior or (e.prior and not e.named and not e.apart)
        if u:
            everything += len(text)
            e.mass += len(text)
    for e in reversed(elements):
        e.parent.mass += e.mass
    for e in elements:
        if e.by_name and not prior and 2 * e.mass > everything:
            e.by_name = False
        e.apart = e.apart or e.by_name or e.parent.apart
        e.mass = 0


def _selected(blocks: list[tuple[str, int, int, _Element]], elements: list[_Element]) -> list[bool]:
    """The upper cluster's blocks, and of those between them, in their common element or next to these the ones whose own smoothed ratio is LEAST or more."""
    scores = _scores(blocks)
    upper = _upper(scores)
    if not any(upper):
        return upper
    names = [b[3].block.name for b in blocks]
    flows = [s >= LEAST and (2 * links <= len(text) or name in HEADINGS) for s, (text, _, links, _), name in zip(scores, blocks, names, strict=True)]
    core = [k for k, u in enumerate(upper) if u]
    for k in core:
        blocks[k][3].mass += 1
    for e in reversed(elements):
        e.parent.mass += e.mass
    # of the elements that hold every block of the cluster the last to begin is the deepest
    region = next((e for e in reversed(elements) if e.mass == len(core)), None)
    if region is not None and region.name not in ("html", "body"):
        for e in elements:
            e.within = e is region or e.parent.within
    inside = [k for k, b in enumerate(blocks) if b[3].within]
    first, last = min(core + inside), max(core + inside)
    continues = [f and name in FLOWING for f, name in zip(flows, names, strict=True)]
    # boilerplate between two blocks of the text parts nothing
    while (k := next((k for k in range(first - 1, -1, -1) if scores[k] >= LEAST), -1)) >= 0 and continues[k]:
        first = k
    while (k := next((k for k in range(last + 1, len(blocks)) if scores[k] >= LEAST), -1)) >= 0 and continues[k]:
        last = k
    return [first <= k <= last and (upper[k] or flows[k]) for k in range(len(blocks))]


def main_text(html: str | None) -> str:
    """The article's blocks, white space within a block as one space, joined by two line ends; empty if there is none."""
    parser = Blocks()
    parser.feed(ended(html or ""))
    blocks = parser.done()
    if not blocks:
        return ""
    _settle(blocks, parser.elements)
    return "\n\n".join(b[0] for b, k in zip(blocks, _selected(blocks, parser.elements), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html); null or empty html, and a page without text, have an empty text.

    No row meets another, so repeated rows, equal ids and null ids are kept, each judged alone; an empty table gives an empty one; columns of other
    names are not looked at. Blocks of equal ratios fall into one cluster. A page of any length is read whole by one task, in time and memory
    in proportion to it.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(v.as_py()) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
