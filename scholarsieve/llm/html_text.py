"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser feeds events; the text between block boundaries makes one line, with its
characters, tags and link characters. Text-to-tag ratios are smoothed with a Gaussian, two-means clustering of
the smoothed values finds the threshold, and the lines above it are content. The content region is the smallest
container that holds nearly all content text; an article or main element on the way down ends the search. All
lines of the region are kept, so short paragraphs and headings of the article survive.

Lines inside menus, headers, footers, sidebars, adverts, scripts and styles (by element or role) never count; nor do
those inside forms and blocks whose class or id names boilerplate, unless these hold the page's largest article or
main element, or nearly all text of the page or of the article around them (`_lifted`), or nothing else is left. Outside
of an article or main element, lists made of links alone below the threshold don't count either.

Nulls and edge cases: null or empty html gives an empty text; pages without markup give their text; unclosed and
stray tags are tolerated; a page whose every line is boilerplate by element or role gives an empty text; a head without end tag ends at the body,
at the first element that can't be in it, or at text; rows with equal page_ids each
give a row; other columns are ignored.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
SHARE = 0.85  # of the content text that a container must hold to be entered

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
                   "sup time tt u var wbr img".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video nav footer aside button select option "
                    "textarea input dialog menu fieldset".split())
CONTAINERS = frozenset("html body main article section div td tr table tbody center".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HEADINGS = frozenset(("h1", "h2"))
_MARKED = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisement|advertising|adsense|adbox|banner|sponsor(?:ed)?|promo(?:tion|ted)?|cookies?|consent|notices?|gdpr|alert|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|signup|sidebar|side-bar|menus?|nav|navbar|navigation|topnav|breadcrumbs?|footer|foot|header|masthead|topbar|comments?|"
    r"commentlist|discussion|disqus|respond|replies|reply|share|sharing|social|related|recommend(?:ed|ations?)?|widget|login|search|searchbox|pagination|pager|"
    r"copyright|legal|disclaimer|skip-link|form|trending|outbrain|taboola)(?![a-z])")
_THREAD = re.compile(r"(?<![a-z])(?:comments?|commentlist|discussion|disqus|respond|replies|reply)(?![a-z])")
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ARTICLES = ("article", "main")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _boilerplate(tag: str, attrs: list) -> bool:
    """By element, role or visibility."""
    if tag in SKIPPED:
        return True
    if tag in ("html", "body", "main", "article") and not any(k in ("class", "id") for k, _ in attrs):
        return False
    for name, value in attrs:
        value = value or ""
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


def _named(tag: str, attrs: list) -> tuple[bool, bool]:
    """(a form or named as boilerplate by class or id, named as a thread of comments)."""
    if tag in ("html", "body", "main", "h1"):
        return False, False
    words = [_CAMEL.sub("-", value or "").lower() for name, value in attrs if name in ("class", "id")]
    return tag == "form" or any(_MARKED.search(w) for w in words), any(_THREAD.search(w) for w in words)


class _Lines(HTMLParser):
    """Lines with their ratio inputs and the containers they lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None, bool]] = []  # tag, container number, boilerplate
        self.named: list[tuple[int, int]] = []  # open elements named as boilerplate: place in the stack, number
        self.threads: list[bool] = []  # per named element
        self.around: list[tuple[int, ...]] = []  # per container, the named elements around it, itself included
        self.skipping = self.links = 0
        self.parents: list[int] = []
        self.names: list[str] = []
        self.lines: list[dict] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.kind = ""

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            inside = [c for _, c, _ in self.stack if c is not None]
            self.lines.append({"text": text, "tags": self.tags, "linked": self.linked, "inside": inside, "kind": self.kind, "named": tuple(k for _, k in self.named)})
        self.parts, self.tags, self.linked = [], 0, 0

    def _pop(self) -> None:
        tag, _, skipped = self.stack.pop()
        self.skipping -= skipped
        if self.named and self.named[-1][0] == len(self.stack):
            self.named.pop()
        self.links -= tag == "a"

    def _end_head(self) -> None:
        while any(t == "head" for t, _, _ in self.stack):
            self._pop()

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head"):
            self._end_head()
        if tag == "br":
            self.parts.append(" ")
            self.tags += 1
            return
        if tag not in INLINE:
            self._end_line()
            for open_tag, closes in (("p", True), ("li", tag == "li"), ("option", tag == "option")):
                if closes and any(t == open_tag for t, _, _ in self.stack[-6:]):
                    at = max(i for i, (t, _, _) in enumerate(self.stack) if t == open_tag)
                    if not any(t in CONTAINERS or t in ("ul", "ol", "table") for t, _, _ in self.stack[at + 1:]):
                        while len(self.stack) > at:
                            self._pop()
            self.kind = tag
        self.tags += 1
        if tag in VOID:
            return
        number = None
        if tag in CONTAINERS:
            number = len(self.names)
            self.names.append(tag)
            self.parents.append(next((c for _, c, _ in reversed(self.stack) if c is not None), -1))
        named, thread = _named(tag, attrs)
        if named and tag not in INLINE:
            self.named.append((len(self.stack), len(self.threads)))
            self.threads.append(thread)
        if number is not None:
            self.around.append(tuple(k for _, k in self.named))
        in_article = any(t in ARTICLES for t, _, _ in self.stack)
        skipped = _boilerplate(tag, attrs) or (named and tag in INLINE) or (tag == "header" and not in_article)
        self.stack.append((tag, number, skipped))
        self.skipping += skipped
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br" and self.stack and self.stack[-1][0] == tag:
            self._pop()

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if not any(t == tag for t, _, _ in self.stack):
            if tag not in INLINE:  # a stray end tag still parts blocks
                self._end_line()
            return
        if tag not in INLINE:
            self._end_line()
        elif next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag) < max((i for i, (t, _, _) in enumerate(self.stack) if t not in INLINE), default=-1):
            return  # an inline end tag doesn't close blocks
        while True:
            last = self.stack[-1][0]
            self._pop()
            if last == tag:
                break
        if tag not in INLINE:
            self.kind = ""

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.skipping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach:reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Two-means threshold: halfway between the means of the two clusters."""
    low, high = values.min(), values.max()
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        now = (below.mean() if len(below) else low, above.mean() if len(above) else high)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def _lifted(parser: _Lines) -> set[int]:
    """Elements named as boilerplate that hold the article all the same."""
    articles = [c for c, name in enumerate(parser.names) if name in ARTICLES]
    lifted: set[int] = set()
    whole, named = np.zeros(len(parser.names)), np.zeros(len(parser.threads))
    for x in parser.lines:
        whole[x["inside"]] += len(x["text"])
        named[list(x["named"])] += len(x["text"])

    def seen() -> np.ndarray:
        out = np.zeros(len(parser.names))
        for x in parser.lines:
            if lifted.issuperset(x["named"]):
                out[x["inside"]] += len(x["text"])
        return out

    best = max(seen()[articles], default=0)
    # The largest article first; outer elements have the smaller numbers.
    for c in sorted(articles, key=lambda c: -whole[c]):
        hiding = [k for k in parser.around[c] if k not in lifted]
        if whole[c] <= best:
            break
        if hiding and not any(parser.threads[k] for k in hiding):
            lifted.update(hiding)
            best = max(seen()[articles])
    total = sum(len(x["text"]) for x in parser.lines)
    inner: dict[int, set[int]] = {}  # named element -> articles and mains around all of it
    for x in parser.lines:
        own = {c for c in x["inside"] if parser.names[c] in ARTICLES}
        for k in x["named"]:
            around = {c for c in own if k not in parser.around[c]}
            inner[k] = inner[k] & around if k in inner else around
    for k in sorted(inner):
        if k in lifted or parser.threads[k]:
            continue
        of = max(inner[k], default=None)
        if of is None and best:
            continue
        if named[k] >= SHARE * (total if of is None else whole[of]):
            lifted.add(k)
            best = max(seen()[articles], default=0)
    return lifted


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.lines
    if parser.threads:
        lifted = _lifted(parser)
        lines = [x for x in lines if lifted.issuperset(x["named"])] or lines
    if not lines:
        return ""
    ratios = np.log1p([len(x["text"]) / max(1, x["tags"]) for x in lines])
    smoothed = smooth(ratios)
    content = smoothed >= threshold(smoothed)
    links_only = np.array([x["linked"] >= 0.9 * len(x["text"]) and x["kind"] not in HEADINGS for x in lines])
    weight = np.array([len(x["text"]) for x in lines]) * (content & ~links_only)
    mass = np.zeros(len(parser.names) + 1)
    for x, w in zip(lines, weight):
        mass[x["inside"]] += w
    region, total = -1, weight.sum()
    while total and (region < 0 or parser.names[region] not in ARTICLES):
        inner = [i for i, p in enumerate(parser.parents) if p == region and mass[i] >= SHARE * total]
        if not inner:
            break
        outside = [k for k, x in enumerate(lines) if (region < 0 or region in x["inside"]) and inner[0] not in x["inside"]]
        # A container without a telling name is entered only if it leaves no running text outside.
        if parser.names[inner[0]] not in ARTICLES and any(content[k] and weight[k] for k in outside):
            break
        region = inner[0]
    if region >= 0 and parser.names[region] == "main":
        inner = [i for i, name in enumerate(parser.names) if name == "article" and mass[i] >= SHARE * total]
        region = inner[0] if inner else region
    whole = region >= 0 and parser.names[region] in ARTICLES
    kept = [x["text"] for k, x in enumerate(lines)
            if (region < 0 or region in x["inside"] or x["kind"] == "h1") and (whole or not (links_only[k] and not content[k]))]
    return " ".join(kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; n_chars counts code points."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
