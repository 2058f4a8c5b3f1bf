"""Main text of web pages from parser events and tag ratios.

The standard library's parser is fed a page and streams events.  Text is cut into lines at block
tags; each line keeps how much text and how many tags it had, how much of it is links, and whether it
lies in an element that is never content (navigation, forms, scripts) or that class, id or role name
such a part.  The text-to-tag ratio per line (raised by ``PRIOR`` within article and main) is smoothed
with a Gaussian and split into two clusters; lines of the upper one are voted for, unless they are
mostly links or only lie beside such lines (their own ratio is under a quarter of the threshold).  The region is the deepest container of all voted lines, or the article or main around
it.  Within the region, blocks without a vote go if they are mostly links, or if they are layout
(div, section) before the first or after the last voted line; everything else of it stays, and all of
an article.  Headings, paragraphs, lists and articles that touch the region join it, and so does the
page's only h1.

Null or empty html, and pages without text, give an empty text.  Markup that the parser refuses
(odd declarations) is skipped, so no page fails a job.  Repeated rows give a row each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from medloom.llm.common import map_batches

SKIP = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "embed", "audio", "video", "button", "select", "option", "textarea", "input", "label", "fieldset", "head", "title", "menu", "dialog", "map", "annotation", "annotation-xml"}
#: Elements that hold text as such; others (div, section, ...) lay out a page.
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "address", "details", "summary", "hr"}
CELLS = {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}
#: How much more the ratios of lines within article and main count.
PRIOR = 2.0
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "br", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | SKIP
#: Start tags that end an open paragraph; items that end their like.
_ENDS_P = BLOCK - {"br", "button", "input", "label", "select", "option", "textarea", "script", "style", "template", "noscript", "iframe", "svg", "canvas", "object", "embed", "audio", "video", "map", "math", "head", "title"}
_LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Names in a class, id or role that mark parts which are not the article: alone, as the last word, or with the words below.
_NAMES = r"(?:ads?|advert\w*|adsense|adbox|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|navigation|nav|navbar|menus?|breadcrumbs?|sidebar|widgets?|footer|header|masthead|comments?|comment-?list|disqus|respond|reply|replies|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|pagination|pager|toolbar|contentinfo|complementary|search|copyright|skip)"
_WORDS = r"(?:areas?|bars?|box(?:es)?|buttons?|containers?|forms?|icons?|inner|items?|links?|lists?|posts?|articles?|stor(?:y|ies)|sections?|slots?|threads?|units?|wrap(?:per)?|\d+)"
_PARTS = re.compile(rf"(?:[\w-]*[_-])?{_NAMES}(?:[_-]{_WORDS})*", re.I)
_ALONE = re.compile(_NAMES, re.I)
#: With these words the name only says what the page around has, or it is the article's own head.
_ABOUT = re.compile(r"(?:.*[_-])?(?:has|no|with|without|hide|show)[_-].*|(?:.*[_-])?(?:article|content|entry|page|post|section|story)[_-]header", re.I)
#: Readers' words, and articles that only point elsewhere.
_COMMENT = re.compile(r"(?:[\w-]*[_-])?(?:comments?|comment-?list|disqus|respond|reply|replies)(?:[_-][\w-]*)?", re.I)
_TEASER = re.compile(r"(?:comment|reply|teaser|promo|sponsored|advert|ad)(?:[_-]\d+)?", re.I)


def _is_part(value: str) -> bool:
    return any(_PARTS.fullmatch(word) and not _ABOUT.fullmatch(word) for word in value.split())


def _part(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """What marks the element as a part: ``comment``, ``part`` or nothing.  Headings and the ids of sections name topics."""
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return ""
    for k, v in attrs:
        if not v or k not in ("class", "id", "role"):
            continue
        if tag == "article":
            found = any(_TEASER.fullmatch(word) for word in v.split())
        else:
            found = bool(_ALONE.fullmatch(v.strip())) if k == "id" and tag == "section" else _is_part(v)
        if found:
            return "comment" if tag == "article" or any(_COMMENT.fullmatch(word) for word in v.split()) else "part"
    return ""


class _Events(HTMLParser):
    """Lines with their measures; containers and named parts are numbered in the order they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int, bool]] = [("", False, 0, 0, False)]  # tag, skipped, container, part, link
        self.parents = [0]
        self.kinds = [""]
        self.parts: list[tuple[int, str, bool]] = [(0, "", False)]  # the part around, what marks it, whether in an article
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []  # pieces, tags, container
        self.text: list[tuple[str, int, bool]] = []  # text, part, link
        self.tags = 0
        self.open: Counter[str] = Counter()

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a declaration that the parser does not know
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)

    def flush(self) -> None:
        if any(x[0].strip() for x in self.text):
            self.lines.append((self.text, self.tags, self.stack[-1][2]))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if tag in _ENDS_P and self.open["p"]:
            self._close({"p"}, BLOCK - {"p"})
        if tag in _LIKE:
            self._close(*_LIKE[tag])
        _, skipped, inside, part, link = self.stack[-1]
        if not skipped:
            skipped = tag in SKIP or any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
            if named := _part(tag, attrs):
                self.parts.append((part, named, bool(self.open["article"] or self.open["main"])))
                part = len(self.parts) - 1
        if tag in BLOCK and tag not in ("p", "li", "br"):
            self.parents.append(inside)
            self.kinds.append(tag)
            inside = len(self.parents) - 1
        self.stack.append((tag, bool(skipped), inside, part, link or tag == "a"))
        self.open[tag] += 1

    def _pop(self, at: int) -> None:
        for x in self.stack[at:]:
            self.open[x[0]] -= 1
        del self.stack[at:]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """End open elements of these kinds, unless one of the others lies in between."""
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] in tags:
                self.flush()
                self._pop(at)
                return
            if self.stack[at][0] in stop:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if not self.open[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                self._pop(at)
                return
            if self.stack[at][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return  # a stray end tag doesn't leave the article

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.text.append((data, *self.stack[-1][3:]))


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and weighted anew."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    same = lambda x: np.convolve(x, kernel)[radius : radius + len(x)]
    return same(values) / same(np.ones(len(values)))


def threshold(values: np.ndarray) -> float:
    """Between two clusters: the middle of their means, iterated until it rests.

    Where the means lie within a factor of two there is one cluster, and its least value is the threshold.
    """
    cut = float(values.mean())
    for _ in range(32):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            return float(values.min())
        new = 0.5 * (low.mean() + high.mean())
        if abs(new - cut) <= 1e-9 * max(1.0, abs(cut)):
            break
        cut = float(new)
    return cut if 2 * low.mean() < high.mean() else float(values.min())


#: Constructs that never end and are passed over one by one; beyond, what is left is stripped of tags.
UNFINISHED = 50
_TAGS = re.compile(r"<[^<>]*>?")


def _read(page: _Events, html: str) -> None:
    """Feed a page in time linear in its length.

    The parser stops at what has no end; asked to go on it would look for that end again from each place behind.  An unfinished
    comment or tag ends with the page, as in browsers, unless a > follows (a quote was not closed): then text goes on behind it.
    """
    page.feed(html)
    for _ in range(UNFINISHED):
        rest = page.rawdata
        if not rest.startswith("<") or page.cdata_elem:
            page.close()
            return
        page.rawdata = ""
        if rest.startswith("<!--") or not (rest[1:2].isalpha() or rest[1:2] in "/!?") and len(rest) == 1:
            return
        end = rest.find(">")
        if end < 0:
            return
        page.feed(rest[end + 1 :])
    rest, page.rawdata = page.rawdata, ""
    page.handle_data(_TAGS.sub(" ", rest))


def extract(html: str | None) -> str:
    """The page's main text: a line per block, white space collapsed; empty if there is none."""
    if not html:
        return ""
    page = _Events()
    _read(page, html)
    page.flush()
    lines = _content(page)
    return "\n".join(lines[i][0] for i in _select(page, lines))


def _select(page: _Events, lines: list[tuple[str, int, int, int]]) -> list[int]:
    """Which lines are content: those of the region that the voted lines span, and text that touches it."""
    if not lines:
        return []
    parents, kinds, n = page.parents, page.kinds, len(page.parents)
    size, links = np.array([len(x[0]) for x in lines], float), np.array([x[3] for x in lines], float)
    at = np.array([x[2] for x in lines])
    linked = 2 * links >= size
    all_size, all_links = _below(at, size, parents), _below(at, links, parents)
    crowded = 2 * all_links >= all_size  # containers that are mostly links
    article, marked = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(1, n):
        article[k] = kinds[k] == "article" and not crowded[k] or article[parents[k]]
        marked[k] = article[k] or kinds[k] == "main" or marked[parents[k]]
    voted = vote(np.array([len(x[0]) / max(1, x[1]) for x in lines]) * np.where(marked[at], PRIOR, 1.0)) & ~linked
    if not voted.any():
        voted = ~linked if not linked.all() else np.ones(len(lines), bool)
    votes = _below(at, voted.astype(float), parents)
    region = 0
    for k in range(1, n):
        if parents[k] == region and votes[k] == votes[0]:
            region = k
    above = []
    k = region
    while k:
        above.append(k)
        k = parents[k]
    region = next((k for k in reversed(above) if kinds[k] in ("article", "main") and not crowded[k]), region)
    named = marked[region]
    inside = np.zeros(n, bool)
    inside[region] = True
    for k in range(region + 1, n):
        inside[k] = inside[parents[k]]
    # the outermost container without votes around each line, if any
    cold = np.full(n, -1)
    for k in range(1, n):
        cold[k] = cold[parents[k]] if cold[parents[k]] >= 0 else k if votes[k] == 0 else -1
    hit = np.flatnonzero(voted)
    first, last = hit[0], hit[-1]
    # in a table that lays out the page, its other cells are no text of the region
    text_kinds = TEXT - CELLS if any(kinds[k] in CELLS for k in above) else TEXT
    heads = [i for i, c in enumerate(at.tolist()) if kinds[c] == "h1" and not linked[i]]
    title = heads[0] if len(heads) == 1 else -1  # the page's only one
    kept = []
    for i, c in enumerate(at.tolist()):
        if not inside[c]:
            continue
        edge, g = not first <= i <= last, int(cold[c])
        if article[c]:
            ok = True
        elif g >= 0 and g != region:
            ok = not crowded[g] and (not edge or kinds[g] in text_kinds) or i == title
        else:
            ok = not (edge and linked[i])
        if ok:
            kept.append(i)
    if not kept:
        return kept
    open_ = {0, *above}

    def touches(i: int) -> bool:
        """Whether only text elements lie between the line and what is around the region."""
        c = int(at[i])
        if named:
            return bool(article[c])
        if i == title:
            return True
        if linked[i] and not article[c]:
            return False
        while c not in open_:
            if kinds[c] not in text_kinds and not article[c]:
                return False
            c = parents[c]
        return True

    start, end = kept[0], kept[-1] + 1
    while start and not inside[at[start - 1]] and touches(start - 1):
        start -= 1
    while end < len(lines) and not inside[at[end]] and touches(end):
        end += 1
    return [*range(start, kept[0]), *kept, *range(kept[-1] + 1, end)]


def vote(ratios: np.ndarray) -> np.ndarray:
    """Lines whose smoothed ratio lies in the upper of two clusters, and not by their neighbours alone."""
    even = smooth(ratios)
    cut = threshold(even)
    return (even >= cut) & (4 * ratios >= cut)


def _below(at: np.ndarray, values: np.ndarray, parents: list[int]) -> np.ndarray:
    """Sums over the lines below each container."""
    out = np.zeros(len(parents))
    np.add.at(out, at, values)
    for k in range(len(parents) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def _content(page: _Events) -> list[tuple[str, int, int, int]]:
    """Text, tags, container and link characters of the lines outside of named parts.

    A part that holds most of the page's text is none, unless it is mostly links, holds readers'
    comments on other text, or lies beside an article.
    """
    named = np.zeros(len(page.kinds), bool)
    for k in range(1, len(page.kinds)):
        named[k] = page.kinds[k] in ("article", "main") or named[page.parents[k]]
    sizes, links, article = np.zeros(len(page.parts)), np.zeros(len(page.parts)), 0
    for pieces, _, container in page.lines:
        for data, part, link in pieces:
            n = len("".join(data.split()))
            sizes[part] += n
            links[part] += n * link
            article += n * (part == 0 and bool(named[container]))
    free = sizes[0]
    for k in range(len(page.parts) - 1, 0, -1):
        sizes[page.parts[k][0]] += sizes[k]
        links[page.parts[k][0]] += links[k]
    dropped = np.zeros(len(page.parts), bool)
    for k in range(1, len(page.parts)):
        around, kind, inner = page.parts[k]
        dropped[k] = dropped[around] or 2 * sizes[k] <= sizes[0] or 2 * links[k] > sizes[k] or kind == "comment" and free > 0 or article > 0 and not inner
    lines, tags = [], 0
    for pieces, more, container in page.lines:
        tags += more
        kept = [x for x in pieces if not dropped[x[1]]]
        if line := " ".join("".join(x[0] for x in kept).split()):
            lines.append((line, tags, container, len(" ".join("".join(x[0] for x in kept if x[2]).split()))))
            tags = 0
    return lines


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; null html, or html without text, gives an empty text."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return work

    return map_batches(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")
