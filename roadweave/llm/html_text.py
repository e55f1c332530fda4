"""Main text of web pages: a streaming parser's events, text-to-tag ratios smoothed over lines, and clustering by a threshold."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import named

# Elements of HTML by their role.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("aside button canvas dialog footer head header iframe menu nav noscript object script select style svg template textarea title".split())
SECTIONS = frozenset("article main section div td ul ol dl body".split())
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
#: Words of a class, id or role that mark what is not the article.
_NOT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|alert|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disclaimer|disqus|footer|gdpr|header|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|paywall|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.IGNORECASE)

#: A class or id that says what an element has or belongs to, not what it is; and those that say that it is an article, whatever else they say.
_SAYS_ELSE = re.compile(r"(?:has|no|with|without|is|not|category|tag|format|type|status)[_-]", re.IGNORECASE)
_ARTICLE = frozenset("article article-body article-content content entry entry-content hentry main-content post post-content story story-body".split())
#: Characters of text from which a form that holds most of a page's text is taken for a frame around the page.
FORM_PAGE = 500

#: Lines of standard deviation of the smoothing, and the share of the mean ratio from which a line is content.
SIGMA, THRESHOLD = 2.0, 0.5
#: What a line's ratio counts in an article or main element, against one outside.
ARTICLE_WEIGHT = 2.0


@dataclass
class Line:
    """A line's text, its characters in links, its tags, the section and the article or main element (0: none) that hold it, and whether a form does."""

    text: str
    linked: int
    tags: int
    section: int
    region: int
    form: bool = False


def _no_article(value: str) -> bool:
    """Whether the words of a class, id or role mark what is not the article."""
    words = [w for w in value.split() if not _SAYS_ELSE.match(w)]
    return any(map(_NOT_ARTICLE.search, words)) and not any(w.lower() in _ARTICLE for w in words)


class _Lines(HTMLParser):
    """Cuts a page into lines at block elements, in time linear in the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open: list[tuple[str, bool, int]] = []  # element, hidden, section
        self._named: Counter[str] = Counter()  # open elements by name
        self._text: list[str] = []
        self._tags = self._links = self._sections = self._regions = self._in_article = self._hidden = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """`<![...>` is no more than a comment in a page."""
        return self.parse_bogus_comment(i)

    def _section(self) -> int:
        return self._open[-1][2] if self._open else 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append(Line(text, self._links, self._tags, self._section(), self._regions if self._in_article else 0, self._named["form"] > 0))
        self._text, self._tags, self._links = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            return
        if tag in CLOSED_BY_NEXT and self._open and self._open[-1][0] == tag:
            self._pop()
        if tag in ("article", "main"):
            while self._hidden:
                # an unclosed menu or notice ends where the article begins
                self._pop()
            self._regions += not self._in_article
            self._in_article += 1
        hidden = tag in NOT_TEXT or tag not in ("html", "body", "article", "main") and any(v and k in ("class", "id", "role") and _no_article(v) for k, v in attrs) or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        section = self._section()
        if tag in SECTIONS:
            self._sections += 1
            section = self._sections
        self._open.append((tag, hidden, section))
        self._named[tag] += 1
        self._hidden += hidden

    def _pop(self) -> None:
        tag, hidden, _ = self._open.pop()
        self._named[tag] -= 1
        self._hidden -= hidden
        self._in_article -= tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
        if tag in VOID or not self._named[tag]:
            return
        while self._open[-1][0] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._text.append(data)
            if self._named["a"]:
                self._links += len(data)


def _closed(html: str) -> str:
    """The page without beginnings of comments and tags that no end follows: the parser would look for each one's end to the end of the page."""
    at = max(0, html.rfind("-->"))
    html = html[:at] + html[at:].replace("<!--", " ")
    at = html.rfind(">") + 1
    return html[:at] + html[at:].replace("<", "&lt;")


def lines_of(html: str) -> list[Line]:
    """The lines of a page that show text and aren't hidden. Those of forms aren't the page's, unless they hold most of it."""
    parser = _Lines()
    parser.feed(_closed(html))
    parser.close()
    parser._flush()
    lines = parser.lines
    inside = sum(len(x.text) for x in lines if x.form)
    if inside >= FORM_PAGE and 2 * inside > sum(len(x.text) for x in lines):
        return lines
    return [x for x in lines if not x.form]


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at three sigma and its weights at the ends are rescaled."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratio, kernel)[r : r + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[r : r + len(ratio)]


def main_text(html: str | None) -> tuple[str, int]:
    """(text, lines of it) of a page. Null, empty or textless: ("", 0).

    A line's ratio is its text outside links by its tags, ARTICLE_WEIGHT times as much in an article or main element. Ratios are smoothed over
    neighbouring lines of one article, or outside all. Clusters of lines of THRESHOLD times the mean ratio or more select the sections they lie in,
    and a selected section is kept whole unless its text is mostly links.
    """
    lines = lines_of(html) if html else []
    if not lines:
        return "", 0
    own = np.array([max(0, len(x.text) - x.linked) for x in lines], float)
    weight = np.where([x.region > 0 for x in lines], ARTICLE_WEIGHT, 1.0)
    ratio = weight * own / np.array([max(1, x.tags) for x in lines])
    region = np.array([x.region for x in lines])
    edges = np.flatnonzero(np.r_[True, region[1:] != region[:-1], True])
    for a, b in zip(edges, edges[1:], strict=False):
        ratio[a:b] = smoothed(ratio[a:b])
    content = (ratio >= THRESHOLD * ratio.mean()) & (own > 0)
    sums: dict[int, list[float]] = {}
    for x, n in zip(lines, own, strict=True):
        s = sums.setdefault(x.section, [0, 0])
        s[0] += n
        s[1] += len(x.text)
    kept = {x.section for x, c in zip(lines, content, strict=True) if c and sums[x.section][0] >= 0.5 * sums[x.section][1]}
    texts = [x.text for x in lines if x.section in kept]
    return " ".join(texts), len(texts)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns in `keep`, text, n_chars (code points), n_lines. No page is left out, and repeated rows each get a row.

    Null, empty and textless pages: "" and 0. Long pages are read whole, in time linear in their length. Empty table: no rows. Other columns are
    not read; a kept column called like an output: ValueError.
    """
    for c in keep:
        named(c, "text", "n_chars", "n_lines")
    kept = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())],
                names=[*keep, "text", "n_chars", "n_lines"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, n_chars long, n_lines long"
    return df.select(F.col(html_col).cast("string"), *keep).mapInArrow(run, schema)
