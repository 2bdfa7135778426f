"""Main text of web pages by the line-block distribution.

Markup is stripped: block elements end a line, so a line is a block's text with white space made one
space. Each line's length is its characters, but 0 in furniture (menus, headers and footers, sidebars,
notices, adverts, forms, scripts, styles, comments by readers; by element, role, or names in class and
id) and in lines that are mostly links.

Lengths are summed over sliding windows of lines. Where the sum rises over a threshold, text surges;
where it falls to 0, it dives. The text is what lies from the first surge to the last dive, without lines
of length 0. The threshold is a share of the greatest sum, 80 characters at most.

Where the page names its article, the sums are taken inside and outside it. If none outside is greater
than the greatest inside, lines outside have length 0; else the name is of a teaser or the like, and all
lines count. A named line is text however short it is: the name lowers its threshold to one character.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

# Each is matched where a "<" stands and never backtracks, so a page is read in linear time.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)  # for pages with a quote that is never closed
_BEGIN = re.compile(r"</?[a-zA-Z]|<[!?]")
_ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))", re.S)
_SPACE = re.compile(r"\s+")
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "title", "select", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
FURNITURE = {"nav", "footer", "aside", "form", "head", "button", "menu", "dialog", "label", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar\w*|aside|footer|foot|header|masthead|topbar|toolbar|cookies?\w*|consent|gdpr|notices?|newsletter|subscribe\w*|sign-?up|login|popup|modal|overlay|comments?|comment-?list|disqus\w*|replies|respond|discussion|related\w*|recommend\w*|share|sharing|social\w*|pagination|pager|widgets?|copyright|legal|disclaimer|skip-?link|hidden|search\w*|form\w*)(?:$|[-_\s\d])", re.I)
ARTICLE = re.compile(r"(?:^|[-_\s])(?:article-?(?:body|content|text)|post-?(?:body|content|text)|entry-?(?:content|text)|story-?(?:body|content)|main-?(?:content|text)|content-?body)(?:$|[-_\s])", re.I)


class Lines:
    """The lines of a page: text, whether furniture holds it, whether a named article does, characters of links."""

    def __init__(self, page: str):
        self.out: list[tuple[str, bool, bool, int]] = []
        self.parts: list[str] = []
        self.links = 0
        self.held = (False, False)
        self.stack: list[tuple[str, bool, bool]] = []
        self.inside: Counter = Counter()  # open elements by name
        self.read(page)

    @property
    def state(self) -> tuple[bool, bool]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.out.append((text, *self.held, self.links))
        self.parts, self.links = [], 0

    def add(self, raw: str) -> None:
        if not raw:
            return
        if self.parts and self.held != self.state and not raw.isspace():  # furniture begins or ends inside a block
            self.end_line()
        if not self.parts:
            self.held = self.state
        self.parts.append(raw)
        if self.inside["a"]:
            self.links += len(raw.strip())

    def open(self, tag: str, attrs: str) -> None:
        furniture, article = self.state
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs.strip(" /") else {}
        name = f"{values.get('class', '')} {values.get('id', '')}".strip()
        role = values.get("role", "").lower()
        named = tag in ("article", "main") or role in ("main", "article") or "articlebody" in values.get("itemprop", "").lower() or bool(name and ARTICLE.search(name))
        hidden = re.search(r"(?:^|[\s/])hidden(?:$|[\s/>])", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)) or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", ""))
        bad = tag in FURNITURE or tag == "header" and not article or role in ROLES or bool(hidden)
        if not bad and name and not named and tag not in ("html", "body", "article", "main"):
            bad = bool(NAMES.search(name))
        if tag == "article" and article and name and NAMES.search(name):  # a reader's comment, marked up as an article
            bad, named = True, False
        self.stack.append((tag, furniture or bad, (article or named) and not (furniture or bad)))
        self.inside[tag] += 1

    def close(self) -> str:
        tag = self.stack.pop()[0]
        self.inside[tag] -= 1
        return tag

    def read(self, page: str) -> None:
        at, tags = 0, _TAG
        while (begin := _BEGIN.search(page, at)) is not None:
            start = begin.start()
            m = None
            if page[start + 1] in "!?":
                mark = _MARK.match(page, start)
                end = mark.end() if mark else None
            else:
                m = tags.match(page, start)
                if m is None and tags is _TAG:  # a quote is open to the end of the page: from here on quotes don't count
                    tags = _LOOSE
                    m = tags.match(page, start)
                end = m.end() if m else None
            if start > at:
                self.add(page[at:start])
            if end is None:  # no ">" to the end of the page
                at = len(page)
                break
            at = end
            if m is None:
                continue
            tag = m[2].lower()
            if tag in BLOCKS:
                self.end_line()
            if m[1]:
                if self.inside[tag]:
                    while self.close() != tag:
                        pass
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = page.find(">", stop.end()) + 1 if stop else 0
                if not at:
                    at = len(page)
                    break
                continue
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
                continue
            if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and self.inside[tag]:  # an open one of the same kind ends here
                while self.stack[-1][0] in ("b", "i", "em", "strong", "span", "a", "u", "font", "small"):
                    self.close()
                if self.stack[-1][0] == tag:
                    self.close()
            self.open(tag, m[3])
        self.add(page[at:])
        self.end_line()


def extract(page: str | None, window: int = 3, share: float = 0.2) -> str:
    """The page's main text; "" if it has none."""
    lines = Lines(page or "").out
    if not lines:
        return ""
    inside = np.array([article and not bad for _, bad, article, _ in lines])
    # links in a named article are text
    size = np.array([0 if bad or (links > 0.6 * len(text) and not article) else len(text) for text, bad, article, links in lines])
    window_sums = lambda x: np.convolve(x, np.ones(window, dtype=int))[window - 1 :]  # noqa: E731  of each line and those after it
    if inside.any() and window_sums(size * ~inside).max() <= window_sums(size * inside).max():
        size = size * inside
    sums = window_sums(size)
    surge = np.flatnonzero((sums >= max(1, min(80, share * sums.max()))) | (inside & (size > 0)))
    if not len(surge):
        return ""
    dive = int(surge[-1])  # text runs on until a window of nothing
    while dive < len(sums) and sums[dive] > 0:
        dive += 1
    return " ".join(t for (t, *_), n in zip(lines[surge[0] : dive], size[surge[0] : dive], strict=True) if n)


def extract_pages(pages: DataFrame, window: int = 3, share: float = 0.2) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages, in one scan without a shuffle.

    Null and empty html: no text, 0 characters. Text without markup is one line. Repeated rows and null
    ids come back as they are; an empty table gives no rows; extra columns are left out.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            t = [extract(x, window, share) for x in b.column(2).to_pylist()]
            yield batch(schema, b.column(0), b.column(1).cast(pa.string()), t, [len(x) for x in t])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
