"""Main text of web pages by line-block distribution.

Markup is stripped to blocks (the lines of the method): scripts, styles, comments and the parts of a
page that are named as menus, headers, footers, sidebars, notices, adverts, forms or reader comments go
with their content; block tags end a line, inline tags do not. Where one container ends or begins without
text of its own an empty line stays. Each line weighs as much as its text outside links. The sums over a sliding window of ``WINDOW`` lines rise at a surge point, where the main
text begins, and fall to nothing at a dive point, where it ends; the lines between are kept.

A page that marks its article is cut by that tag: the article's lines count at least the surge threshold
each and lines outside count nothing, so short paragraphs of an article stay. On other pages the
distribution decides, and the threshold is ``SURGE`` characters, or half the highest sum where that is lower.

Open elements are kept with the ends that HTML implies: a block start closes an open p, a sibling li, dd, td
or tr the former one, and a parent's end its children; a part ends with its element.

Edge cases: a null or empty page has the empty text; tags that are never closed end with their parent, and a
named part that is never closed ends where the article begins, but for comments and sidebars, which have
articles of their own; a raw element other than scripts, styles, titles and text fields that is never closed is its
tag alone, and so is a drawing closed in its own tag; a quote that opens no value is a sign like others; character references that are not known
stay as they are; very long pages are read once, from front to back; repeated rows get equal texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86

# a quote opens a value after an equals sign only; elsewhere it is a sign like others
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s<>]*+"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>=]++|=\s*+(?:" + _VALUE + r"))*+)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=<>/]++)(?:\s*+=\s*+(" + _VALUE + r"))?+", re.S)

# Elements by what they mean for the text.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video"}
#: Of the raw ones, those that XML's short form may close, and those that take the rest of the page where their end is missing.
DRAWN = {"svg", "math"}
TO_THE_END = {"script", "style", "textarea", "title"}
_RAW_ENDS = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*>", re.I) for name in RAW}
PARTS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Attributes that name an element. Each of their tokens is judged as a whole, by its words.
NAMING = {"class", "id", "role"}
_TOKEN_WORDS = re.compile(r"[_-]+")
#: Words that name a part which is not main text.
NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|sidebar|aside|footer|header|masthead"
    r"|breadcrumbs?|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social"
    r"|related|recommended|comments?|disqus|replies|respond|widget|pagination|pager|login|search|toolbar|complementary"
    r"|contentinfo"
)
#: Those of them, and elements, that hold articles of others: one that begins there is no main text.
ASIDE = re.compile(r"sidebar|aside|complementary|related|recommended|comments?|disqus|replies|respond|widget")
#: Words that stand behind such a word without changing what it names,
HOLDERS = re.compile(
    r"area|articles|bar|block|body|box|button|buttons|column|container|content|form|group|holder|icons|inner|item|items|left|links|list"
    r"|outer|panel|posts|right|row|section|slot|stories|text|thread|unit|wrap|wrapper|\d+"
)
#: and words before it that tell what a page or element has or does, not what it is.
STATES = {"has", "have", "no", "not", "with", "without", "is", "show", "hide", "js"}

#: Tags that leave no empty line: of rows and items, and where a paragraph or heading begins.
ITEMS = {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
BEGINS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}

# Ends that HTML implies. A block start closes an open p, ...
CLOSE_P = BLOCKS - {"br", "body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"} | {
    "aside", "dialog", "dir", "footer", "form", "header", "hgroup", "menu", "nav", "search",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: ... and these close the last of a sibling, unless an element of the group was opened since.
SIBLINGS = {
    "li": ({"li"}, "wall"), "dd": ({"dd", "dt"}, "wall"), "dt": ({"dd", "dt"}, "wall"), "option": ({"option"}, "wall"),
    "a": ({"a"}, "block"),
    "td": ({"td", "th"}, "table"), "th": ({"td", "th"}, "table"), "tr": ({"tr"}, "table"),
    **{name: ({"tbody", "thead", "tfoot", "caption"}, "table") for name in ("tbody", "thead", "tfoot")},
}
IN_TABLE = {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "table"}
IN_HEAD = {"head", "base", "link", "meta", *RAW}
# elements that an end tag does not reach beyond: of cells, of blocks (for inline tags), of list items
_BLOCK = (BLOCKS | PARTS | CLOSE_P) - VOID
#: In a whole page the parts end lines too.
WHOLE_BLOCKS = BLOCKS | _BLOCK | {"option", "optgroup"}
_GROUPS = {
    "scope": {"table", "td", "th", "caption"},
    "p": {"table", "td", "th", "caption", "button"},
    "block": _BLOCK,
    "wall": _BLOCK - {"address", "div", "p", "li", "dd", "dt"},
    "table": {"table"},
}


class _Open:
    """The open elements of a page, with the places of each name; one step a tag, however deep they lie."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.low = 0  # the least number that were open since it was set

    def _keys(self, name: str) -> list[str]:
        return [name, *(f"<{group}>" for group, members in _GROUPS.items() if name in members)]

    def last(self, names: set[str]) -> int:
        return max((self.at[name][-1] for name in names if self.at[name]), default=-1)

    def cut(self, size: int) -> None:
        self.low = min(self.low, size)
        while len(self.names) > size:
            for key in self._keys(self.names.pop()):
                self.at[key].pop()

    def _close(self, names: set[str], group: str) -> None:
        """Close the last of the names and all in it, unless one of the group was opened since."""
        found = self.last(names)
        if found >= 0 and found >= self.last({f"<{group}>"}):
            self.cut(found)

    def start(self, name: str) -> None:
        if self.at["head"] and name not in IN_HEAD:
            self.cut(self.at["head"][-1])
        if name in CLOSE_P:
            self._close({"p"}, "p")
        if name in HEADINGS and self.names and self.names[-1] in HEADINGS:
            self.cut(len(self.names) - 1)
        if name in SIBLINGS:
            self._close(*SIBLINGS[name])
        if name not in VOID and name not in {"html", "body"}:
            for key in self._keys(name):
                self.at[key].append(len(self.names))
            self.names.append(name)

    def end(self, name: str) -> None:
        if name in HEADINGS:
            self._close(HEADINGS, "scope")
        elif name in IN_TABLE:
            self._close({name}, "table")
        else:
            self._close({name}, "p" if name == "p" else "wall" if name in {"li", "dd", "dt"} else "scope" if name in _BLOCK else "block")


@dataclass
class Line:
    text: str
    weight: int
    main: bool


def _named(rest: str, names: re.Pattern[str]) -> bool:
    """Whether a token of a naming attribute says that the element is one of these.

    It does when its last word is one of the names, holders left aside, and its first tells no state:
    ``site-header`` and ``comment-list`` do, ``has-sidebar`` and ``share-price`` do not.
    """
    for key, value in _ATTRIBUTE.findall(rest):
        if key.lower() not in NAMING:
            continue
        for token in value.strip("\"'").lower().split():
            words = [word for word in _TOKEN_WORDS.split(token) if word]
            while len(words) > 1 and HOLDERS.fullmatch(words[-1]):
                words.pop()
            if words and names.fullmatch(words[-1]) and words[0] not in STATES:
                return True
    return False


def _part(name: str, rest: str) -> bool:
    if name in PARTS:
        return True
    if name in {"html", "body"} or not rest:
        return False
    # an article is main text whatever it is called, unless it is of a comment or sidebar
    return _named(rest, ASIDE if name in MAIN else NAMES)


def _beside(name: str, rest: str) -> bool:
    return name == "aside" or _named(rest, ASIDE)


def lines(html: str, whole: bool = False) -> list[Line]:
    """The blocks of a page outside of named parts (``whole``: in them too), in page order, with empty ones between containers."""
    out: list[Line] = []
    buffer: list[str] = []
    linked = at = 0
    opened = _Open()
    skipping, beside = -1, False  # place of the part among the open elements
    link = False

    def end(empty: bool = False) -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text or empty:
            out.append(Line(text, max(len(text) - linked, 0), bool(opened.at["article"] or opened.at["main"])))
        buffer.clear()
        linked = 0

    while at < len(html):
        tag = _TAG.search(html, at)
        stop = tag.start() if tag else len(html)
        if stop > at and skipping < 0:
            text = unescape(html[at:stop])
            buffer.append(text)
            linked += len(text.strip()) if link else 0
        if not tag:
            break
        at = tag.end()
        name = (tag["name"] or "").lower()
        closing = bool(tag["close"])
        if not name:
            continue
        if name in RAW:
            if not closing:
                at = _after(html, at, name, tag["rest"].endswith("/"))
            continue
        if skipping < 0 and name in (WHOLE_BLOCKS if whole else BLOCKS):
            end(name not in ITEMS and (closing or name not in BEGINS))
        if closing:
            opened.end(name)
        else:
            if skipping >= 0 and name in MAIN and not beside and not _beside(name, tag["rest"]):
                opened.cut(skipping)
            opened.start(name)
        # a part ends with its element, also where that end is implied
        if opened.low <= skipping:
            skipping = -1
        if skipping < 0 and not closing and not whole and name not in VOID and _part(name, tag["rest"]):
            end(True)
            skipping, beside = len(opened.names) - 1, _beside(name, tag["rest"])
            opened.low = len(opened.names)
        elif skipping < 0 and name == "a":
            link = not closing
    end()
    return out


def _after(html: str, at: int, name: str, closed: bool) -> int:
    """Where the content of a raw element ends. One that is closed in its own tag has none, as far as its kind may be."""
    if closed and name in DRAWN:
        return at
    found = _RAW_ENDS[name].search(html, at)
    if found:
        return found.end()
    return len(html) if name in TO_THE_END else at


def between(weights: np.ndarray, surge: float) -> np.ndarray:
    """Which lines lie between a surge point and the next dive point of the window sums, links among them too."""
    kept = np.zeros(len(weights), bool)
    sums = np.convolve(weights, np.ones(WINDOW))[WINDOW - 1 :] if len(weights) else weights
    inside = False
    for at, total in enumerate(sums.tolist()):
        if not inside and weights[at] and total >= surge:
            inside = True
        elif inside and not total:
            inside = False
        kept[at] = inside
    return kept


def main_text(html: str) -> str:
    """Kept lines of a page, joined by one space."""
    found = lines(html)
    marked = any(line.main and line.text for line in found)
    if marked:
        weights = np.array([max(line.weight, SURGE) if line.main and line.text else 0 for line in found], np.float64)
        surge = float(SURGE)
    else:
        weights = np.array([line.weight for line in found], np.float64)
        highest = np.convolve(weights, np.ones(WINDOW)).max() if len(weights) else 0.0
        surge = min(float(SURGE), highest / 2)
    kept = between(weights, surge)
    return " ".join(line.text for line, keep in zip(found, kept, strict=True) if keep and line.text and (line.main or not marked))


def visible_text(html: str) -> str:
    """All lines of a page, one to a line: menus, notices and forms too, all but raw elements."""
    return "\n".join(line.text for line in lines(html, whole=True) if line.text)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "") for html in batch.column("html")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
