"""Main text of web pages: flat text blocks, classified by a decision tree over each block and its neighbours."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import slices

# Elements that end a block (fixed values, from the HTML standard's block-level elements).
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "title", "tr", "ul",
}
# Elements whose content is no text, and those whose content is never the article.
SILENT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "math", "textarea", "title", "head"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "svg"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"}
# Elements that are kept open while their content is read, and those of them that end one of their own kind.
CONTAINERS = (BLOCKS | ASIDE | {"head"}) - {"p", "hr"}
REPEATED = {"li", "dt", "dd", "option", "tr", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Names of classes, ids and roles that mark page furniture (fixed values). A name is split at hyphens and underscores. A plain
# mark counts if it begins or ends the name; a weak one only if all other parts are marks or words of layout too.
PLAIN_MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "footer", "sidebar", "widget", "cookie", "cookies", "consent", "popup", "modal", "newsletter", "subscribe",
    "signup", "login", "comments", "disqus", "masthead", "toolbar", "pagination", "pager", "gdpr", "complementary", "contentinfo",
}
WEAK_MARKS = {
    "side", "aside", "related", "recommended", "share", "social", "notice", "notices", "alert", "overlay", "search", "comment", "reply",
    "replies", "form", "disclaimer", "copyright", "tags", "skip", "header", "topbar",
}
LAYOUT = {"box", "bar", "list", "block", "area", "section", "container", "wrapper", "wrap", "item", "link", "links", "button", "buttons", "site", "page", "top", "bottom", "left", "right", "inner", "outer"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"\S+")


def _names_furniture(name: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", name) if p]
    known = PLAIN_MARKS | WEAK_MARKS
    return bool(parts) and (parts[0] in PLAIN_MARKS or parts[-1] in PLAIN_MARKS or (not known.isdisjoint(parts) and set(parts) <= known | LAYOUT))


def marks(attributes: str) -> tuple[bool, bool]:
    """Whether a start tag's attributes hide its element, and whether they name page furniture."""
    hidden = furniture = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'").rstrip("/"))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            hidden = True
        elif name in ("class", "id", "role"):
            furniture = furniture or any(map(_names_furniture, value.lower().split()))
    return hidden, furniture


class _Reader:
    """The state of one pass over a page: open elements, and the parts of the block that is being read.

    Containers are kept open, and a paragraph or inline element only if its
    attributes hide it or name furniture. An entry is the element's name and
    whether it is silent, in furniture, and in an article.
    """

    OUTSIDE = ("", False, False, False)

    def __init__(self):
        self.found: list[tuple[str, int, int, bool, bool]] = []
        self.parts: list[tuple[str, bool]] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []
        self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(t for t, _ in self.parts)).split())
            if text:
                linked = sum(len(_WORDS.findall(html.unescape(t))) for t, in_link in self.parts if in_link)
                top = self.stack[-1] if self.stack else self.OUTSIDE
                self.found.append((text, len(text.split()), linked, top[2], top[3]))
            self.parts.clear()

    def text(self, text: str) -> None:
        if text and not (self.stack and self.stack[-1][1]):
            self.parts.append((text, self.links > 0))

    def _inner(self) -> int:
        """Where the paragraph and inline elements above the last container begin."""
        at = len(self.stack)
        while at and self.stack[at - 1][0] not in CONTAINERS:
            at -= 1
        return at

    def start(self, name: str, attributes: str) -> None:
        container = name in CONTAINERS
        if container or name == "p":
            self.flush()
            for at in range(self._inner(), len(self.stack)):
                if self.stack[at][0] == "p":  # a block ends an open paragraph
                    del self.stack[at:]
                    break
            if name in REPEATED and self.stack and self.stack[-1][0] == name:
                self.stack.pop()
        if name == "br":
            self.text(" ")
        elif name == "a":
            self.links += 1
        if name in VOID:
            if name == "hr":
                self.flush()
            return
        hidden, named = marks(attributes) if attributes.strip() else (False, False)
        if name in ("html", "body", "article", "main"):
            named = False
        _, silent, furniture, article = self.stack[-1] if self.stack else self.OUTSIDE
        if container or name == "p":
            furniture = furniture or named or name in ASIDE or (name == "header" and not article)
            if container or hidden or named:
                self.stack.append((name, silent or hidden or name in SILENT, furniture, article or name in ("article", "main")))
        elif hidden or named or name in SILENT:
            # Inside a block only the marked words are left out.
            self.stack.append((name, True, furniture, article))

    def end(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        container = name in CONTAINERS
        if container or name == "p":
            self.flush()
        for at in range(len(self.stack) - 1, -1 if container else self._inner() - 1, -1):
            if self.stack[at][0] == name:
                del self.stack[at:]
                break


def blocks(page: str | None) -> list[tuple[str, int, int, bool, bool]]:
    """Flat text blocks in page order: ``(text, words, words in links, in page furniture, in an article)``.

    A block is the text between two block-level tags, with character references
    decoded and white space turned into one space; a line break is white space.
    Comments, declarations, scripts, styles, the head and hidden elements make
    no block. An end tag closes the elements opened since its start tag; one
    without a start tag closes nothing; elements that are never closed reach to
    the end of the page, as does an unclosed comment, script or tag; a slash at
    the end of a start tag closes nothing.
    """
    page, reader, at = page or "", _Reader(), 0
    while True:
        match = _TOKEN.search(page, at)
        reader.text(page[at : match.start() if match else len(page)])
        if not match:
            break
        at, name = match.end(), (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            reader.end(name)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name in BLOCKS:
                reader.flush()
        else:
            reader.start(name, match[3] or "")
    reader.flush()
    return reader.found


AROUND = (-2, -1, 0, 1, 2)
FEATURES = [f"{kind}_{step:+d}" for step in AROUND for kind in ("words", "link_density")] + ["furniture", "article"]
# The labelled table the tree is trained on, page by page: words, link density, in furniture, in an article, and 1 for main text.
# On the first pages elements and names tell; on the others nothing is marked, and the blocks around decide.
_LINK, _MENU = (1, 1.0, 0, 0, 0), (2, 1.0, 1, 0, 0)
LABELLED_PAGES = [
    [_MENU, _MENU, (1, 1.0, 1, 0, 0), (8, 0.0, 1, 0, 0), (10, 0.0, 0, 1, 1), (120, 0.0, 0, 1, 1), (2, 0.0, 0, 1, 1), (60, 0.02, 0, 1, 1), (40, 0.0, 1, 1, 0), (30, 0.0, 0, 1, 1), (9, 0.0, 0, 1, 1), (12, 0.0, 1, 0, 0)],
    [_MENU, (25, 0.8, 1, 0, 0), (6, 0.0, 0, 1, 1), (15, 0.3, 0, 1, 1), (1, 1.0, 0, 1, 1), (9, 1.0, 0, 1, 1), (250, 0.0, 0, 1, 1), (110, 0.0, 1, 1, 0), (60, 0.0, 1, 0, 0), (45, 0.0, 1, 0, 0), (20, 0.1, 1, 0, 0)],
    [(3, 0.0, 0, 1, 1), (8, 0.0, 1, 1, 0), (7, 0.0, 0, 1, 1), (150, 0.02, 1, 0, 0), (1, 0.0, 0, 1, 1), (2, 0.9, 0, 1, 1), (3, 0.5, 1, 1, 0)],
    [(90, 0.0, 1, 0, 0), (4, 0.0, 0, 1, 1), (5, 0.0, 1, 0, 0)], [(12, 0.0, 0, 1, 1)], [(30, 0.0, 1, 0, 0)],
    [(5, 0.0, 0, 1, 1), (12, 0.0, 0, 1, 1), (3, 0.0, 1, 1, 0), (4, 0.0, 0, 1, 1)], [_MENU, (9, 0.0, 0, 1, 1), (70, 0.0, 0, 1, 1), (20, 0.0, 0, 1, 1), (8, 0.2, 0, 1, 1)], [(2, 0.0, 0, 1, 1), (3, 0.0, 0, 1, 1)],
    [_LINK, (4, 0.0, 0, 1, 1), (6, 0.0, 0, 1, 1), (1, 0.0, 0, 1, 1), (2, 1.0, 0, 1, 1)], [*[_LINK] * 2, (1, 0.0, 0, 1, 1), (15, 0.0, 0, 1, 1), (7, 0.0, 0, 1, 1)], [_LINK, (8, 0.0, 1, 0, 0), (7, 0.0, 0, 1, 1), (9, 0.0, 0, 1, 1), _MENU],
    # a menu, a line of advertising, a heading, paragraphs, a line at the foot
    [*[_LINK] * 6, (8, 0.0, 0, 0, 0), (10, 0.0, 0, 0, 1), (120, 0.0, 0, 0, 1), (3, 0.0, 0, 0, 1), (60, 0.0, 0, 0, 1), (130, 0.0, 0, 0, 1), (12, 0.0, 0, 0, 0)],
    [*[_LINK] * 4, (5, 0.0, 0, 0, 0), (7, 0.0, 0, 0, 1), (45, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1), (8, 0.0, 0, 0, 1), (30, 0.05, 0, 0, 1), (20, 0.0, 0, 0, 0)],
    [*[_LINK] * 5, (14, 0.0, 0, 0, 0), (12, 0.0, 0, 0, 1), (200, 0.0, 0, 0, 1), (8, 0.0, 0, 0, 0)],
    [*[_LINK] * 3, (9, 0.0, 0, 0, 0), (4, 0.0, 0, 0, 1), (22, 0.0, 0, 0, 1), (90, 0.0, 0, 0, 1), (6, 0.0, 0, 0, 1), (15, 0.0, 0, 0, 1), (10, 0.1, 0, 0, 0)],
    [*[_LINK] * 3, (11, 0.0, 0, 0, 0), (9, 0.0, 0, 0, 1), (6, 0.0, 0, 0, 1), (3, 0.0, 0, 0, 1), (25, 0.0, 0, 0, 0)],
    [*[_LINK] * 5, (7, 0.0, 0, 0, 0), (11, 0.0, 0, 0, 1), (3, 0.0, 0, 0, 1), (80, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1), (4, 0.0, 0, 0, 1), (6, 0.0, 0, 0, 0)],
    # link lists after the text, none before it
    [(6, 0.0, 0, 0, 1), (80, 0.0, 0, 0, 1), (35, 0.0, 0, 0, 1), (4, 1.0, 0, 0, 0), (6, 0.9, 0, 0, 0), (5, 1.0, 0, 0, 0), (9, 0.1, 0, 0, 0)],
    [(12, 0.9, 0, 0, 0), (25, 0.8, 0, 0, 0), (40, 0.95, 0, 0, 0), (9, 0.0, 0, 0, 1), (70, 0.1, 0, 0, 1), (50, 0.0, 0, 0, 1), (3, 0.7, 0, 0, 0)],
    # text alone
    [(9, 0.0, 0, 0, 1)], [(6, 0.0, 0, 0, 1)], [(5, 0.0, 0, 0, 1), (120, 0.0, 0, 0, 1), (90, 0.02, 0, 0, 1)], [(60, 0.0, 0, 0, 1), (40, 0.0, 0, 0, 1), (55, 0.0, 0, 0, 1)],
]


class Tree:
    """A binary decision tree, grown by Gini impurity until its leaves are pure or too small to split."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 2):
        self.column, self.value = None, float(labels.mean() >= 0.5)
        if depth == 0 or len(labels) < 2 * least or labels.min() == labels.max():
            return
        best = (1e9, None, None)
        for column in range(rows.shape[1]):
            levels = np.unique(rows[:, column])
            for limit in (levels[1:] + levels[:-1]) / 2:
                low = rows[:, column] <= limit
                if min(low.sum(), (~low).sum()) >= least:
                    impurity = sum(part.size * 2 * part.mean() * (1 - part.mean()) for part in (labels[low], labels[~low]))
                    best = min(best, (impurity, column, limit))
        if best[1] is not None:
            _, self.column, self.limit = best
            low = rows[:, self.column] <= self.limit
            self.low = Tree(rows[low], labels[low], depth - 1, least)
            self.high = Tree(rows[~low], labels[~low], depth - 1, least)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.column is None:
            return np.full(len(rows), self.value)
        low = rows[:, self.column] <= self.limit
        found = np.empty(len(rows))
        found[low], found[~low] = self.low.predict(rows[low]), self.high.predict(rows[~low])
        return found


def labelled_table() -> np.ndarray:
    """A row of ``FEATURES`` and the label per block of ``LABELLED_PAGES``."""
    rows = [np.column_stack([features([("", w, w * d, f, a) for w, d, f, a, _ in page]), [y for *_, y in page]]) for page in LABELLED_PAGES]
    return np.concatenate(rows)


def train(labelled: np.ndarray | None = None) -> Tree:
    labelled = labelled_table() if labelled is None else labelled
    return Tree(labelled[:, :-1], labelled[:, -1])


def features(found: list[tuple[str, int, float, bool, bool]]) -> np.ndarray:
    """A row of ``FEATURES`` per block of one page; neighbours beyond its ends have zeros."""
    reach = max(AROUND)
    words = np.array([0] * reach + [b[1] for b in found] + [0] * reach, float)
    density = np.array([0] * reach + [b[2] for b in found] + [0] * reach, float) / np.maximum(1, words)
    flags = np.array([b[3:5] for b in found], float).reshape(-1, 2)
    around = [column[reach + step : reach + step + len(found)] for step in AROUND for column in (words, density)]
    return np.column_stack([*around, flags])


def extract_pages(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``; others are ignored).

    ``text`` joins the blocks that the tree takes for main text by a line feed
    in page order; a null or empty page, and one without main text, has an
    empty text. Repeated rows and null ids are kept as they come.
    """
    tree = tree or train()

    def run(batches):
        for part in slices(batches, "html"):
            by_page = [blocks(page) for page in part.column("html").to_pylist()]
            rows = [features(found) for found in by_page if found]
            kept = iter(tree.predict(np.concatenate(rows)) > 0.5 if rows else [])
            texts = ["\n".join([b[0] for b in found if next(kept)]) for found in by_page]
            arrays = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
