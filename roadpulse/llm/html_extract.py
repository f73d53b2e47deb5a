"""Main text of pages by a tree-structured graphical model.

Each DOM node is main text or not. A node's features give its own potential; a
potential between parent and child says how far they agree. Sum-product
messages go up the tree and down again and leave each node's marginal; text
whose node is more likely main text than not stays. Both potentials are
trained from labelled pages.

Nulls and edges: a null or empty html gives an empty text; a head without an
end tag closes at the first tag or text that cannot stand in it, other unclosed
tags at a tag that implies their end, or where their parents do; a form is read
only if it wraps paragraphs as a page does; trees of any depth are walked without recursion; null
and repeated page_ids keep their rows. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches
from .labelled_pages import labelled_pages

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label"}
# Their text is never read.
SILENT = {"head", "script", "style", "noscript", "template", "button", "select", "option", "textarea", "iframe", "svg", "title"}
# A form is read only if it wraps a page: that many paragraphs and characters.
FORM_PARAS, FORM_CHARS = 2, 300
# Characters of a long paragraph.
LONG = 80
# A new one of these closes an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"optgroup"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"}}
CLOSES |= {"colgroup": {"caption", "colgroup"}} | dict.fromkeys(("tbody", "thead", "tfoot"), {"tbody", "thead", "tfoot", "caption", "colgroup"})
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "optgroup": {"select"}, "rt": {"ruby"}, "rp": {"ruby"}}
SCOPES |= dict.fromkeys(("colgroup", "tbody", "thead", "tfoot"), {"table"})
# All that may stand in a head; anything else ends an open one.
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
# Block elements that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

TAGS = {
    "good": {"article", "main"},
    "head": {"h1", "h2", "h3", "h4", "h5", "h6"},
    "para": {"p", "blockquote", "pre", "figcaption", "dd"},
    "list": {"ul", "ol", "li", "dl", "dt"},
    "table": {"table", "tr", "td", "th", "tbody", "thead"},
    "bad": {"nav", "footer", "header", "aside", "menu"},
    "box": {"div", "section"},
    "page": {"#page", "html", "body", "form", "object", "center"},
    "link": {"a"},
}
# Words in class, id and role names.
HINTS = {
    "good": ("content", "article", "post", "entry", "story", "main", "body", "text"),
    "bad": ("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "menu", "nav", "navigation", "navbar", "breadcrumb", "footer", "header", "sidebar", "side", "aside", "related", "share", "social", "cookie", "notice", "consent", "popup", "modal", "newsletter", "subscribe", "login", "search", "legal", "copyright", "toolbar", "top", "widget", "tags", "contentinfo", "complementary"),
    "said": ("comment", "comments", "respond", "reply", "discussion", "disqus"),
}


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    label: int | None = None
    own: int = 0  # characters of its own text
    below: int = 0  # of its subtree
    linked: int = 0  # of links in its subtree
    paras: int = 0  # paragraphs in its subtree
    long: int = 0  # long paragraphs among its children


@dataclass
class Page:
    nodes: list[Node]
    # (node or -1 for a break between blocks, text) in page order
    texts: list[tuple[int, str]] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self, marks: bool):
        super().__init__(convert_charrefs=True)
        self.marks = marks
        self.page = Page([Node("#page", -1)])
        self.open = [0]
        self.silent = 0

    def _break(self):
        self.page.texts.append((-1, ""))

    def _pop(self):
        tag = self.page.nodes[self.open.pop()].tag
        self.silent -= tag in SILENT
        if tag not in INLINE:
            self._break()

    def _close(self, tags: set[str], scope: set[str]):
        """Close the innermost open element of these tags, within the scope."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.page.nodes[self.open[i]].tag
            if tag in tags:
                while len(self.open) > i:
                    self._pop()
                return
            if tag in scope:
                return

    def _in_head(self) -> bool:
        return self.page.nodes[self.open[-1]].tag == "head"

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self._close({"head"}, {"template"})
        elif tag not in IN_HEAD and self._in_head():
            self._pop()
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "button", "table"})
        if tag in CLOSES and tag != "p":
            self._close(CLOSES[tag], SCOPES.get(tag, set()))
        if tag == "br":
            self.page.texts.append((self.open[-1], " "))
            return
        if tag not in INLINE:
            self._break()
        if tag in VOID:
            return
        given = dict(attrs)
        label = given.get("data-main") if self.marks else None
        names = " ".join(given.get(k) or "" for k in ("class", "id", "role")).lower()
        self.page.nodes.append(Node(tag, self.open[-1], names, None if label is None else int(label)))
        self.open.append(len(self.page.nodes) - 1)
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag}, set())

    def handle_data(self, data):
        if self._in_head() and data.strip():
            self._pop()
        if not self.silent and data:
            self.page.texts.append((self.open[-1], data))


def parse(html: str, marks: bool = True) -> Page:
    """The page's nodes, parents before children, and its texts. `marks`: read
    the marks of training pages; crawled pages use the same name as they like."""
    reader = _Reader(marks)
    reader.feed(html)
    reader.close()
    nodes = reader.page.nodes
    for at, text in reader.page.texts:
        if at >= 0:
            nodes[at].own += len(text.strip())
    if any(n.tag == "form" for n in nodes):
        _drop_controls(reader.page)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        n.below += n.own
        if n.tag == "a":
            n.linked = n.below
        n.paras += n.tag == "p"
        if n.parent >= 0:
            up = nodes[n.parent]
            up.below, up.linked, up.paras = up.below + n.below, up.linked + n.linked, up.paras + n.paras
            up.long += n.tag in TAGS["para"] and n.below >= LONG
    return reader.page


def _drop_controls(page: Page) -> None:
    """Take out the text of forms, but for those that wrap a page."""
    nodes = page.nodes
    chars, paras = [n.own for n in nodes], [int(n.tag == "p") for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        paras[nodes[i].parent] += paras[i]
    gone = [False] * len(nodes)
    for i, n in enumerate(nodes):
        small = n.tag == "form" and (paras[i] < FORM_PARAS or chars[i] < FORM_CHARS)
        gone[i] = small or (i > 0 and gone[n.parent])
        if gone[i]:
            n.own = 0
    page.texts = [(at, t) for at, t in page.texts if at < 0 or not gone[at]]


@lru_cache(maxsize=10_000)
def _named(tag: str, names: str) -> tuple[str, ...]:
    kinds = [k for k, tags in TAGS.items() if tag in tags] or ["other"]
    words = set("".join(c if c.isalnum() else " " for c in names).split())
    return (*(f"tag:{k}" for k in kinds), *(f"hint:{k}" for k, hints in HINTS.items() if words.intersection(hints)))


def _marked(n: Node) -> bool:
    """Its tag or its names say that it is no main text."""
    return bool({"tag:bad", "hint:bad", "hint:said"}.intersection(_named(n.tag, n.names)))


def node_features(n: Node) -> list[str]:
    out = list(_named(n.tag, n.names))
    if n.below:
        out.append(f"links:{int(n.linked / n.below * 3.99)}")
    if n.tag not in INLINE and not _marked(n):
        out.append(f"long:{min(n.long, 3)}")
    if n.tag in TAGS["box"]:
        out.append(f"size:{min(4, len(str(n.below)))}")
        out.append(f"paras:{min(n.paras, 3)}")
    return out


@lru_cache(maxsize=10_000)
def edge_kind(tag: str, names: str) -> str:
    """Parents and children are compared apart for these kinds of children."""
    if tag in INLINE:
        return "inline"
    if tag in TAGS["box"] | TAGS["good"] | TAGS["page"]:
        return "box"
    if tag in TAGS["bad"] or any(f.startswith("hint:") for f in _named(tag, names)):
        return "marked"
    return "block"


def _through(odds: float, none: tuple[float, float], one: tuple[float, float]) -> float:
    """Log odds that a neighbour's log odds give through an edge; `none` and
    `one` weigh the neighbour's two states for either state of this node."""
    r = math.exp(max(-50.0, min(50.0, odds)))
    return math.log((one[0] + one[1] * r) / (none[0] + none[1] * r))


@dataclass
class Model:
    weights: dict[str, float]  # log odds of main text
    edges: dict[str, np.ndarray]  # potentials [parent, child]
    root: float  # log odds of the page itself

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of main text for each node, by messages up and down. With two
        states a message is one number, its log odds."""
        weight, tables = self.weights.get, {k: e.tolist() for k, e in self.edges.items()}
        gathered = [sum(weight(f, 0.0) for f in node_features(x)) for x in nodes]
        gathered[0] += self.root
        edge = [tables[edge_kind(x.tag, x.names)] for x in nodes]
        message = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            none, one = edge[i]
            message[i] = _through(gathered[i], none, one)
            gathered[nodes[i].parent] += message[i]
        belief = gathered[:]
        for i in range(1, len(nodes)):
            (a, b), (c, d) = edge[i]
            belief[i] += _through(belief[nodes[i].parent] - message[i], (a, c), (b, d))
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in belief]


def train(pages: list[str], rounds: int = 2000, rate: float = 1.0, keep: float = 3e-4) -> Model:
    """Node weights by logistic regression, edge potentials by smoothed counts."""
    rows, labels, edges, roots = [], [], {k: np.ones((2, 2)) for k in ("inline", "box", "marked", "block")}, np.ones(2)
    for html in pages:
        nodes, y = parse(html).nodes, []
        for i, n in enumerate(nodes):
            y.append(n.label if n.label is not None else (y[n.parent] if i else 0))
            rows.append(node_features(n))
            if i:
                edges[edge_kind(n.tag, n.names)][y[n.parent], y[i]] += 1
        roots[y[0]] += 1
        labels += y
    names = sorted({f for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
    y, w = np.array(labels, float), np.zeros(len(names))
    for _ in range(rounds):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + keep * w)
    agree = {k: e / e.sum(axis=1, keepdims=True) for k, e in edges.items()}
    return Model(dict(zip(names, w.tolist(), strict=True)), agree, float(np.log(roots[1] / roots[0])))


def extract(model: Model, html: str | None) -> str:
    """The main text: blocks in page order, white space as one space."""
    if not html:
        return ""
    page = parse(html, marks=False)
    main = [m > 0.5 for m in model.marginals(page.nodes)]
    blocks: list[list[str]] = [[]]
    for at, text in page.texts:
        if at < 0:
            if blocks[-1]:
                blocks.append([])
        elif main[at]:
            blocks[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(b for b in joined if b)


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    model = train(labelled_pages())

    def run(batches):
        for pdf in batches:
            text = [extract(model, h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
