"""Main text of web pages by boosted trees over DOM nodes, decoded down the tree.

Each block element gets a vector of its subtree's text, links and elements, its
attribute tokens, its depth and its siblings.  Boosted trees give the log-odds that it
holds main text.  Decoding picks, for the whole tree at once, the kept nodes of
greatest total log-odds under one rule: below a dropped node everything is dropped.
So no text survives under a menu, and one doubtful paragraph does not lose an article.

The trees are fitted on composed pages (``html_pages``): ``n_pages`` of them, from a
fixed seed, on the driver; the fitted trees (some tens of KB) are sent to the tasks.

Text: character references are decoded; white space inside a block becomes one space;
blocks (cut at block elements; ``br`` is white space) are joined in page order by \\n.

Defined results: null or empty html gives an empty text; unclosed and stray tags are
closed as browsers do for paragraphs, list items and table cells; comments, scripts,
styles, titles, templates, drawings, lists of options and what stands in for scripts and
frames never hold text; a drawing or list of options that is not closed ends where the
next block begins or ends; formulas, the fallback of objects and verbatim text are text; no attribute but class, id, role, itemprop, hidden and style is read, whatever it
holds; rows may repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import map_arrow
from .gbt import BoostedTrees
from .html_pages import TOKENS, page_label, pages

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPLIT = re.compile(r"[^a-z0-9]+")
#: Kinds of elements.
RAW = frozenset("script style textarea title noscript iframe noframes noembed".split())
#: Of these, the ones that go on to the end of the page where they are not closed; of the others the tag is ignored then.
OPEN_ENDED = frozenset("script style textarea title template".split())
#: Shown as it stands: no tags or references in it.
VERBATIM = "xmp"
#: Skipped with the elements in them; all but template end at a block, too.
SKIPPED = frozenset("template svg select annotation annotation-xml".split())
BREAKS = "p article section main header footer nav aside form h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table tr td th blockquote pre hr body html"
INLINE = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts menclose mtable mtr mtd semantics object a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input label meta link base source track embed param area col".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": set(), "body": set()}
TAGS = "nav header footer aside form button article main section p h li ul table td blockquote pre div body other".split()
GROUPS = tuple(TOKENS)
TOKEN_GROUP = {t: k for k, g in enumerate(GROUPS) for name in TOKENS[g] for t in [name]}
WIDTH = len(TAGS) + 2 * len(GROUPS) + 16
EXTRACTED = "page_id long, url string, text string, n_chars long"


@lru_cache(None)
def _bounds(name: str) -> re.Pattern:
    """End tags of a raw or skipped element; of a skipped one also start tags of its kind, and tags of blocks that end it."""
    if name in RAW or name == VERBATIM:
        return re.compile(rf"</{name}(?=[\s/>])", re.I | re.A)
    breaks = {"template": "", "select": BREAKS}.get(name, f"{BREAKS} div")
    other = f"|(?P<block></?(?:{'|'.join(breaks.split())})(?=[\\s/>]))" if breaks else ""
    return re.compile(rf"<(?P<end>/?){name}(?=[\s/>])(?P<attrs>[^>]*){other}", re.I | re.A)


def _after(page: str, name: str, at: int) -> int:
    """Where the page goes on after a raw or skipped element whose start tag ends at ``at``; -1: it has no end."""
    depth = 1
    for m in _bounds(name).finditer(page, at):
        if name in SKIPPED:
            if name != "template" and m["block"]:
                return m.start()
            if not m["end"]:
                depth += not m["attrs"].endswith("/")
                continue
        depth -= 1
        if not depth:
            close = page.find(">", m.end())
            return close + 1 if close >= 0 else len(page)
    return -1


class Node:
    __slots__ = ("attrs", "children", "depth", "elements", "groups", "label", "link_chars", "links", "own", "parent", "place", "tag", "text_chars", "marks")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.children, self.groups, self.label = [], None, -1
        self.own = self.text_chars = self.link_chars = self.links = self.elements = self.marks = self.place = 0


def _groups(attrs: str) -> tuple[list[int] | None, bool]:
    """Attribute tokens by group, and whether the element is hidden."""
    out, hidden = None, False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            found = value.lower().split()
            found += [p for v in found for p in SPLIT.split(v)]
            for token in found:
                if (k := TOKEN_GROUP.get(token)) is not None:
                    out = out or [0] * len(GROUPS)
                    out[k] += 1
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return out, hidden


def parse(page: str, label: Callable[[str], int] | None = None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (parents first), and the blocks of text with their element.

    ``label``: reads the labels of composed pages from attributes, for fitting only.
    """
    nodes, blocks, stack = [Node("body", -1, 0)], [], [0]
    piece: list[str] = []
    at, in_link = 0, 0

    def add(raw: str, coded: bool = True) -> None:
        if raw:
            text = html.unescape(raw) if coded and "&" in raw else raw
            piece.append(text)
            if (n := len(text)) and not text.isspace():
                node = nodes[stack[-1]]
                node.own += n
                node.link_chars += n if in_link else 0
                node.marks += text.count(".") + text.count(",")

    def cut() -> None:
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                blocks.append((stack[-1], text))
            piece.clear()

    endless = set()
    while (m := TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name in RAW or name in SKIPPED:
            if end or attrs.endswith("/") or name in endless:
                continue
            stop = _after(page, name, at)
            if stop >= 0:
                at = stop
            elif name in OPEN_ENDED:
                at = len(page)
                break
            else:
                endless.add(name)
            continue
        if name == "head":
            continue
        if name == VERBATIM:
            cut()
            m = None if end else _bounds(name).search(page, at)
            if m:
                add(page[at : m.start()], False)
                cut()
                close = page.find(">", m.end())
                at = close + 1 if close >= 0 else len(page)
            continue
        if name in INLINE:
            if name == "br":
                piece.append(" ")
            elif name == "a":
                in_link = 0 if end else 1
                nodes[stack[-1]].links += 0 if end else 1
            elif name == "input":
                nodes[stack[-1]].elements += 1
            continue
        cut()
        in_link = 0
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == name:
                    del stack[k:]
                    break
            continue
        if name in ("html", "body"):
            if label:
                nodes[0].label = label(attrs)
            continue
        if nodes[stack[-1]].tag == "p" and len(stack) > 1:
            stack.pop()
        if name in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[k]].tag
                if tag in CLOSES[name]:
                    del stack[k:]
                elif tag in SCOPE[name]:
                    break
                elif name not in ("tr", "tbody"):
                    break
        if name in ("hr",):
            continue
        node = Node(name, stack[-1], len(stack))
        node.groups, hidden = _groups(attrs)
        if label:
            node.label = label(attrs)
        if hidden:
            node.groups = node.groups or [0] * len(GROUPS)
            node.groups[GROUPS.index("notice")] += 2
        parent = nodes[stack[-1]]
        node.place = len(parent.children)
        parent.children.append(len(nodes))
        stack.append(len(nodes))
        nodes.append(node)
    add(page[at:])
    cut()
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        node.text_chars += node.own
        if k:
            parent = nodes[node.parent]
            parent.text_chars += node.text_chars
            parent.link_chars += node.link_chars
            parent.links += node.links
            parent.elements += node.elements + 1
            parent.marks += node.marks
    return nodes, blocks


_KIND = {t: k for k, t in enumerate(TAGS)} | {f"h{k}": TAGS.index("h") for k in range(1, 7)} | {"ol": TAGS.index("ul"), "dl": TAGS.index("ul"), "dt": TAGS.index("li"), "dd": TAGS.index("li"), "th": TAGS.index("td"), "tr": TAGS.index("td"), "select": TAGS.index("button"), "fieldset": TAGS.index("form")}


def features(nodes: list[Node]) -> np.ndarray:
    """A row of numbers for each node: tag, attribute tokens (own and of ancestors), densities, depth, siblings."""
    out = np.zeros((len(nodes), WIDTH))
    above = np.zeros((len(nodes), len(GROUPS)))
    whole = max(1, nodes[0].text_chars)
    t, g = len(TAGS), len(GROUPS)
    for k, node in enumerate(nodes):
        row, kind = out[k], _KIND.get(node.tag, len(TAGS) - 1)
        row[kind] = 1
        if node.groups:
            row[t : t + g] = node.groups
        parent = nodes[node.parent] if k else node
        if k:
            above[k] = above[node.parent] + (nodes[node.parent].groups or 0)
        row[t + g : t + 2 * g] = above[k]
        chars, siblings = node.text_chars, len(parent.children)
        pk = _KIND.get(parent.tag, len(TAGS) - 1)
        row[t + 2 * g :] = (
            np.log1p(chars), chars / whole, node.link_chars / max(1, chars), chars / (1 + node.elements), np.log1p(node.own), node.links, node.elements, node.marks / max(1, chars),
            node.depth, siblings, node.place / max(1, siblings), chars / max(1, parent.text_chars), pk, out[node.parent, len(TAGS) + 2 * g + 2] if k else 0, len(node.children), out[node.parent, :5].any() if k else 0,
        )
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The kept nodes of greatest total log-odds, everything below a dropped node being dropped."""
    total, best = odds.copy(), odds.copy()
    for k in range(len(nodes) - 1, 0, -1):
        total[nodes[k].parent] += total[k]
        best[nodes[k].parent] += max(best[k], -total[k])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and best[k] > -total[k]
    return kept


@lru_cache(2)
def fit(n_pages: int = 1200, seed: int = 11) -> BoostedTrees:
    """Trees fitted on ``n_pages`` composed pages."""
    x, y = [], []
    for page in pages(n_pages, seed):
        nodes, _ = parse(page, page_label)
        labels = [n.label for n in nodes]
        for k in range(1, len(nodes)):
            if labels[k] < 0:
                labels[k] = labels[nodes[k].parent]
        x.append(features(nodes))
        y.append(labels)
    return BoostedTrees().fit(np.concatenate(x), np.array([v for part in y for v in part], float))


def main_texts(found: list[str | None], model: BoostedTrees) -> list[str]:
    """Main text of each page."""
    trees = [parse(p) if p else ([], []) for p in found]
    rows = [features(nodes) for nodes, _ in trees if nodes]
    odds = model.log_odds(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for nodes, blocks in trees:
        kept = decode(nodes, odds[at : at + len(nodes)]) if nodes else []
        at += len(nodes)
        out.append("\n".join([text for k, text in blocks if kept[k]]))
    return out


def extract(pages_table: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of (page_id, url, html)."""
    shared = pages_table.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages_table.select("page_id", "url", "html"), run, EXTRACTED)
