"""Main-text extraction: blocks of a page labelled content or boilerplate by a minimum cut.

A page is read once, tolerantly, into blocks: stretches of text between block-level
tags, each with its chain of open elements. A linear classifier gives a block the
logarithmic odds of being content; they become the capacities of its edges to the two
terminals. Neighbouring blocks, and the next blocks of the same parent, are joined by
smoothness edges, stronger the closer they stand in the tree. The minimum cut of that
graph is the labelling. A block whose own odds outweigh all its smoothness edges keeps
its side in every minimum cut and is folded into its neighbours' capacities first;
what remains goes through max-flow.

Edge cases: null and empty pages have an empty text; unclosed comments and scripts end
with the page; stray end tags are ignored; ``<br>`` is white space; character
references are decoded once; a page without any content block has an empty text;
repeated rows are extracted alike; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

_NAMES = lambda text: frozenset(text.split())
BLOCK_TAGS = _NAMES(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul iframe noscript object template"
)
VOID_TAGS = _NAMES("area base br col embed hr img input link meta param source track wbr")
#: Elements whose text is never shown as text.
DROPPED_TAGS = _NAMES("head title noscript template iframe object select option button textarea svg canvas audio video math datalist applet map")
BOILERPLATE_TAGS = _NAMES("nav footer aside form menu dialog fieldset search")
CONTENT_TAGS = _NAMES("article main")
#: An open element that a start tag closes when both stand in the same container.
CLOSED_BY = {"p": BLOCK_TAGS, "li": _NAMES("li"), "dt": _NAMES("dt dd"), "dd": _NAMES("dt dd"), "tr": _NAMES("tr tbody tfoot thead"), "td": _NAMES("td th tr tbody tfoot"), "th": _NAMES("td th tr tbody tfoot"), "option": _NAMES("option optgroup"), "head": _NAMES("body")}
BOILERPLATE_WORDS = _NAMES(
    "ad ads adsbygoogle advert advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu submenu sidebar rail footer header masthead topbar toolbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login signin register search share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion widget copyright disclaimer legal skip complementary contentinfo"
)
CONTENT_WORDS = _NAMES("article articlebody content main maincontent post postbody entry story storybody text prose")

_RAW = r"<(script|style|textarea|title|xmp)\b[^>]*+>.*?(?:</\1\b[^>]*+>|\Z)"
_TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)>"
TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|{_RAW}|{_TAG}|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_MARKS = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)

#: Weights of ``features``, in units of logarithmic odds: what ``fit`` finds on 2,000 made pages (tests/llm/pages.py, seed 1).
WEIGHTS = (-2.495, 6.021, -15.606, -5.524, -4.114, 0.442, 3.04, 1.951)
MOST_WORDS = 40
#: Capacities of the smoothness edges: neighbours with one parent, neighbours without, next of one parent.
SIBLINGS, NEIGHBOURS, PROXIMITY = 2.0, 0.5, 1.0


@dataclass
class Element:
    tag: str
    parent: Element | None
    content: bool = False
    boilerplate: bool = False
    header: bool = False
    dropped: bool = False
    linked: bool = False
    #: The nearest block-level element, itself included.
    scope: Element | None = None
    #: How many elements of each inline tag are open in this block-level element.
    inline: Counter[str] = field(default_factory=Counter)


@dataclass
class Block:
    text: str
    element: Element
    linked: int = 0
    odds: float = field(default=0.0)


@lru_cache(maxsize=10_000)
def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether an element's class, id, role or property names content or boilerplate."""
    words: set[str] = set()
    for m in _MARKS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words.add(name.lower())
            words.update(w.lower() for w in _PARTS.findall(name))
    return bool(words & CONTENT_WORDS), bool(words & BOILERPLATE_WORDS)


@lru_cache(maxsize=10_000)
def _hidden(attributes: str) -> bool:
    """Whether an element's own attributes hide it."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" and value.strip().lower() != "until-found" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSHOWN.search(value):
            return True
    return False


def _child(tag: str, attributes: str, parent: Element) -> Element:
    new = Element(tag, parent, parent.content, parent.boilerplate, parent.header, parent.dropped, parent.linked or tag == "a")
    new.scope = new if tag in BLOCK_TAGS else parent.scope
    if tag in DROPPED_TAGS or attributes and _hidden(attributes):
        new.dropped = True
    if tag in CONTENT_TAGS:
        new.content = True
        if parent.content and tag == "article" and _marks(attributes)[1]:
            new.boilerplate = True  # a reader's comment may be an article within the article
    elif tag in BOILERPLATE_TAGS:
        new.boilerplate = True
    elif tag == "header":
        new.header = not parent.content
    elif tag not in ("html", "body") and attributes:
        content, boilerplate = _marks(attributes)
        new.boilerplate |= boilerplate
        new.content |= content and not boilerplate
    return new


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order, with white space as one space."""
    root = Element("", None)
    root.scope = root
    now, blocks, parts, linked, at = root, [], [], 0, 0
    opened: Counter[str] = Counter()  # block-level elements by tag

    def end() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append(Block(text, holder, linked))
            parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not now.dropped:
            parts.append(text)
            if now.linked:
                linked += len(text)

    def leave(till: Element) -> None:
        """Closes the open elements within ``till`` and it, too."""
        nonlocal now
        while True:
            gone, now = now, now.parent
            if gone.scope is gone:
                opened[gone.tag] -= 1
            else:
                gone.scope.inline[gone.tag] -= 1
            if gone is till:
                return

    holder = root
    for m in TOKEN.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1] and m[1].lower() == "title":
                end()
            continue
        tag, closing = name.lower(), m[2]
        if tag == "br" or tag == "wbr":
            if tag == "br":
                put(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            end()
        if closing:
            if (opened if block else now.scope.inline)[tag]:
                open_ = now.scope if block else now
                while open_.tag != tag:
                    open_ = open_.parent.scope if block else open_.parent
                leave(open_)
        else:
            if block:
                while (open_ := now.scope) is not root and tag in CLOSED_BY.get(open_.tag, ()):
                    leave(open_)
            if tag not in VOID_TAGS and (block or not m[4].endswith("/")):
                now = _child(tag, m[4], now)
                (opened if block else now.scope.inline)[tag] += 1
        if block:
            holder = now.scope
    if at < len(page):
        put(page[at:])
    end()
    return blocks


def features(block: Block) -> tuple[float, ...]:
    """1; whether in marked content, in marked boilerplate, in a page header; share of linked text; words; whether it ends as a sentence; whether a heading."""
    e, words = block.element, block.text.count(" ") + 1
    heading = len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1].isdigit()
    return (1.0, float(e.content), float(e.boilerplate), float(e.header), min(1.0, block.linked / len(block.text)), float(min(words, MOST_WORDS)), float(block.text[-1] in ".!?…\"'”’"), float(heading))


def log_odds(block: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """How much more likely content than boilerplate the block is by itself."""
    return sum(w * x for w, x in zip(weights, features(block), strict=True))


def fit(blocks: list[Block], labels: list[bool], rounds: int = 50, ridge: float = 0.5) -> tuple[float, ...]:
    """Weights by logistic regression (Newton's method, with a ridge) from labelled blocks."""
    x, y = np.array([features(b) for b in blocks]), np.array(labels, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (chance - y) + ridge * w
        w -= np.linalg.solve((x * (chance * (1 - chance))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return tuple(np.round(w, 3).tolist())


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Capacities between blocks i < j."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        parent = id(b.element.parent)
        if k:
            same = blocks[k - 1].element.parent is b.element.parent
            edges[k - 1, k] = SIBLINGS if same else NEIGHBOURS
        if (j := last.get(parent)) is not None and j < k - 1:
            edges[j, k] = PROXIMITY
        last[parent] = k
    return edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each node, whether a minimum cut leaves it on the side of positive odds.

    The cut's cost is the odds of the nodes on the wrong side plus the capacities
    between nodes on different sides. A node in balance is on the negative side.
    """
    n = len(odds)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        around[i][j] = around[i].get(j, 0.0) + c
        around[j][i] = around[j].get(i, 0.0) + c
    own, side = list(odds), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(own[i]) > sum(around[i].values()):
            side[i] = own[i] > 0
            for j, c in around[i].items():
                own[j] += c if side[i] else -c
                del around[j][i]
                queue.append(j)
            around[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        links = [(number[i], number[j], c) for i in rest for j, c in around[i].items() if i < j]
        reached = _source_side([own[i] for i in rest], links)
        for k, i in enumerate(rest):
            side[i] = reached[k]
    return [bool(s) for s in side]


def _source_side(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a maximum flow, by Dinic's phases, leaves reachable from the source, whose edges are the positive odds."""
    n = len(odds)
    source, sink = n, n + 1
    ends: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(i: int, j: int, there: float, back: float) -> None:
        out[i].append(len(ends))
        out[j].append(len(ends) + 1)
        ends.extend((j, i))
        room.extend((there, back))

    for i, x in enumerate(odds):
        if x > 0:
            edge(source, i, x, 0.0)
        elif x < 0:
            edge(i, sink, -x, 0.0)
    for i, j, c in links:
        edge(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if room[e] > 1e-9 and level[ends[e]] < 0:
                    level[ends[e]] = level[i] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                short = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                i = ends[path[short] ^ 1]
                del path[short:]
                continue
            while at[i] < len(out[i]) and not (room[e := out[i][at[i]]] > 1e-9 and level[ends[e]] == level[i] + 1):
                at[i] += 1
            if at[i] < len(out[i]):
                path.append(out[i][at[i]])
                i = ends[path[-1]]
            elif path:
                i = ends[path.pop() ^ 1]
                at[i] += 1
            else:
                break


def main_blocks(page: str | None) -> list[str]:
    """The texts of a page's content blocks."""
    blocks = blocks_of(page) if page else []
    keep = minimum_cut([log_odds(b) for b in blocks], smoothness(blocks))
    return [b.text for b, k in zip(blocks, keep, strict=True) if k]


def main_text(column: Column) -> Column:
    """The main text of a column of pages, blocks joined by a line feed; empty where there is none."""

    ship_package(SparkSession.active())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series(["\n".join(main_blocks(p if isinstance(p, str) else None)) for p in pages], dtype=object)

    return run(column.cast("string"))
