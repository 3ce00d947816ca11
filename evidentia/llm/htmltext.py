"""Main text of web pages: blocks labelled content or boilerplate by a minimum cut.

A page is cut into blocks (runs of text between block-level tags) under a tree of
containers. Each block is a node between two terminals. Its terminal capacities
are costs of a classifier: what the page says about itself (article, nav, a class
named sidebar, ...) weighs RULE, and a logistic regression over the block's text
weighs its log-odds, up to TEXT. Smoothness edges join neighbouring blocks (the
nearer in the tree, the stronger) and each block with its container, each
container with the one around it. A minimum cut separates content from boilerplate
at the smallest cost; of several, the one with the most content is taken. Nodes
whose own cost outweighs all their edges are settled first, which changes no cut.

The regression learns how marked blocks read (length, links, punctuation) on a
sample of pages of bounded size, so that it can judge pages without any marks.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import partial
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: Costs, in thousandths: of a mark, the most of a text, of two neighbours in one container, of a block or container apart from what is around it.
RULE, TEXT, BESIDE, WITHIN = 12_000, 4_000, 1_000, 600
#: The regression learns from about so many pages, at most so many marked blocks a page and rows together.
FIT_PAGES, FIT_BLOCKS, FIT_ROWS = 400, 64, 20_000

CONTENT, BOILER, SOFT = 1, 2, 3
#: Tags that end the block before them and begin a container.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never shown as text of the page. The first hold raw text, which ends at their end tag alone.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SKIPPED = frozenset("noscript template svg canvas audio video object select button datalist".split())
BOILER_TAGS = frozenset("nav footer aside dialog menu search head".split())
#: Words of class, id and role that mark boilerplate, whole or as the beginning of a word.
BOILER_WORDS = frozenset("nav menu ad ads foot aside notice notices alert search skip copyright disclaimer reply replies respond hidden form complementary contentinfo dialog outbrain taboola".split())
BOILER_STARTS = ("advert", "adsense", "banner", "breadcrumb", "comment", "consent", "cookie", "disqus", "footer", "gdpr", "login", "masthead", "modal", "navbar", "navigation", "newsletter", "pager", "pagination", "popup", "promo", "recommend", "related", "share", "sharing", "sidebar", "signin", "signup", "social", "sponsor", "subscri", "toolbar", "widget")
CONTENT_WORDS = frozenset("article content main post entry story".split())
#: A word after one of these says what a page has or lacks, not what the element is.
ABOUT = frozenset("has no with without".split())

TAG = re.compile(r"""<(?:(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>|!--|[!?/])""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}


class Page:
    """Blocks of a page in order and the tree of their containers."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.links: list[int] = []
        self.tags: list[str] = []
        self.places: list[int] = []
        self.parents, self.depths, self.marks = [-1], [0], [0]


def _mark(tag: str, attributes: str, around: int) -> int:
    """What an element is, by itself and what is around it."""
    if around == BOILER:
        return BOILER
    own = 0
    words: list[str] = []
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name = name.lower()
            value = a or b or c
            if name in ("class", "id", "role"):
                for part in value.split():
                    found = [x.lower() for x in WORD.findall(part)]
                    # what stands behind the first word of an article's class often names its subject
                    words += found[:1] if tag in ("article", "main") else [w for i, w in enumerate(found) if not i or found[i - 1] not in ABOUT]
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                own = BOILER
    if own == BOILER or tag in BOILER_TAGS or any(w in BOILER_WORDS or w.startswith(BOILER_STARTS) for w in words):
        return BOILER
    if around != CONTENT and (tag == "header" or "header" in words):
        return BOILER
    if tag in ("article", "main"):
        return CONTENT
    if around == SOFT or tag in ("form", "fieldset"):
        return SOFT
    return CONTENT if any(w in CONTENT_WORDS for w in words) else around


def parsed(html: str) -> Page:
    """Blocks, containers and marks of a page, however broken its markup."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    unclosed: set[str] = set()
    linked = in_link = 0
    tag_of_block = ""

    def end_block() -> None:
        nonlocal linked, tag_of_block
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                page.texts.append(text)
                page.links.append(min(linked, len(text)))
                page.tags.append(tag_of_block)
                page.places.append(stack[-1][1])
        linked, tag_of_block = 0, stack[-1][0]

    def pop() -> None:
        name, _ = stack.pop()
        opened[name] -= 1

    at = 0
    while True:
        m = TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if not m:
            # What looks like a tag here has no end.
            tail = re.search(r"<[A-Za-z/!?]", text)
            text = text[: tail.start()] if tail else text
        if text:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            end = html.find("-->", m.start() + 2) if m[0] == "<!--" else html.find(">", m.start())
            at = len(html) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = 0
            elif name in BLOCKS:
                end_block()
                if name not in ("html", "body") and opened.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                    tag_of_block = stack[-1][0]
            continue
        if name in RAW or name in SKIPPED:
            if name in unclosed or m[3].endswith("/"):
                continue
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if end:
                at = end.start()
            elif name in RAW:
                break
            else:
                unclosed.add(name)
        elif name == "a":
            in_link = 1
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCKS:
            end_block()
            if opened.get("p"):
                while stack[-1][0] == "p":
                    pop()
            ends, stop = ENDS.get(name, ((), ()))
            if any(opened.get(x) for x in ends):
                i = len(stack) - 1
                while i and stack[i][0] not in ends and stack[i][0] not in stop:
                    i -= 1
                if stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
            if name != "hr":
                around = stack[-1][1]
                page.marks.append(_mark(name, m[3], page.marks[around]))
                page.parents.append(around)
                page.depths.append(page.depths[around] + 1)
                stack.append((name, len(page.parents) - 1))
                opened[name] = opened.get(name, 0) + 1
            tag_of_block = stack[-1][0]
    end_block()
    return page


FEATURES = 8


def features(text: str, linked: int, tag: str) -> list[float]:
    """What the regression sees of a block: length, links, punctuation, kind."""
    words = text.split()
    n = len(words)
    marks = sum(map(text.count, ".,;!?"))
    return [1.0, np.log1p(n), linked / len(text), marks / n, float(text[-1] in ".!?\"'”’…"), min(len(text) / n, 20.0) / 10, float(tag[:1] == "h" and tag[1:].isdigit()), float(n < 4)]


def _distance(page: Page, a: int, b: int) -> int:
    steps = 0
    while a != b:
        if page.depths[a] >= page.depths[b]:
            a = page.parents[a]
        else:
            b = page.parents[b]
        steps += 1
    return steps


def labelled(page: Page, weights: list[float] | None) -> list[bool]:
    """Whether each block is content, by a minimum cut."""
    n = len(page.texts)
    own = [0] * (n + len(page.parents))
    edges: list[dict[int, int]] = [{} for _ in own]

    def join(a: int, b: int, capacity: int) -> None:
        edges[a][b] = edges[a].get(b, 0) + capacity
        edges[b][a] = edges[b].get(a, 0) + capacity

    for i in range(n):
        mark = page.marks[page.places[i]]
        if mark:
            own[i] = RULE if mark == CONTENT else -RULE
        elif weights is not None:
            odds = float(np.dot(weights, features(page.texts[i], page.links[i], page.tags[i]))) * 1000
            own[i] = int(max(-TEXT, min(TEXT, odds)))
        join(i, n + page.places[i], WITHIN)
        if i:
            join(i - 1, i, BESIDE * 2 // (2 + _distance(page, page.places[i - 1], page.places[i])))
    for c, parent in enumerate(page.parents):
        if c:
            join(n + c, n + parent, WITHIN)
    side = minimum_cut(own, edges)
    return side[:n]


def minimum_cut(own: list[int], edges: list[dict[int, int]]) -> list[bool]:
    """True for nodes on the source's side of the minimum cut with the most such nodes.

    own: a node's capacity from the source, or, where negative, to the sink.
    edges: undirected capacities, both ways; they are used up.
    """
    side: list[bool | None] = [None] * len(own)
    total = [sum(e.values()) for e in edges]
    queue = deque(range(len(own)))
    while queue:  # a node whose own capacity covers all its edges lies on that terminal's side
        i = queue.popleft()
        if side[i] is not None or abs(own[i]) < total[i] or (total[i] and own[i] == -total[i]):
            continue
        side[i] = own[i] >= 0
        for j, capacity in edges[i].items():
            own[j] += capacity if side[i] else -capacity
            del edges[j][i]
            total[j] -= capacity
            queue.append(j)
        edges[i].clear()
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        to_sink = _flow(rest, own, edges)
        for i in rest:
            side[i] = i not in to_sink
    return side  # type: ignore[return-value]


def _flow(nodes: list[int], own: list[int], residual: list[dict[int, int]]) -> set[int]:
    """After a maximum flow, the nodes from which the sink can still be reached. Levels from the sink, blocking flows along them."""
    source = {i: own[i] for i in nodes if own[i] > 0}
    sink = {i: -own[i] for i in nodes if own[i] < 0}
    while True:
        level = {i: 1 for i, c in sink.items() if c > 0}
        queue = deque(level)
        while queue:
            j = queue.popleft()
            for i in residual[j]:
                if i not in level and residual[i].get(j, 0) > 0:
                    level[i] = level[j] + 1
                    queue.append(i)
        starts = [i for i, c in source.items() if c > 0 and i in level]
        if not starts:
            return set(level)
        arcs = {i: iter(residual[i]) for i in level}
        ahead: dict[int, int | None] = {}
        for s in starts:
            path = [s]
            while path and source[s] > 0:
                i = path[-1]
                if level[i] == 1 and sink.get(i, 0) > 0:
                    push = min([source[s], sink[i], *(residual[a][b] for a, b in zip(path, path[1:]))])
                    source[s] -= push
                    sink[i] -= push
                    cut = len(path)
                    for k in range(len(path) - 1, 0, -1):
                        a, b = path[k - 1], path[k]
                        residual[a][b] -= push
                        residual[b][a] = residual[b].get(a, 0) + push
                        if not residual[a][b]:
                            cut = k
                    path = path[:cut]
                    continue
                j = ahead.get(i)
                while j is None or not (residual[i].get(j, 0) > 0 and level.get(j) == level[i] - 1):
                    j = next(arcs[i], None)
                    if j is None:
                        break
                ahead[i] = j
                if j is None:
                    path.pop()
                    if path:
                        ahead[path[-1]] = None
                else:
                    path.append(j)


def main_text(html: str | None, weights: list[float] | None) -> tuple[str, int, int]:
    """The page's main text, its number of blocks and how many of them are content."""
    page = parsed(html or "")
    if not page.texts:
        return "", 0, 0
    keep = labelled(page, weights)
    return " ".join(t for t, k in zip(page.texts, keep) if k), len(keep), sum(keep)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, y, x: marked blocks of pages, at most FIT_BLOCKS a page, evenly spread."""
    for batch in batches:
        place, y, x = [], [], []
        for h, html in zip(batch["place"].to_pylist(), batch["html"].to_pylist()):
            page = parsed(html or "")
            marked = [i for i in range(len(page.texts)) if page.marks[page.places[i]]]
            for i in marked[:: -(-len(marked) // FIT_BLOCKS) or 1]:
                place.append(h)
                y.append(int(page.marks[page.places[i]] == CONTENT))
                x.append(features(page.texts[i], page.links[i], page.tags[i]))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["place", "y", "x"])


def train(pages: DataFrame, key: str = "page_id", html: str = "html") -> list[float] | None:
    """Weights of the text regression, from marked blocks of about FIT_PAGES pages taken by the hash of key and html.

    None where no sampled page has marked blocks of both kinds: texts have no weight then.
    """
    n = pages.count()
    if not n:
        return None
    place = F.xxhash64(column(key).cast("string"), column(html))
    share = min(1.0, FIT_PAGES / n)
    rows = pages.select(place.alias("place"), column(html).alias("html")).filter(F.pmod("place", F.lit(1 << 30)) <= int(share * (1 << 30)))
    found = rows.mapInArrow(_sampled, "place long, y int, x array<double>").orderBy("place", "x", "y").limit(FIT_ROWS).collect()
    y = np.array([r["y"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r["x"] for r in found])
    # both kinds weigh the same, however many blocks there are of each
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (balance * (y - p)) - w
        step = np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + np.eye(FEATURES), slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _extracted(batches: Iterator[pa.RecordBatch], weights: list[float] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(h, weights) for h in batch["html"].to_pylist()]
        out = [pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["url"], *out], names=["key", "url", "text", "n_chars", "n_blocks", "n_content"])


def extract(pages: DataFrame, weights: list[float] | None, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, url, text, n_chars, n_blocks, n_content of every row of pages; nothing is shuffled.

    A null or empty page has an empty text, and so has one without content. Rows
    that repeat a key are pages of their own; null keys and urls are kept. Broken
    markup (tags without end, cut character references, text outside all elements) is
    read as browsers read it, as far as blocks go. Other columns don't matter.
    Blocks of equal costs on both sides are content. The text has no line breaks:
    white space in a block is one space, as is what stands between two blocks.
    """
    rows = pages.select(column(key).alias("key"), column("url").alias("url"), column(html).alias("html"))
    kind, url = (rows.schema[c].dataType.simpleString() for c in ("key", "url"))
    found = rows.mapInArrow(partial(_extracted, weights=weights), f"key {kind}, url {url}, text string, n_chars long, n_blocks long, n_content long")
    return found.withColumnRenamed("key", key)
