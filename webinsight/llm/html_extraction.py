"""HTML extraction: gradient-boosted trees over DOM-node features, and hierarchical decoding.

A page is parsed into a tree of container and block nodes (inline markup belongs to its block). Each node's features are its tag
group and those of its ancestors, depth, own and subtree text, link, mark and tag density of the subtree, children, siblings (how
many, of the same tag, their share of text, place among them), and hashed shares of attribute tokens, its own and its ancestors'.

No labels of nodes exist, so the forest learns from SEED_PAGES pages at most (first by a hash of the URL) and SEED_NODES different
nodes of them at most (first by a hash of their features), whose nodes structural rules mark: inside an article or main element, and
not inside furniture by tag or attribute token, is text; furniture and what lies outside is not. Pages without such an element teach
only their furniture. What the rules look at isn't handed to the forest as such: it sees hashed tokens, and every seed page comes
twice, once as it is and once with its attributes and its telling tags (LANDMARKS) taken away, so that densities and surroundings
have to tell text from furniture as well. So pages without landmarks or known class names are judged by likeness.

Decoding: of all choices in which a dropped node drops all below it, the one with the largest sum of log odds, each
weighted by the node's own text, is taken (a sum from the leaves up). So an ancestor and a descendant never contradict.

Text: a block is the text between the starts and ends of block elements; white space in it (and a line break) becomes one space,
references are decoded. Every page is parsed whole, in time linear in its length, in Arrow batches; the forest is broadcast (a
few hundred kB).

Defined results: null or empty html gives an empty text. Bytes that aren't UTF-8 become U+FFFD. Pages that aren't closed, or close
out of order, are read as browsers do in the main: an open paragraph ends at the next block. Repeated rows get equal texts. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, gbdt

SEED_PAGES = 2000
SEED_NODES = 40_000
BUCKETS = 32

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img svg path picture source".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object select option textarea svg canvas audio video button input".split())
FURNITURE = frozenset("nav aside footer form header menu dialog script style noscript template head iframe button select textarea".split())
ROOTS = frozenset("article main".split())
BLOCK_GROUPS = ("p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl", "td th", "table tr tbody thead tfoot", "blockquote pre figure figcaption", "div section", "article main", "nav menu", "aside", "footer", "header hgroup", "form fieldset", "body html")
GROUP = {t: i for i, g in enumerate(BLOCK_GROUPS) for t in g.split()}
#: Tags that a seed page's second copy has as plain containers.
LANDMARKS = frozenset("article main nav menu aside footer header form".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice alert gdpr popup modal overlay comment comments commenter "
    "reply replies disqus discussion sidebar side aside widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer foot header masthead share sharing social follow "
    "newsletter subscribe signup login related recommended more trending tags toolbar search skip legal copyright meta byline hidden".split()
)
_TOKEN = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    inline: bool = False
    own: int = 0  # characters of text
    linked: int = 0
    marks: int = 0
    words: int = 0
    children: list[int] = field(default_factory=list)


class Page(HTMLParser):
    """nodes in page order; text: (node, block number, piece)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0)]
        self.text: list[tuple[int, int, str]] = []
        self.open: list[tuple[str, int]] = [("html", 0)]  # tag, node
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # by tag: where it is in open
        self.blocks: list[int] = [0]  # where block elements are in open
        self.bounds: list[int] = [0]  # and those that aren't paragraphs
        self.block, self.links, self.silent = 0, 0, 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and len(self.open) == 1:
            return
        tokens = tuple(t.lower() for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label", "data-type") and v for t in _TOKEN.findall(v))
        inline = tag in INLINE
        if inline and (not tokens or tag in VOID):
            if tag == "br":
                self.handle_data(" ")
            elif tag not in VOID:
                self._push(tag, self.open[-1][1])
            return
        if not inline:
            self._end_implied(tag)
            self.block += 1
        at = self.open[-1][1]
        self.nodes.append(Node(tag, at, self.nodes[at].depth + 1, tokens, inline))
        self.nodes[at].children.append(len(self.nodes) - 1)
        if tag not in VOID:
            self._push(tag, len(self.nodes) - 1)

    def _push(self, tag, node):
        at = len(self.open)
        self.open.append((tag, node))
        self.places[tag].append(at)
        if tag not in INLINE:
            self.blocks.append(at)
            if tag != "p":
                self.bounds.append(at)
        self.links += tag == "a"
        self.silent += tag in SILENT

    def _pop_to(self, depth):
        while len(self.open) > depth:
            tag, _ = self.open.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                if tag != "p":
                    self.bounds.pop()
            self.links -= tag == "a"
            self.silent -= tag in SILENT

    def _end_implied(self, tag):
        """An open paragraph ends at the next block; an item, cell or row at the next of its kind."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}.get(tag, ())
        stops = {"li": ("ul", "ol", "menu"), "tr": ("table",)}.get(tag, ("table", "tr", "dl"))
        last = lambda names: max((at[-1] for n in names if (at := self.places.get(n))), default=0)
        while (at := last(("p", *ends))) > (last(stops) if ends else self.bounds[-1]):
            self._pop_to(at)
            self.block += 1

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID:
            return
        # An inline element doesn't end across the end of a block.
        if (at := self.places.get(tag)) and (tag not in INLINE or at[-1] > self.blocks[-1]):
            self._pop_to(at[-1])
        if tag not in INLINE:
            self.block += 1

    def handle_data(self, data):
        if self.silent or not data:
            return
        node = self.nodes[self.open[-1][1]]
        self.text.append((self.open[-1][1], self.block, data))
        size = len(data.strip())
        if size:
            node.own += size
            node.linked += size if self.links else 0
            node.marks += sum(map(data.count, ".,;:!?"))
            node.words += len(data.split())


_GROUPS = len(BLOCK_GROUPS) + 1
_PLAIN = 20
N_FEATURES = 2 * _GROUPS + _PLAIN + 2 * BUCKETS
#: Nodes whose features are held as numbers at once.
SLICE = 20_000


@dataclass
class Features:
    """Of a page's nodes: own tag group and tokens, the same of all ancestors (bits), and plain numbers. Rows are built in slices, so a
    page with very many nodes takes bits, not numbers, for each of them."""

    mine: np.ndarray
    above: np.ndarray
    plain: np.ndarray

    def rows(self, at) -> np.ndarray:
        return np.concatenate([self.mine[at], self.above[at], self.plain[at]], axis=1, dtype=float)

    def slices(self) -> Iterator[np.ndarray]:
        for i in range(0, len(self.mine), SLICE):
            yield self.rows(slice(i, i + SLICE))


def features(nodes: list[Node], bare: bool = False) -> Features:
    """bare: as if landmarks were plain containers and no node had attributes."""
    n = len(nodes)
    own = np.array([[x.own, x.linked, x.marks, x.words, 1] for x in nodes], float)
    tree = own.copy()
    for i in range(n - 1, 0, -1):
        tree[nodes[i].parent] += tree[i]
    tags = ["div" if bare and x.tag in LANDMARKS else x.tag for x in nodes]
    up = np.array([max(x.parent, 0) for x in nodes])
    mine = np.zeros((n, _GROUPS + BUCKETS), bool)
    mine[np.arange(n), [GROUP.get(t, _GROUPS - 1) for t in tags]] = True
    if not bare:
        for i, x in enumerate(nodes):
            for t in x.tokens:
                mine[i, _GROUPS + _bucket(t)] = True
    above = np.zeros_like(mine)
    for i in range(1, n):
        np.logical_or(above[up[i]], mine[up[i]], out=above[i])
    # Siblings: how many, of the same tag, and the place among them.
    kinds = Counter((x.parent, t) for x, t in zip(nodes, tags, strict=True))
    same = np.array([kinds[x.parent, t] for x, t in zip(nodes, tags, strict=True)], float)
    around = np.array([len(nodes[x.parent].children) if x.parent >= 0 else 1 for x in nodes], float)
    place = np.zeros(n)
    for x in nodes:
        place[x.children] = np.arange(len(x.children))
    size, linked, marks, words, count = tree.T
    o_size, o_linked, o_marks, o_words, _ = own.T
    parent = tree[up]
    parent[0] = tree[0]
    beside = np.where(np.arange(n) > 0, (parent[:, 0] - size) / np.maximum(around - 1, 1), 0)
    one = lambda a: np.maximum(a, 1)
    plain = np.stack(
        [
            np.array([x.depth for x in nodes], float), np.log1p(o_size), np.log1p(size), size / max(size[0], 1), linked / one(size), o_linked / one(o_size), marks / one(words), o_marks / one(o_words),
            count / one(words), size / one(words), np.array([len(x.children) for x in nodes], float), around, same, same / around, place / around, np.log1p(beside),
            size / one(parent[:, 0]), np.array([x.inline for x in nodes], float), parent[:, 1] / one(parent[:, 0]), np.log1p(words),
        ],
        axis=1,
    )
    return Features(mine, above, plain)


@lru_cache(1 << 16)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def seeds(nodes: list[Node]) -> np.ndarray:
    """1: text, 0: furniture or outside, -1: not marked."""
    out = np.full(len(nodes), -1)
    inside, furniture = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    rooted = any(x.tag in ROOTS or "articlebody" in x.tokens for x in nodes)
    for i, x in enumerate(nodes):
        up = x.parent
        inside[i] = x.tag in ROOTS or "articlebody" in x.tokens or (up >= 0 and inside[up])
        furniture[i] = x.tag in FURNITURE or any(t in FURNITURE_WORDS for t in x.tokens) or (up >= 0 and furniture[up])
        if furniture[i]:
            out[i] = 0
        elif inside[i]:
            out[i] = 1
        elif rooted and x.own:
            out[i] = 0
    return out


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Which nodes stay: the best choice in which nothing stays below a dropped node."""
    odds = np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    # A node's text counts by its length; a container without text of its own only says a little.
    value = odds * np.array([np.log2(2 + x.own) if x.own else 0.25 for x in nodes])
    value[0] = max(value[0], 0.0)
    best = value.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        keep[i] = best[i] > 0 and (x.parent < 0 or keep[x.parent])
    return keep


def main_text(html: str | None, forest: gbdt.Forest) -> str:
    if not html:
        return ""
    page = Page(html)
    if not page.text:
        return ""
    keep = decode(page.nodes, np.concatenate([forest.predict(x) for x in features(page.nodes).slices()]))
    blocks, last = [], None
    for node, block, piece in page.text:
        if keep[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(piece)
    found = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(b for b in found if b)


def fit(pages: DataFrame, seed_pages: int = SEED_PAGES) -> gbdt.Forest:
    hashed = pages.select("html", F.xxhash64("url", "html").alias("at")).filter(F.col("html").isNotNull())
    first = common.stage(hashed.select("at").distinct().orderBy("at").limit(seed_pages), "seed-hashes")
    # Of pages that are the same, one is learnt from.
    one = hashed.join(F.broadcast(first), "at").groupBy("at").agg(F.min("html").alias("html"))
    chosen = common.stage(one.select(F.col("html").cast("binary").alias("html")), "seed-pages")

    def run(batches):
        for batch in batches:
            for html in batch.column(0).to_pylist():
                nodes = Page(html.decode("utf-8", "replace")).nodes
                y = seeds(nodes)
                on = np.flatnonzero(y >= 0)
                if len(on):
                    x = np.concatenate([features(nodes, bare).rows(on) for bare in (False, True)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(y[on], 2).astype(np.int32)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    # Equal nodes count once.
    got = chosen.mapInArrow(run, "y int, x array<double>").groupBy("y", "x").count().orderBy(F.xxhash64("y", "x")).limit(SEED_NODES).select("y", "x").toArrow().combine_chunks()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES) if got.num_rows else np.zeros((0, N_FEATURES))
    return gbdt.fit(x, got["y"].to_numpy().astype(float), trees=60, depth=5)


def extract(pages: DataFrame, seed_pages: int = SEED_PAGES) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    bc = pages.sparkSession.sparkContext.broadcast(fit(pages, seed_pages))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        for batch in batches:
            text = [main_text(h and h.decode("utf-8", "replace"), bc.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
