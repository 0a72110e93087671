"""Filter interaction audit by decision diagrams: what each filter removes in every order of filters, part by part.

A document's failures are a mask of five bits. Documents are summed to (part, mask) counts; of a part these are 32 rows at most,
whatever its size. They make a decision diagram: a node tests one filter, its two branches hold the documents that pass and that
fail it, equal sub-diagrams are one node, and each node carries the counts below it. The path on which every filter passes gives
an order's steps: what the fail branch holds is removed there, what the pass branch holds is kept. Another order is reached by
swapping two adjacent levels, which rebuilds the nodes of these two alone; the orders are walked so that each differs from the one
before by one swap (Steinhaus, Johnson and Trotter), so 120 orders take 119 swaps.

Texts are read once, in Arrow batches, and leave a mask and a hash. A text's copies are found by SHA-256, summed by (text, part,
mask, labels) before texts meet; a text with very many such groups is joined safely.

Defined results: a null text counts as empty (it fails A, and E if another empty text has a smaller id); a null source is the part
''. A row with a null id never fails E and has no labels. Rows with one id and one text don't make each other fail. Several
labels of an id: 1 if any is 1. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = b"#$%&*|"
#: Counts of a mask: documents, of quality 1, toxic.
COUNTS = ("n", "good", "toxic")

_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_CONTINUED = bytes(range(128, 192))
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)


def own_failures(text: bytes) -> int:
    """Bits of A to D, the failures that a text shows by itself."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * len(text.translate(None, _NOT_CAPITAL)) > MAX_CAPITAL_PERCENT * points,
        bool(text.translate(None, _NOT_SYMBOL)),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


def walked_orders(n: int) -> Iterator[int]:
    """The levels to swap with the next one, so that all orders of n filters come up once each, the first one left as it is."""
    at, way = list(range(n)), [-1] * n
    while True:
        for x in range(n - 1, -1, -1):
            i = at.index(x)
            j = i + way[x]
            if 0 <= j < n and at[j] < x:
                at[i], at[j] = at[j], at[i]
                for y in range(x + 1, n):
                    way[y] = -way[y]
                yield min(i, j)
                break
        else:
            return


class Diagram:
    """A decision diagram with counts. Nodes are kept in a table: (pass, fail) -> node; leaves are tuples of counts."""

    def __init__(self, counts: dict[int, tuple[int, ...]], n: int):
        self.order = list(range(n))
        self.nodes: list[tuple[int, int] | None] = []  # branches; None for leaves
        self.weights: list[tuple[int, ...]] = []
        self.table: dict[tuple, int] = {}
        none = (0,) * len(COUNTS)
        level = {m: self.leaf(counts.get(m, none)) for m in range(1 << n)}
        for f in reversed(range(n)):  # filter f has bit f; the last filter is joined first
            level = {m: self.node(level[m], level[m | 1 << f]) for m in range(1 << f)}
        self.root = level[0]

    def leaf(self, counts: tuple[int, ...]) -> int:
        key = ("leaf", counts)
        if key not in self.table:
            self.table[key] = len(self.nodes)
            self.nodes.append(None)
            self.weights.append(counts)
        return self.table[key]

    def node(self, passed: int, failed: int) -> int:
        key = (passed, failed)
        if key not in self.table:
            self.table[key] = len(self.nodes)
            self.nodes.append(key)
            self.weights.append(tuple(a + b for a, b in zip(self.weights[passed], self.weights[failed], strict=True)))
        return self.table[key]

    def swap(self, level: int) -> None:
        """Exchange a level with the next one; nodes above are renewed, those below are shared."""

        def renew(at: int, depth: int, done: dict[int, int]) -> int:
            if at in done:
                return done[at]
            p, f = self.nodes[at]
            if depth < level:
                new = self.node(renew(p, depth + 1, done), renew(f, depth + 1, done))
            else:
                (pp, pf), (fp, ff) = self.nodes[p], self.nodes[f]
                new = self.node(self.node(pp, fp), self.node(pf, ff))
            done[at] = new
            return new

        self.root = renew(self.root, 0, {})
        o = self.order
        o[level], o[level + 1] = o[level + 1], o[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """Along the path of passes: (filter, counts kept after it, counts removed by it)."""
        out, at = [], self.root
        for f in self.order:
            at, failed = self.nodes[at]
            out.append((f, self.weights[at], self.weights[failed]))
        return out


def audit_part(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part, every order and step."""
    n = len(filters)
    d = Diagram(counts, n)
    walked = {tuple(d.order): d.steps()}
    for level in walked_orders(n):
        d.swap(level)
        walked[tuple(d.order)] = d.steps()
    fails, unique, shapley = [0] * n, [0] * n, [0] * n
    for steps in walked.values():
        first, last = steps[0], steps[-1]
        fails[first[0]], unique[last[0]] = first[2][0], last[2][0]
        for f, _, removed in steps:
            shapley[f] += removed[0]
    out = []
    for order in permutations(range(n)):
        name = "".join(filters[f] for f in order)
        for k, (f, kept, removed) in enumerate(walked[order], 1):
            out.append((name, k, kept[0], removed[0], fails[f] - removed[0], unique[f], removed[1], removed[2], shapley[f]))
    return out


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, sha, mask (A to D), of every row; written."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            masks, marks = [], []
            for t in batch.column(2).to_pylist():
                t = t or b""
                masks.append(own_failures(t))
                marks.append(sha256(t).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "sha", "mask"])

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    return common.stage(docs.select("doc_id", part, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, part string, sha binary, mask int"), "audit-masks")


def part_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by all five failures, and how many of them are labelled good and toxic."""
    one = lambda c: F.coalesce(F.max(c), F.lit(0)) == 1
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("is_good"), one("toxic").alias("is_toxic"))
    # Repeated rows fall together before ids meet.
    rows = failures(docs).groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    named = rows.filter("doc_id is not null").join(known, "doc_id", "left")
    rows = named.unionByName(rows.filter("doc_id is null"), allowMissingColumns=True)
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_good", "is_toxic")]
    # An unnamed row can't be the first of its text.
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low")
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    sums = rows.select("doc_id", "part", "sha", "mask", "n", *flags).groupBy("sha", "part", "mask", "is_good", "is_toxic").agg(F.sum("n").alias("n"), low, unnamed)
    sums = common.stage(sums, "audit-texts")
    texts = sums.groupBy("sha").agg(F.count("*").alias("groups"), F.min("low.doc_id").alias("first"))
    rows = common.attach(sums, common.stage(texts, "audit-firsts"), ["sha"], "groups", sums.count())
    # Of a group that has the first id, the rows with that id stay; each id has one row before the sum.
    firsts = F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0) + F.col("unnamed")
    again = F.col("n") - firsts
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), again.alias("n")))).alias("x")
    rows = rows.select("part", "is_good", "is_toxic", both).filter("x.n > 0")
    share = lambda flag: F.sum(F.when(F.col(flag), F.col("x.n")).otherwise(0))
    return rows.groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), share("is_good").alias("good"), share("is_toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    parts = part_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("counts"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches):
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = audit_part({c["mask"]: tuple(c[x] for x in COUNTS) for c in counts})
                order, step, *rest = zip(*got, strict=True)
                cols = [pa.array([part] * len(got), pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32()), *(pa.array(c, pa.int64()) for c in rest)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "filter_order", "step", *names])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in names))
