"""Merkle manifest of a dataset: one tree a source, one tree over the sources, and a version for each tampered leaf.

Leaves are placed in their source by ranges (a source may hold most rows), and RUN ** LEVELS consecutive ones make an aligned
block, a row of one table. Blocks are summed up to one node each; these are the leaves of the next table, until a source has one
node, its subroot. Subroots are the leaves of the top tree, summed up in the same way.

Then the path of each block to the root is handed down, table by table: the digests left and right of it at every level above.
With it a block's task settles its rows alone. Its nodes are a persistent tree: a tampered leaf makes a version that copies the
leaf's ancestors within the block and shares every other node, and the version goes on along the block's path to the root. So
versions are as distributed as blocks, and no task holds more than a block and its path (15 digests a level).

Defined results: `-` stands for a null field; a null source is a tree of its own, first in order. A leaf with a null doc_id comes
first in its source and isn't tampered with. Rows with one id are ordered by leaf. Empty texts are hashed as `0:`. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webinsight.operators.ranks import positions

from . import common

RUN = 16
#: Levels that a block sums up: 256 leaves.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: list[bytes | None]) -> str:
    h = sha256()
    for v in values:
        h.update(b"-" if v is None else b"%d:" % len(v))
        if v is not None:
            h.update(v)
    return h.hexdigest()


def tampered(doc_id: bytes | None) -> bool:
    return doc_id is not None and zlib.crc32(doc_id) % 5 == 0


class Tree:
    """Nodes of a block, made once and never changed: digests, and the children of inner nodes. `height` levels lie above the leaves."""

    def __init__(self, leaves: list[str], height: int, run: int = RUN):
        self.digests, self.children, self.run = list(leaves), [()] * len(leaves), run
        level = list(range(len(leaves)))
        for _ in range(height):
            level = [self.node(tuple(level[i : i + run])) for i in range(0, len(level), run)]
        (self.root,) = level
        self.height = height

    def node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest(self.digests[c] for c in children))
        self.children.append(children)
        return len(self.digests) - 1

    def path(self, leaf: int) -> list[tuple[int, int]]:
        """From the root down to the leaf's parent: (node, place of the next one among its children)."""
        at, out = self.root, []
        for k in range(self.height - 1, -1, -1):
            place = leaf // self.run**k % self.run
            out.append((at, place))
            at = self.children[at][place]
        return out

    def version(self, leaf: int, value: str) -> int:
        """The root of a version in which a leaf has another digest: its ancestors are copied, all else is shared."""
        self.digests.append(value)
        self.children.append(())
        new = len(self.digests) - 1
        for at, place in reversed(self.path(leaf)):
            c = self.children[at]
            new = self.node((*c[:place], new, *c[place + 1 :]))
        return new

    def drop(self, size: int) -> None:
        """Forget the versions made since there were `size` nodes."""
        del self.digests[size:], self.children[size:]

    def siblings(self, leaf: int) -> list[tuple[str, str]]:
        """(left, right) digests beside the path, from the leaf's level up."""
        out = []
        for at, place in reversed(self.path(leaf)):
            c = [self.digests[i] for i in self.children[at]]
            out.append(("".join(c[:place]), "".join(c[place + 1 :])))
        return out


def height(leaves: int, run: int = RUN) -> int:
    """Levels above the leaves of a whole tree; one leaf is its own root."""
    k = 0
    while run**k < leaves:
        k += 1
    return k


def leaves(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, leaf, and changed: the tampered leaf, null where a row isn't tampered with."""
    kinds = {f: docs.schema[f].dataType.simpleString() for f in ("doc_id", "source")}

    def run(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3, 3 + len(FIELDS))]
            a, b = [], []
            for values in zip(*cols, strict=True):
                a.append(leaf_digest(list(values)))
                text = values[-1]
                b.append((leaf_digest([*values[:-1], text.lower()]) if text is not None else a[-1]) if tampered(values[0]) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["uid", "doc_id", "source", "leaf", "changed"])

    fields = [F.col(f).cast("string").cast("binary").alias(f"f{i}") if f != "text" else F.col(f).cast("binary").alias(f"f{i}") for i, f in enumerate(FIELDS)]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", *fields)
    return common.stage(rows.mapInArrow(run, f"uid bigint, doc_id {kinds['doc_id']}, source {kinds['source']}, leaf string, changed string"), "manifest-leaves")


def _blocks(nodes: DataFrame, tree: str, levels: int, run: int) -> DataFrame:
    """nodes (tree, pos, left, ...) -> (tree, block, left, members): `left` is how many levels are missing up to the tree's root."""
    members = F.struct("pos", *(c for c in nodes.columns if c not in (tree, "pos", "left")))
    rows = nodes.groupBy(tree, F.expr(f"pos div {run**levels}").alias("block"), "left").agg(F.array_sort(F.collect_list(members)).alias("members"))
    return common.stage(rows, "manifest-blocks")


def _each(batch: pa.RecordBatch) -> Iterator[list]:
    """Row by row, so that only one block is held as Python objects."""
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


def _sum_up(blocks: DataFrame, tree: str, levels: int, run: int) -> DataFrame:
    """The node that each block comes to: (tree, pos, digest, left)."""
    kind = blocks.schema[tree].dataType.simpleString()

    def go(batches):
        for batch in batches:
            out = []
            for _, _, members, left in _each(batch):
                t = Tree([m["digest"] for m in members], min(levels, left), run)
                out.append((t.digests[t.root], left - t.height))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d for d, _ in out], pa.string()), pa.array([x for _, x in out], pa.int32())], names=[tree, "pos", "digest", "left"])

    digests = F.transform("members", lambda m: F.struct(m["digest"].alias("digest")))
    return blocks.select(tree, F.col("block").alias("pos"), digests.alias("m"), F.col("left").cast("int").alias("left")).mapInArrow(go, f"{tree} {kind}, pos bigint, digest string, left int")


_PATH = "array<struct<before:string,after:string>>"


def _hand_down(blocks: DataFrame, ups: DataFrame, tree: str, levels: int, run: int) -> DataFrame:
    """(tree, pos, path): what lies beside each member of each block at every level up to the tree's root and on to the top."""
    kind = blocks.schema[tree].dataType.simpleString()

    def go(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, members, left, above in _each(batch):
                t = Tree([m["digest"] for m in members], min(levels, left), run)
                path = [[{"before": a, "after": b} for a, b in t.siblings(i)] + above for i in range(len(members))]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(members), batch.schema.field(0).type), pa.array([m["pos"] for m in members], pa.int64()), pa.array(path, batch.schema.field(3).type)], names=[tree, "pos", "path"])

    slim = F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["digest"].alias("digest")))
    rows = _with_paths(blocks, ups, tree).select(tree, slim.alias("members"), F.col("left").cast("int").alias("left"), "path")
    return common.stage(rows.mapInArrow(go, f"{tree} {kind}, pos bigint, path {_PATH}"), "manifest-paths")


def _with_paths(blocks: DataFrame, ups: DataFrame, tree: str) -> DataFrame:
    ups = ups.select(F.col(tree).alias("__tree"), F.col("pos").alias("__pos"), "path")
    return blocks.join(ups, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__pos"))).drop("__tree", "__pos")


def _climb(nodes: DataFrame, tree: str, levels: int, run: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes (tree, pos, digest, left, ...): the tables of blocks from the leaves up, and the roots (tree, pos, digest, left)."""
    tables, now = [], nodes
    while True:
        tables.append(_blocks(now, tree, levels, run))
        now = common.stage(_sum_up(tables[-1], tree, levels, run), "manifest-nodes")
        # Done trees have one block; they stay as they are while others go on.
        most = now.agg(F.max("left")).first()[0] or 0
        if most == 0:
            return tables, now


def _placed(rows: DataFrame, tree: str, order: list, run: int, name: str) -> DataFrame:
    placed = positions(rows, [tree], order, name=name)
    limits = [run**k for k in range(60) if run**k < 1 << 60]
    left = sum((F.when(F.col("group_rows") > n, 1).otherwise(0) for n in limits), F.lit(0))
    return placed.withColumn("left", left).drop("group_rows")


def _settle(blocks: DataFrame, ups: DataFrame, subroots: DataFrame, levels: int, run: int) -> DataFrame:
    """One row per leaf, from its block and the block's path."""
    kind = blocks.schema["members"].dataType.elementType["doc_id"].dataType.simpleString()

    def go(batches):
        for batch in batches:
            key_type = batch.schema.field(0).type.value_type.field("doc_id").type
            for members, left, above, subroot in _each(batch):
                t = Tree([m["digest"] for m in members], min(levels, left), run)
                top = t.digests[t.root]
                for u in above:
                    top = digest((u["before"], top, u["after"]))
                upper = [x for u in above for x in (u["before"], u["after"])]
                proofs, folded, size = [], [], len(t.digests)
                for i, m in enumerate(members):
                    proofs.append(digest([x for pair in t.siblings(i) for x in pair] + upper))
                    if m["changed"] is None or m["changed"] == m["digest"]:
                        folded.append(top)
                        continue
                    now = t.digests[t.version(i, m["changed"])]
                    t.drop(size)
                    for u in above:
                        now = digest((u["before"], now, u["after"]))
                    folded.append(now)
                text = lambda x: pa.array(x, pa.string())
                n = len(members)
                cols = [pa.array([m["doc_id"] for m in members], key_type), text([m["digest"] for m in members]), text([subroot] * n), text([top] * n), text(proofs), text(folded), pa.array([f == top for f in folded])]
                cols.append(pa.array([m["pos"] for m in members], pa.int64()))
                cols.append(pa.array([m["changed"] is not None for m in members]))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "place", "tampered"])

    rows = _with_paths(blocks, ups, "source")
    roots = subroots.select(F.col("source").alias("__s"), F.col("digest").alias("subroot"))
    rows = rows.join(roots, F.col("source").eqNullSafe(F.col("__s"))).select("members", F.col("left").cast("int").alias("left"), "path", "subroot")
    return rows.mapInArrow(go, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, place bigint, tampered boolean")


def manifest(docs: DataFrame, levels: int = LEVELS, run: int = RUN) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, place (in its source), tampered."""
    rows = leaves(docs).withColumnRenamed("leaf", "digest")
    first = F.col("doc_id").asc_nulls_first()
    placed = _placed(rows, "source", [first, F.col("digest"), F.col("uid")], run, "manifest-order").drop("uid")
    by_source, subroots = _climb(placed, "source", levels, run)
    over = subroots.select(F.lit(0).alias("top"), "source", "digest")
    over = _placed(over, "top", [F.col("source").asc_nulls_first()], run, "manifest-sources")
    by_top, _ = _climb(over.drop("source"), "top", levels, run)
    spark = docs.sparkSession
    ups = spark.createDataFrame([(0, 0, [])], f"top int, pos bigint, path {_PATH}")
    for blocks in reversed(by_top):
        ups = _hand_down(blocks, ups, "top", levels, run)
    ups = over.join(ups.select(F.col("pos"), "path"), "pos").select("source", F.lit(0).cast("bigint").alias("pos"), "path")
    for blocks in reversed(by_source[1:]):
        ups = _hand_down(blocks, ups, "source", levels, run)
    return _settle(by_source[0], ups, subroots, levels, run)
