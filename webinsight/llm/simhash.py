"""SimHash near-dedup with anchor-point covering.

Fingerprints: 64 bits over three-word shingles (repeats count), hashed by XXH64 with seed 42; numpy inside Arrow batches.

Links: the 64 bits are cut into blocks of 23 + 23 + 15 + 3 bits, each covered by a perfect code (Golay, Golay, Hamming,
repetition), so every block is within the code's covering radius (3, 3, 1, 1) of exactly one code word. The products of
code words are the anchors (2^36 of them). A fingerprint is replicated to each anchor within the covering radius plus its
share of the threshold: two fingerprints x, y that differ in t bits have a point m halfway (t/2 bits from either, rounded
up); the anchor that covers m is within radius + ceil(t/2) of both, counting the excess over the radius block by block.
So both meet there: no link is lost, with about 17 replicas at t = 2 (sending one side the whole radius + t instead would
take about 165). Fingerprints are compared per anchor, in a join on the anchor that keeps pairs within the threshold only.
A fingerprint has at most 2080 others within 2 bits, so links grow in proportion to the distinct fingerprints.

Copies collapse to one fingerprint first. Components come from star contraction over the links.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null id is passed through and
never is a component_id unless all ids of the component are null. Repeated rows share their component. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
_CHUNK = 1 << 16


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashes = np.fromiter((digest(text[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, fp: the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=[key, "fp"])

    return docs.select(key, F.col(text).cast("binary").alias("text")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _hamming_columns(width: int) -> list[int]:
    return list(range(1, width + 1))


def _golay_columns() -> list[int]:
    """x^i modulo the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1."""
    out, v = [], 1
    for _ in range(23):
        out.append(v)
        v <<= 1
        if v >> 11:
            v ^= 0b110001110101
    return out


class Block:
    """A perfect code on `width` bits from bit `shift` on: for each syndrome, the error patterns by weight over its radius."""

    def __init__(self, shift: int, columns: list[int], radius: int, excess: int):
        self.shift, self.width, self.columns = shift, len(columns), np.array(columns, np.int64)
        n = 1 << max(columns).bit_length()
        self.patterns = []  # by excess: (syndromes, slots), -1 where there is none
        at = [[[] for _ in range(n)] for _ in range(excess + 1)]
        for weight in range(radius + excess + 1):
            for bits in combinations(range(self.width), weight):
                s = 0
                for i in bits:
                    s ^= columns[i]
                at[max(0, weight - radius)][s].append(sum(1 << i for i in bits))
        for lists in at:
            most = max(map(len, lists), default=0)
            self.patterns.append(np.array([x + [-1] * (most - len(x)) for x in lists], np.int64).reshape(n, most))
        assert self.patterns[0].shape[1] == 1 and (self.patterns[0] >= 0).all(), "not a perfect code"

    def words(self, fp: np.ndarray) -> list[np.ndarray]:
        """By excess: code words in place (rows of fp x slots, uint64), with a mask of those that exist."""
        v = ((fp >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)).astype(np.int64)
        s = np.zeros(len(fp), np.int64)
        for i, c in enumerate(self.columns.tolist()):
            s ^= ((v >> i) & 1) * c
        return [((v[:, None] ^ np.maximum(p[s], 0)).astype(np.uint64) << np.uint64(self.shift), p[s] >= 0) for p in self.patterns]


def code(excess: int) -> list[Block]:
    return [Block(0, _golay_columns(), 3, excess), Block(23, _golay_columns(), 3, excess), Block(46, _hamming_columns(15), 1, excess), Block(61, _hamming_columns(3), 1, excess)]


def anchors_of(fp: np.ndarray, blocks: list[Block], excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all anchors whose distance exceeds the blocks' radii by `excess` at most in total."""
    rows, words = np.arange(len(fp)), np.zeros(len(fp), np.uint64)
    used = np.zeros(len(fp), np.int64)
    for block in blocks:
        options, new = block.words(fp), []
        for e, (word, there) in enumerate(options):
            for slot in range(word.shape[1]):
                ok = there[rows, slot] & (used + e <= excess)
                new.append((rows[ok], words[ok] | word[rows[ok], slot], used[ok] + e))
        rows, words, used = (np.concatenate(x) for x in zip(*new, strict=True))
    return rows, words


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """prints: distinct fp. Pairs (u, v) of fingerprints that differ in 1 to max_bits bits; each once."""
    excess = (max_bits + 1) // 2

    def run(batches):
        blocks = code(excess)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, words = anchors_of(fp, blocks, excess)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(fp[rows].view(np.int64))], names=["anchor", "fp"])

    at = prints.select("fp").mapInArrow(run, "anchor bigint, fp bigint")
    left, right = at.withColumnRenamed("fp", "u"), at.withColumnRenamed("fp", "v")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return left.join(right, "anchor").filter(near).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits), component_id (least key it reaches)."""
    rows = common.stage(fingerprints(docs, text, key, shingle), "fingerprints")
    prints = common.stage(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct-prints")
    label = components(links(prints, max_bits))
    prints = common.stage(prints.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled-prints")
    groups = prints.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints"))
    prints = common.attach(prints, groups, ["label"], "n_prints", prints.count()).select("fp", "n", "component_id")
    out = common.attach(rows, common.stage(prints, "print-components"), ["fp"], "n", rows.count())
    return out.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, all columns: of each component one row, that with the least doc_id (null ids last), then the least
    SHA-256 of its text. Rows are told apart by id and text, so a row stays or goes by its own text, whoever else has its id."""
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), sha.alias("sha"))
    found = common.stage(near_duplicates(docs.select(row.alias("row"), "text"), key="row", max_bits=max_bits).drop("fingerprint"), "near-duplicates")
    # Rows alike in id and text share a mark; where it is the first of its component, one of them stays.
    first = F.max((F.col("row") == F.col("component_id")).cast("long"))
    marks = found.groupBy(F.to_json("row").alias("mark")).agg(F.count("*").alias("n"), first.alias("n_kept"))
    return common.one_of_each(docs, marks, F.to_json(row), found.count())
