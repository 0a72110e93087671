"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after marks that white space follows, and after line ends; one of more than LONG words also after
commas and the like). Every run of SPAN consecutive sentences is hashed (128 bits, over their words), from each sentence on; a longer
run that repeats is covered by those inside it. Hashes are
counted globally, with partial sums before the shuffle; runs whose hash occurs again are joined to its first occurrence (least
doc_id, then first in the text), and the sentences of every other occurrence are removed. Hashes that a large share of
all runs has are broadcast (1000 at most), the others are joined by shuffle, so a passage that a third of all documents
holds overloads no task. What is left of a text keeps its bytes. min_words, off by default, leaves alone a stretch of
sentences to remove that has fewer words: chance and idiom repeat short sentences. All runs are hashed and joined in any case.

Defined results: a null text counts as empty and comes back empty. Rows with the same id share their first occurrences:
what one of them holds first, the others keep too (so repeated rows stay alike). Where only null ids hold a run, it is
kept in all of them; else null ids never come first. An empty table gives an empty result. Other columns pass through, but
for columns named n_sentences or n_removed, whose place the results take. Bytes that aren't UTF-8 are kept as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPAN = 2
LONG = 40
#: What the registered query passes as min_words.
PASSAGE_WORDS = 25
_CLAUSE = re.compile(rb"[,;:|]+(?=[\x20\x09-\x0D])")
_END = re.compile(rb"[.!?]+(?=[\x20\x09-\x0D])|\n")


def sentences(data: bytes, long: int = LONG) -> list[tuple[int, int]]:
    """Byte ranges that cover the text."""
    out, at = [], 0
    for end in [*(m.end() for m in _END.finditer(data)), len(data)]:
        if end > at and len(data[at:end].split()) > long:
            for m in _CLAUSE.finditer(data, at, end):
                out.append((at, m.end()))
                at = m.end()
        if end > at:
            out.append((at, end))
        at = end
    return out


def runs(data: bytes, span: int) -> list[tuple[int, int, int, int, bool]]:
    """(h1, h2, first sentence, sentence after the last, has occurred before in this text) of each run of span sentences."""
    found, seen = [], set()
    parts = [(i, b" ".join(words)) for i, (a, b) in enumerate(sentences(data)) if (words := data[a:b].split())]
    for i in range(len(parts) - span + 1):
        end = i + span
        h = xxhash.xxh3_128_intdigest(b"\n".join(text for _, text in parts[i:end]))
        found.append((h >> 64, h & 0xFFFFFFFFFFFFFFFF, parts[i][0], parts[end - 1][0] + 1, h in seen))
        seen.add(h)
    return found


def _spans(docs: DataFrame, span: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1)
            rows = [runs(t or b"", span) for t in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            flat = [x for r in rows for x in r]
            h1, h2 = (pa.array(np.array([x[k] for x in flat], np.uint64).view(np.int64)) for k in (0, 1))
            first, last = (pa.array(np.array([x[k] for x in flat], np.int32)) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([h1, h2, ids.take(at), tags.take(at), first, last, pa.array([x[4] for x in flat], pa.bool_())], names=["h1", "h2", "doc_id", "tag", "first", "last", "again"])

    mine = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    return mine.mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {kind}, tag bigint, first int, last int, again boolean")


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, tag, spans): per text the sentence runs to remove; tag is the text's XXH64."""
    rows = common.stage(_spans(docs, span), "sentence-runs")
    twice = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    twice = common.stage(twice.filter("n > 1"), "repeated-runs")
    total = twice.agg(F.sum("n")).first()[0] or 0
    line = max(1.0, total * common.HOT_SHARE)
    hot = F.broadcast(twice.filter(F.col("n") >= line))
    rest = twice.filter(F.col("n") < line)
    cold = rows.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    both = rows.join(hot, ["h1", "h2"]).unionByName(cold.join(rest, ["h1", "h2"]))
    later = both.filter(F.col("first_id").isNotNull() & (~F.col("doc_id").eqNullSafe(F.col("first_id")) | F.col("again")))
    return later.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _clean(data: bytes, spans: list[dict] | None, min_words: int) -> tuple[bytes, int, int]:
    cuts = sentences(data)
    size = np.array([len(data[a:b].split()) for a, b in cuts], np.int64)
    drop = np.zeros(len(cuts) + 1, np.int64)
    for s in spans or []:
        drop[s["first"]] += 1
        drop[s["last"]] -= 1
    gone = drop.cumsum()[:-1] > 0
    if gone.any():
        full, blank = np.flatnonzero(size > 0), np.flatnonzero(size == 0)
        # Stretches of sentences to remove; what has no words goes where both neighbours do.
        stretch = np.cumsum(np.diff(gone[full], prepend=False) != 0)
        gone[full] &= np.bincount(stretch, size[full])[stretch] >= min_words
        after = np.searchsorted(full, blank)
        inner = (after > 0) & (after < len(full))
        gone[blank] = False
        gone[blank[inner]] = gone[full[after[inner] - 1]] & gone[full[after[inner]]]
    left = data if not gone.any() else b"".join(data[a:b] for (a, b), g in zip(cuts, gone.tolist(), strict=True) if not g)
    return left, int((size > 0).sum()), int(((size > 0) & gone).sum())


def remove_repeats(docs: DataFrame, span: int = SPAN, min_words: int = 0) -> DataFrame:
    """docs with the text cleaned, and n_sentences, n_removed."""
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    found = repeats(docs, span).withColumnsRenamed({"doc_id": "__id", "tag": "__tag", "spans": "__spans"})
    joined = docs.select(*names, F.xxhash64("text").alias("__text_tag"))
    joined = joined.join(found, (F.col("__text_tag") == F.col("__tag")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    at = names.index("text")

    def run(batches):
        for batch in batches:
            done = [_clean(t or b"", s, min_words) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array([d[0] for d in done], pa.binary())
            counts = [pa.array(np.array([d[k] for d in done], np.int64)) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*names, "n_sentences", "n_removed"])

    fields = [T.StructField("text", T.BinaryType()) if c == "text" else docs.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    binary = joined.withColumn("text", F.col("text").cast("binary")).select(*names, "__spans")
    return binary.mapInArrow(run, schema).withColumn("text", F.col("text").cast("string"))
