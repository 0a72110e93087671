"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text: its byte histogram (shares of letters, capitals, digits, symbols, marks, bytes over
127), word and line counts, lengths, shares of distinct and repeated words and lines. The forest is fitted in the driver
on MAX_ROWS labelled rows at most (those first by a hash of their ids), broadcast as flat arrays (a few hundred kB), and
run over every document in Arrow batches. Language, source, id and labels are never inputs.

Defined results: a null text counts as empty and gets a score like any other; rows with a null id are scored, and
labels of null ids aren't used. Repeated rows get equal scores. Without labels of both kinds all scores are the smoothed
share of label 1. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, gbdt

#: Bound of the sample of labelled rows that the forest is fitted on.
MAX_ROWS = 20_000
LINE = 0.3

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_SETS = [_UPPER, _LOWER, _DIGIT, b"#*$%&|<>", b"|", b"!", b".,;:?", b"'\"()-[]{}", b"/\\=+_~^@`", range(128, 256), b"\n", b" \t\r\x0b\x0c"]
_GROUPS = np.zeros((256, len(_SETS)))
for _i, _s in enumerate(_SETS):
    _GROUPS[list(_s), _i] = 1
N_FEATURES = len(_SETS) + 16


def features(data: bytes | None) -> np.ndarray:
    data = data or b""
    out = np.zeros(N_FEATURES)
    n = len(data)
    out[: len(_SETS)] = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _GROUPS / max(n, 1)
    words = data.split()
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k, m = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tops = [c for _, c in counts.most_common(3)]
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    wide = np.fromiter(map(len, lines), np.int64, len(lines))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[len(_SETS) :] = [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), n / k, lengths.std() if len(words) else 0, lengths.max(initial=0),
        len(counts) / k, len(counts) / np.sqrt(k), sum(tops[:1]) / k, sum(tops) / k, len(set(lines)) / m, ends / m, wide.mean() if len(lines) else 0,
        wide.min(initial=1 << 20) if len(lines) else 0, pairs / k, (lengths <= 2).mean() if len(words) else 0,
    ]
    return out


def labelled(labels: DataFrame, label: str, keep, most: int) -> DataFrame:
    """(doc_id, y): `most` rows at most, first by a hash of the id; keep: which ids may be learnt from. Only a share of the rows
    that is a little above `most` is ordered."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    share = (1.2 * most + 1000) / max(rows.count(), 1)
    at = F.xxhash64("doc_id")
    if share < 1:
        rows = rows.filter(at < F.lit(int(share * 2**64) - 2**63))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return rows.orderBy(at, "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> gbdt.Forest:
    chosen = common.stage(labelled(labels, "quality", common.crc_fold(F.col("doc_id"), 5) != 0, max_rows), "quality-labels")
    mine = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def run(batches):
        for batch in batches:
            x = [features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = mine.mapInArrow(run, f"doc_id {kind}, y int, x array<double>")
    # Of rows with one id, one is learnt from: max_rows rows at most reach the driver.
    got = seen.groupBy("doc_id", "y").agg(F.min_by("x", F.struct(F.xxhash64("x"), "x")).alias("x")).drop("doc_id").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T, got["y"]))  # sums of floats don't depend on the partitioning
    got, x = got.iloc[order], x[order]
    return gbdt.fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, forest: gbdt.Forest) -> DataFrame:
    """One row per row of docs: doc_id, score."""
    model = docs.sparkSession.sparkContext.broadcast(forest)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.predict(x))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def with_verdicts(scored: DataFrame, folds: int, held: int) -> DataFrame:
    fold = common.crc_fold(F.col("doc_id"), folds)
    return scored.select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= LINE).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    return with_verdicts(score(docs, fit(docs, labels)), 5, 0)
