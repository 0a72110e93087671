"""Toxicity by class-conditional Kneser-Ney bigram models.

Two interpolated models, one of toxic and one of ordinary texts, are learnt from labelled rows. A class's bigrams, counted once a
text, back off to its continuation counts (of how many kinds of words a word follows), and these to those of the word's
beginnings: a word is reached over its prefixes of PREFIXES bytes, each step with discounted counts of the class. At every step the
discounted mass goes to the counts of both classes together, so an expression that is rare in both is smoothed through shared counts
alone and hardly moves the score, while one that only toxic texts have counts the more, the more often and in the more surroundings it
occurs; words made from one stem add up in its prefixes. Discounts of counts of 1, 2 and more come from counts of counts.

The log-likelihood ratio is taken per word over the whole text, and per word over its one and its TOP most toxic bigrams (so
that a long text doesn't dilute an insult); a logistic curve over these and the text's length makes the score. The curve is cross-fitted:
each of FOLDS parts of the sample is rated by models of the other parts, and the curve is fitted on all of these ratings, in standard
units with a ridge, so that few toxic rows don't bend it; the models that score count the whole sample.

The sample is bounded by rows: MAX_DOCS labelled rows of label 0 and of label 1, first by a hash of the id, their texts whole. Counts
are summed by Spark. What is broadcast is bounded too: the ENTRIES words and prefixes, and the ENTRIES bigrams, that occur most
(twice at least); others fall to the next lower order, as in any pruned model. Every whole text is scored in Arrow batches. Words are
lower-cased (A-Z) runs of letters, digits and bytes over 127.

Defined results: a null text counts as empty; texts without words have ratios 0 and get the curve's score there. Null ids
are scored; their labels aren't used. Without labels of both kinds every score is the smoothed share of label 1.
Repeated rows get equal scores; of rows with one id that are learnt from, the one with the least hash counts. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_classifier import labelled, with_verdicts

#: Rows of label 0 and of label 1 that are learnt from.
MAX_DOCS = (24_000, 8_000)
ENTRIES = 200_000
PREFIXES = (3, 5, 7)
TOP = 3
FOLDS = 4
RIDGE = 1.0
#: Entries of the table of words seen, in a worker.
SEEN = 300_000
#: Bigrams that a task hands on at once.
FLUSH = 500_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = len(PREFIXES)


def tokens(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_FOLD).split()


def forms(word: bytes) -> list[bytes]:
    """The prefixes that a word is reached over, longest first."""
    return [word[:n] for n in reversed(PREFIXES) if len(word) > n]


@dataclass
class Symbols:
    """Ids: known words, then prefixes for the words below them, then the root for all others, then the start of a text."""

    words: dict[bytes, int]
    prefixes: dict[bytes, int]
    seen: dict[bytes, int] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.words) + len(self.prefixes) + 2

    def of(self, data: bytes | None) -> np.ndarray:
        if len(self.seen) > SEEN:
            self.seen.clear()
        words, seen, known, root = tokens(data), self.seen, self.words, len(self) - 2
        for w in set(words).difference(seen):
            i = known.get(w)
            seen[w] = next((j for f in forms(w) if (j := self.prefixes.get(f)) is not None), root) if i is None else i
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


@dataclass
class Toxicity:
    """Log ratios of the two classes' probabilities: of a symbol, of what a history leaves to lower orders, of a kept bigram."""

    symbols: Symbols
    low: np.ndarray
    left: np.ndarray
    keys: np.ndarray  # sorted: history * number of symbols + word
    pairs: np.ndarray
    curve: np.ndarray  # of 1 and the ratios
    n_ratios = 4

    def log_ratios(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = self.left[h] + self.low[w]
        if len(self.keys):
            code = h * len(self.symbols) + w
            at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
            out = np.where(self.keys[at] == code, self.pairs[at], out)
        return out

    def ratios(self, data: bytes | None) -> list[float]:
        w = self.symbols.of(data)
        if not len(w):
            return [0.0] * self.n_ratios
        k = len(self.symbols)
        code, n = np.unique(np.concatenate(([k - 1], w[:-1])) * k + w, return_counts=True)
        each = self.log_ratios(code // k, code % k)
        top = np.maximum(np.sort(each)[-TOP:], 0)
        return [float(each @ n / n.sum()), float(top[-1]), float(top.sum() / TOP), float(np.log1p(len(w)))]

    def score(self, ratios: np.ndarray) -> np.ndarray:
        z = self.curve[0] + ratios @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Newton's method; weights of (1, *x). The ridge counts in standard units of x; the constant isn't penalised."""
    mean, unit = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - mean) / unit])
    w, pen = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pen, a.T @ (y - p) - pen @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    w[1:] /= unit
    w[0] -= w[1:] @ mean
    return w


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from the numbers of entries that have counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    later = lambda a, b, k: k - (k + 1) * y * b / a if a else k / 2
    d = [later(n1, n2, 1), later(n2, n3, 2), later(n3, n4, 3)]
    return tuple(float(min(max(x, 0.1), k)) for x, k in zip(d, (0.95, 1.9, 2.85), strict=True))


def _taken(count: Column, d: tuple[float, float, float]) -> Column:
    """What is discounted from a count."""
    return F.when(count <= 0, 0.0).when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def _less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)], 0)


def _counts_of_counts(*columns: str) -> list[Column]:
    return [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in columns for k in (1, 2, 3, 4)]


def _least(rows: DataFrame, n: Column, most: int) -> int:
    """The least count, 2 or more, that `most` rows or fewer reach; counts are looked at in steps of a quarter of an octave."""
    bins = rows.groupBy(F.floor(4 * F.log2(n)).alias("bin")).count().orderBy(F.desc("bin")).collect()  # 4 a factor of two
    at, held = 4, 0
    for r in bins:
        held += r["count"]
        if held > most:
            at = max(at, r["bin"] + 1)
            break
    return int(np.ceil(2 ** (at / 4)))


def text_pairs(sample: DataFrame) -> DataFrame:
    """(h, w, n0, n1, less0_0, less0_1, ...): in how many texts of each class w follows h (empty: the text begins), and for each fold
    in how many of those outside it."""

    def run(batches):
        held: list[tuple] = []

        def give():
            y, fold, h, w = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(fold, pa.int32()), pa.array(h, pa.binary()), pa.array(w, pa.binary())], names=["y", "fold", "h", "w"])

        for batch in batches:
            for text, y, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = tokens(text)
                held += [(y, fold, h, w) for h, w in set(zip([b"", *words], words, strict=False))]
                if len(held) > FLUSH:
                    yield give()
                    held = []
        if held:
            yield give()

    pairs = sample.select("text", "y", "fold").mapInArrow(run, "y int, fold int, h binary, w binary")
    mine = lambda y: F.col("y") == y
    return pairs.groupBy("h", "w").agg(*(F.count_if(mine(y)).alias(f"n{y}") for y in (0, 1)), *(F.count_if(mine(y) & (F.col("fold") != k)).alias(f"less{k}_{y}") for k in range(FOLDS) for y in (0, 1)))


def _steps(word: Column) -> Column:
    """The nodes that a word is reached over: (node, parent, level); a space marks a whole word."""
    empty, size = F.lit(b""), F.octet_length(word)
    prefix = lambda n: F.substring(word, 1, n)
    up = empty
    out = []
    for i, n in enumerate(PREFIXES):
        out.append(F.when(size > n, F.struct(prefix(n).alias("node"), up.alias("parent"), F.lit(i).alias("level"))))
        up = prefix(n)
    longest = empty
    for n in PREFIXES:
        longest = F.when(size > n, prefix(n)).otherwise(longest)
    out.append(F.struct(F.concat(word, F.lit(b" ")).alias("node"), longest.alias("parent"), F.lit(_WORD).alias("level")))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _columns(rows: DataFrame, *order: str) -> dict[str, np.ndarray | list[bytes]]:
    """rows, collected through Arrow and sorted: numbers as float arrays, names as lists."""
    got = rows.toArrow().combine_chunks().sort_by([(c, "ascending") for c in order])
    return {c: got[c].to_pylist() if c in (*order, "parent") else got[c].to_numpy().astype(float) for c in got.column_names}


def models(pairs: DataFrame, n: str, entries: int = ENTRIES) -> Toxicity:
    """Both models from staged pairs, with counts in columns n and a class, as one table of log ratios (the curve is still zero)."""
    sums = F.col("n0") + F.col("n1")
    pairs = pairs.select("h", "w", *(F.col(f"{n}{y}").cast("double").alias(f"n{y}") for y in (0, 1))).filter(sums > 0)
    words = pairs.groupBy("w").agg(*(F.count_if(F.col(f"n{y}") > 0).cast("double").alias(f"c{y}") for y in (0, 1)))
    nodes = words.select("c0", "c1", F.explode(_steps(F.col("w"))).alias("s")).groupBy("s.node", "s.parent", "s.level").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    nodes = common.stage(nodes, "toxic-nodes")
    by_level = {r["level"]: [discounts(*(r[f"c{y}_{k}"] for k in (1, 2, 3, 4))) for y in (0, 1)] for r in nodes.groupBy("level").agg(*_counts_of_counts("c0", "c1")).collect()}
    cut = [F.coalesce(*(F.when(F.col("level") == i, _taken(F.col(f"c{y}"), d[y])) for i, d in by_level.items()), F.lit(0.0)) for y in (0, 1)]
    cuts = nodes.groupBy("parent").agg(*(F.sum(cut[y]).alias(f"cut{y}") for y in (0, 1)))
    both = F.col("c0") + F.col("c1")
    kept = nodes.filter(both >= _least(nodes, both, entries))
    t = _columns(kept.join(cuts.withColumnRenamed("parent", "node"), "node", "left").fillna(0.0, ["cut0", "cut1"]), "node")
    root = cuts.filter(F.col("parent") == F.lit(b"")).select("cut0", "cut1").first() or (0.0, 0.0)
    total = nodes.filter(F.col("parent") == F.lit(b"")).agg(F.sum("c0"), F.sum("c1")).first()

    # Row 0 is the root; parents are kept whenever their children are.
    place = {b"": 0} | {x: i for i, x in enumerate(t["node"], 1)}
    up = np.array([0, *map(place.__getitem__, t["parent"])], np.int64)
    level = np.array([-1, *t["level"]], np.int64)
    c = [np.array([float(total[y] or 0), *t[f"c{y}"]]) for y in (0, 1)]
    left = [np.where(c[y] > 0, np.array([root[y], *t[f"cut{y}"]]) / np.maximum(c[y], 1e-9), 1.0) for y in (0, 1)]
    shared = (c[0] + c[1]) / np.maximum(c[0][up] + c[1][up], 1e-9)
    log_p = [np.zeros(len(up)), np.zeros(len(up))]
    for i in range(_WORD + 1):
        at = np.flatnonzero(level == i)
        if len(at):
            for y in (0, 1):
                above = c[y][up[at]]
                step = np.where(above > 0, _less(c[y][at], by_level[i][y]) / np.maximum(above, 1e-9), 0) + left[y][up[at]] * shared[at]
                log_p[y][at] = log_p[y][up[at]] + np.log(step)
    low = log_p[1] - log_p[0]
    whole, part = np.flatnonzero(level == _WORD), np.flatnonzero((level >= 0) & (level < _WORD))
    leave = np.log(np.maximum(left[1], 1e-6)) - np.log(np.maximum(left[0], 1e-6))
    names = t["node"]
    symbols = Symbols({names[i - 1][:-1]: k for k, i in enumerate(whole)}, {names[i - 1]: len(whole) + k for k, i in enumerate(part)})
    size = len(symbols)
    low_of = np.concatenate((low[whole], (low + leave)[part], (low + leave)[[0]], [0.0]))

    # Bigrams above them.
    d = pairs.agg(*_counts_of_counts("n0", "n1")).first()
    high = [discounts(*(d[f"n{y}_{k}"] for k in (1, 2, 3, 4))) for y in (0, 1)]
    ids = symbols.words | {b"": size - 1}
    seen = pairs.groupBy("h").agg(*(F.sum(f"n{y}").alias(f"n{y}") for y in (0, 1)), *(F.sum(_taken(F.col(f"n{y}"), high[y])).alias(f"cut{y}") for y in (0, 1)))
    seen = common.stage(seen, "toxic-histories")
    before = _columns(seen.filter(sums >= _least(seen, sums, entries)), "h")
    h_id = np.array([ids.get(h, -1) for h in before.pop("h")], np.int64)
    before, h_id = {c: x[h_id >= 0] for c, x in before.items()}, h_id[h_id >= 0]
    totals, stay = [np.zeros(size), np.zeros(size)], [np.ones(size), np.ones(size)]
    for y in (0, 1):
        totals[y][h_id] = before[f"n{y}"]
        stay[y][h_id] = np.where(before[f"n{y}"] > 0, before[f"cut{y}"] / np.maximum(before[f"n{y}"], 1e-9), 1.0)
    grams = pairs.filter(F.greatest("n0", "n1") > 1)
    top = _columns(grams.filter(sums >= _least(grams, sums, entries)), "h", "w")
    h, w = (np.array([i.get(x, -1) for x in top.pop(c)], np.int64) for c, i in (("h", ids), ("w", symbols.words)))
    known = (h >= 0) & (w >= 0)
    h, w, top = h[known], w[known], {c: x[known] for c, x in top.items()}
    p = []
    for y in (0, 1):
        own = np.where(totals[y][h] > 0, _less(top[f"n{y}"], high[y]) / np.maximum(totals[y][h], 1e-9), 0)
        p.append(np.log(own + np.maximum(stay[y][h], 1e-6) * np.exp(log_p[y][whole][w])))
    key = h * size + w
    order = np.argsort(key)
    stays = np.log(np.maximum(stay[1], 1e-6)) - np.log(np.maximum(stay[0], 1e-6))
    return Toxicity(symbols, low_of, stays, key[order], (p[1] - p[0])[order], np.zeros(1 + Toxicity.n_ratios))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y, fold) of the bounded sample."""
    keep = common.crc_fold(F.col("doc_id"), 4) != 2
    both = [labelled(labels.filter(F.col("toxic") == y), "toxic", keep, MAX_DOCS[y]) for y in (0, 1)]
    chosen = common.stage(both[0].unionByName(both[1]), "toxic-labels")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    # Of rows with one id, one is learnt from: the sample is bounded by rows too.
    one = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("text", "y", fold.alias("fold"))


def _rated(rows: DataFrame, model: Toxicity, kept: str) -> tuple[DataFrame, Broadcast]:
    """rows (kept, text) -> kept and the ratios; and the broadcast, which may go once these are read."""
    bc = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"r{i}" for i in range(Toxicity.n_ratios)]

    def run(batches):
        for batch in batches:
            x = np.array([bc.value.ratios(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=[kept, *names])

    return rows.select(kept, "text").mapInArrow(run, f"{kept} {rows.schema[kept].dataType.simpleString()}, " + ", ".join(f"{r} double" for r in names)), bc


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    sample = common.stage(_sample(docs, labels), "toxic-sample")
    pairs = common.stage(text_pairs(sample), "toxic-pairs")
    out = models(pairs, "n")
    rated = []
    for k in range(FOLDS):
        rows, bc = _rated(sample.filter(F.col("fold") == k), models(pairs, f"less{k}_"), "y")
        rated.append(rows.toPandas())  # a row for each text of the fold
        bc.destroy()
    apart = pd.concat(rated, ignore_index=True)
    apart = apart.sort_values(list(apart.columns))
    y, x = apart["y"].to_numpy(float), apart.drop(columns="y").to_numpy()
    fair = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (common.crc_fold(F.col("doc_id"), 4) != 2))
    n, ones = fair.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if 0 < y.sum() < len(y):
        # The sample is dealt by class; the constant is moved to the classes' shares among all labelled rows.
        out.curve = logistic(x, y)
        out.curve[0] += np.log((ones + 1) / (n - ones + 1)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    else:
        out.curve[0] = np.log((ones + 1) / (n - ones + 1))
    return out


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """One row per row of docs: doc_id, score."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.array([bc.value.ratios(t) for t in batch.column(1).to_pylist()]).reshape(-1, Toxicity.n_ratios)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bc.value.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    return with_verdicts(score(docs, fit(docs, labels)), 4, 2)
