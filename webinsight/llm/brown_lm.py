"""LM scoring with Brown class-based bigrams.

log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class), over its words and one end token.

Counts cover all training texts: words are counted in Arrow batches and summed by Spark, without a bound on the
vocabulary. The KNOWN most frequent words (of MIN_COUNT or more) are put in CLASSES classes by exchange. Frequent ones, with a share
of 1 / EXCHANGE of all tokens or more (so EXCHANGE at most), go first and settle the classes: each round counts every word's left and
right neighbours by class, moves half of the words (by a hash) to the class where the class bigrams' likelihood gains most, all at
once, and the best round stays. Then each other known word's neighbours are counted by these classes, in one pass, and it is moved to
the class with the largest gain. Words beyond them, and those never seen, have TAIL classes by spelling (a hash of the last two bytes).
What is broadcast is thus bounded: KNOWN words with counts and classes, and tables of classes squared. Counts of rarer words are
joined by shuffle, those that a large share of all rows has by broadcast.

Smoothing: class transitions are interpolated with class shares (weight ALPHA); emissions add HALF to each count, one
unseen word more for each class.

Defined results: a null text counts as empty and consists of the end token. Without training rows N and V are 0, and the
base score is log10(0.5 / 0.5) a token. Repeated rows are scored alike and count each time in training. A null id has the crc of
the empty text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLASSES = 64
TAIL = 64
EXCHANGE = 20_000
KNOWN = 200_000
MIN_COUNT = 10
ROUNDS = 6
ALPHA = 20.0
HALF = 0.5
HELD_OUT = 1
#: Entries that a task gathers before it hands them on.
FLUSH = 300_000
PAIRS = 1 << 21
#: Texts that are scored at once.
ROWS = 500


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()


def tail(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


@dataclass
class Symbols:
    """Ids: listed words, then tails, then the end (also the start of a text)."""

    ids: dict[bytes, int]
    seen: dict[bytes, int] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.ids) + TAIL + 1

    def of(self, words: list[bytes]) -> np.ndarray:
        seen, base = self.seen, len(self.ids)
        if len(seen) > FLUSH:
            seen.clear()
        for w in set(words).difference(seen):
            i = self.ids.get(w)
            seen[w] = base + tail(w) if i is None else i
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, n) over the texts."""

    def run(batches):
        held: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(words_of(t))
                if len(held) > FLUSH:
                    yield give()
                    held.clear()
        yield give()

    return train.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """Staged rows uid, doc_id, ids (a listed word's id; -1 less its tail for others), and rare (word, x, tail): the other words with
    their counts in the text. Texts are split here alone; what follows reads numbers."""
    bc = docs.sparkSession.sparkContext.broadcast(symbols)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = bc.value.ids
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                parts = [words_of(t) for t in batch.column(1).to_pylist()]
                words = [w for p in parts for w in p]
                names = list(set(words))
                place = {w: i for i, w in enumerate(names)}
                where = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                code = np.fromiter((known.get(w, -1) for w in names), np.int64, len(names))
                for i in np.flatnonzero(code < 0):
                    code[i] = -1 - tail(names[i])
                ids = code[where].astype(np.int32)
                off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
                other, width = np.flatnonzero(ids < 0), max(len(names), 1)
                text = np.repeat(np.arange(len(parts)), np.diff(off))
                pair, x = np.unique(text[other] * width + where[other], return_counts=True)
                which = pair % width
                rare = pa.StructArray.from_arrays([pa.array([names[i] for i in which], pa.binary()), pa.array(x, pa.int64()), pa.array((-1 - code[which]).astype(np.int32))], names=["word", "x", "tail"])
                lists = [(off, pa.array(ids)), (np.searchsorted(pair, np.arange(len(parts) + 1) * width), rare)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in lists)], names=["doc_id", "ids", "rare"])

    schema = f"doc_id {kind}, ids array<int>, rare array<struct<word: binary, x: bigint, tail: int>>"
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    return common.stage(rows.withColumn("uid", F.monotonically_increasing_id()), "encoded-texts")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and where each text begins (one more at the end)."""
    off = lists.offsets.to_numpy()
    return lists.flatten().to_numpy().astype(np.int64), (off - off[0]).astype(np.int64)


def _summed(encoded: DataFrame, state, codes) -> DataFrame:
    """(code, n) over the texts: codes(state, ids, starts) gives those of a batch; equal ones are summed before they are handed on."""
    bc = encoded.sparkSession.sparkContext.broadcast(state)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                held.append(codes(bc.value, *_flat(whole.column(0).slice(at, ROWS))))
                size += len(held[-1])
                if size > PAIRS:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()

    return encoded.select("ids").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _with_ends(values: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Texts one after the other, an end before each and after the last: a text's end is the next one's start."""
    return np.insert(values, starts, end)


def symbol_pairs(encoded: DataFrame, names: list[bytes], core: int) -> DataFrame:
    """(h, w, n): counts of neighbouring symbols: the first `core` words, tails for all others, and the end."""
    k = core + TAIL + 1

    def codes(tails, ids, starts):
        w = np.where(ids < 0, core - 1 - ids, np.where(ids < core, ids, core + tails[np.maximum(ids, 0)] if len(tails) else ids))
        w = _with_ends(w, starts, k - 1)
        return w[:-1] * k + w[1:]

    pairs = _summed(encoded, np.array([tail(w) for w in names], np.int64), codes)
    return pairs.select(F.floor(F.col("code") / k).cast("int").alias("h"), (F.col("code") % k).cast("int").alias("w"), "n")


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(matrix: np.ndarray) -> float:
    """Of the class bigrams, without the part that no classing changes."""
    return float(_phi(matrix).sum() - _phi(matrix.sum(axis=0)).sum() - _phi(matrix.sum(axis=1)).sum())


def best_class(matrix: np.ndarray, own: int, left: np.ndarray, right: np.ndarray) -> int:
    """Where a word of class own gains most; left, right: counts of its neighbours by class."""
    m = matrix.copy()
    m[:, own] -= left
    m[own, :] -= right
    np.maximum(m, 0, out=m)
    into, out = m[:, :CLASSES], m[:CLASSES, :]
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    gain = (_phi(into[a] + left[a, None]) - _phi(into[a])).sum(axis=0) + (_phi(out[:, b] + right[None, b]) - _phi(out[:, b])).sum(axis=1)
    cols, rows = m.sum(axis=0)[:CLASSES], m.sum(axis=1)[:CLASSES]
    gain -= _phi(cols + left.sum()) - _phi(cols) + _phi(rows + right.sum()) - _phi(rows)
    top = int(gain.argmax())
    return top if gain[top] > gain[own] + 1e-9 else own


def exchange(pairs: DataFrame, symbols: Symbols, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """pairs, staged -> class of each symbol, and the class bigrams. Tails and the end keep their own classes."""
    spark, n = pairs.sparkSession, len(symbols.ids)
    now = np.concatenate([np.arange(n) % CLASSES, CLASSES + np.arange(TAIL + 1)])
    total = CLASSES + TAIL + 1
    best = (-np.inf, now, np.zeros((total, total)))
    side = np.zeros(n, np.int64)
    for w, i in symbols.ids.items():
        side[i] = zlib.crc32(w) % 2
    for at in range(rounds + 1):
        names = spark.createDataFrame([(i, int(c)) for i, c in enumerate(now)], "id int, c int")  # EXCHANGE + TAIL + 1 rows at most
        classed = pairs.join(F.broadcast(names.select(F.col("id").alias("h"), F.col("c").alias("ch"))), "h")
        classed = classed.join(F.broadcast(names.select(F.col("id").alias("w"), F.col("c").alias("cw"))), "w")
        matrix = np.zeros((total, total))
        for r in classed.groupBy("ch", "cw").agg(F.sum("n").alias("n")).collect():  # classes squared
            matrix[r["ch"], r["cw"]] = r["n"]
        if (value := likelihood(matrix)) > best[0]:
            best = (value, now.copy(), matrix)
        if at == rounds or not n:
            break
        around = classed.select(F.col("w").alias("id"), F.lit(0).alias("side"), F.col("ch").alias("c"), "n").unionByName(classed.select(F.col("h").alias("id"), F.lit(1).alias("side"), F.col("cw").alias("c"), "n"))
        around = around.filter(F.col("id") < n).groupBy("id", "side", "c").agg(F.sum("n").alias("n"))
        around = around.groupBy("id").agg(F.collect_list("side").alias("side"), F.collect_list("c").alias("c"), F.collect_list("n").alias("n"))  # 2 * classes entries
        state = spark.sparkContext.broadcast((now, matrix))

        def decide(batches, state=state):
            old, m = state.value
            for batch in batches:
                ids, to = batch.column(0).to_pylist(), []
                for i, s, c, k in zip(ids, *(batch.column(x).to_pylist() for x in (1, 2, 3)), strict=True):
                    v = np.zeros((2, len(m)))
                    np.add.at(v, (s, c), k)
                    to.append(best_class(m, old[i], v[0], v[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int32())], names=["id", "c"])

        moves = around.mapInArrow(decide, "id int, c int").toPandas()
        new = now.copy()
        mine = side[moves["id"].to_numpy()] == at % 2
        new[moves["id"].to_numpy()[mine]] = moves["c"].to_numpy()[mine]
        now = new
    return best[1], best[2]


def gains(matrix: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """By class, what the likelihood gains when a word that isn't counted in the matrix yet is put there; left, right: counts of its
    neighbours by class."""
    into, out = matrix[:, :CLASSES], matrix[:CLASSES, :]
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    gain = (_phi(into[a] + left[a, None]) - _phi(into[a])).sum(axis=0) + (_phi(out[:, b] + right[None, b]) - _phi(out[:, b])).sum(axis=1)
    cols, rows = matrix.sum(axis=0)[:CLASSES], matrix.sum(axis=1)[:CLASSES]
    gain -= _phi(cols + left.sum()) - _phi(cols) + _phi(rows + right.sum()) - _phi(rows)
    # All words are placed beside the settled ones at once, so a class without these is none to go to.
    return np.where(cols + rows > 0, gain, -np.inf)


def _classes_of(classes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.where(ids < 0, CLASSES - 1 - ids, classes[np.maximum(ids, 0)])


def class_bigrams(encoded: DataFrame, classes: np.ndarray) -> np.ndarray:
    size = CLASSES + TAIL + 1

    def codes(c, ids, starts):
        k = _with_ends(_classes_of(c, ids), starts, size - 1)
        return k[:-1] * size + k[1:]

    matrix = np.zeros((size, size))
    for r in _summed(encoded, classes, codes).collect():  # classes squared
        matrix[r["code"] // size, r["code"] % size] = r["n"]
    return matrix


def place_others(encoded: DataFrame, classes: np.ndarray, core: int, n: int, matrix: np.ndarray) -> np.ndarray:
    """classes with the listed words from `core` to n put where they gain most beside the settled ones; neighbours that aren't
    settled themselves don't count."""
    size = CLASSES + TAIL + 1

    def codes(c, ids, starts):
        w, k = _with_ends(ids, starts, -1 - TAIL), _with_ends(_classes_of(c, ids), starts, size - 1)
        at = np.flatnonzero(w >= core)
        settled = (k < CLASSES) | (k == size - 1)
        left, right = at[settled[at - 1]], at[settled[at + 1]]
        return np.concatenate(((w[left] * 2) * size + k[left - 1], (w[right] * 2 + 1) * size + k[right + 1]))

    around = _summed(encoded, classes, codes)
    word = F.floor(F.col("code") / (2 * size)).cast("int")
    around = around.select(word.alias("id"), F.struct((F.col("code") % (2 * size)).cast("int").alias("c"), "n").alias("e")).groupBy("id").agg(F.collect_list("e").alias("e"))  # 2 * classes entries
    bc = encoded.sparkSession.sparkContext.broadcast(matrix)

    def decide(batches):
        for batch in batches:
            to = []
            each, starts = batch.column(1).flatten(), batch.column(1).offsets.to_numpy()
            c, k = (x.to_numpy() for x in each.flatten())
            starts = starts - starts[0]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                v = np.bincount(c[a:b], k[a:b], 2 * size)
                to.append(int(gains(bc.value, v[:size], v[size:]).argmax()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int32())], names=["id", "c"])

    moves = around.mapInArrow(decide, "id int, c int").toPandas()  # KNOWN rows at most
    out = classes.copy()
    out[moves["id"].to_numpy()] = moves["c"].to_numpy()
    return out


@dataclass
class Model:
    symbols: Symbols
    classes: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    known: np.ndarray  # by listed word: its count
    class_tokens: np.ndarray
    class_words: np.ndarray
    n: int
    v: int
    ends: int

    def base(self, c):
        return np.log10((c + HALF) / (self.n + HALF * (self.v + 1)))

    def emission(self, c, k):
        return np.log10((c + HALF) / (self.class_tokens[k] + HALF * (self.class_words[k] + 1)))


def listed_words(counts: DataFrame, most: int = KNOWN, least: int = MIN_COUNT) -> DataFrame:
    """counts of the `most` words at most that occur most; counts are cut in steps of an eighth of an octave, ties stay together."""
    bins = counts.filter(F.col("n") >= least).groupBy(F.floor(8 * F.log2("n")).cast("int").alias("bin")).count().orderBy(F.desc("bin")).collect()  # 8 a factor of two
    line, held = 0, 0
    for r in bins:
        held += r["count"]
        if held > most:
            line = r["bin"] + 1
            break
    return counts.filter((F.col("n") >= least) & (F.floor(8 * F.log2("n")) >= line))


@dataclass
class Listed:
    """The training words: staged counts (word, n) of all, the listed ones with theirs, and sums."""

    counts: DataFrame
    names: list[bytes]
    known: np.ndarray
    core: int
    n: int
    v: int
    ends: int


def list_words(train: DataFrame) -> Listed:
    counts = common.stage(word_counts(train), "word-counts")
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    ends = train.count()
    n, v = (total or 0) + ends, kinds + (ends > 0)
    known = listed_words(counts).toArrow()  # KNOWN rows at most
    known = sorted(zip(known["word"].to_pylist(), known["n"].to_pylist(), strict=True), key=lambda wc: (-wc[1], wc[0]))
    return Listed(counts, [w for w, _ in known], np.array([c for _, c in known], float), sum(c >= n / EXCHANGE for _, c in known), int(n), int(v), ends)


def fit(encoded: DataFrame, listed: Listed) -> Model:
    """The model of encoded training texts."""
    core, names = listed.core, listed.names
    often = Symbols({w: i for i, w in enumerate(names[:core])})
    pairs = common.stage(symbol_pairs(encoded, names, core), "symbol-pairs")
    settled, matrix = exchange(pairs, often)
    symbols = Symbols({w: i for i, w in enumerate(names)})
    classes = np.concatenate((settled[:core], [CLASSES + tail(w) for w in names[core:]], settled[core:])).astype(np.int64)
    if 0 < core < len(names):
        classes = place_others(encoded, classes, core, len(names), matrix)
        matrix = class_bigrams(encoded, classes)

    bc = encoded.sparkSession.sparkContext.broadcast((symbols, classes))

    def classed(batches):
        for batch in batches:
            s, c = bc.value
            words = [bytes(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c[s.of(words)].astype(np.int32)), batch.column(1)], names=["c", "n"])

    size = CLASSES + TAIL + 1
    tokens, kinds = np.zeros(size), np.zeros(size)
    for r in listed.counts.select("word", "n").mapInArrow(classed, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        tokens[r["c"]], kinds[r["c"]] = r["n"], r["k"]
    share = (matrix.sum(axis=0) + HALF) / (matrix.sum() + HALF * size)
    step = np.log10((matrix + ALPHA * share) / (matrix.sum(axis=1, keepdims=True) + ALPHA))
    return Model(symbols, classes, step, listed.known, tokens, kinds, listed.n, listed.v, listed.ends)


def train_model(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the staged counts (word, n) of all training words."""
    listed = list_words(train)
    return fit(encode(train, Symbols({w: i for i, w in enumerate(listed.names)})), listed), listed.counts


def score_encoded(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per encoded row: doc_id, n_tokens, n_known, base_score, score."""
    known = np.append(model.known, 0)
    kinds = np.append(model.classes[: len(model.known)], 0)
    tables = (model.step, model.classes[: len(model.known)], model.base(known), model.emission(known, kinds), model.base(model.ends), model.ends > 0)
    bc = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        step, classes, base, emit, base_end, ends = bc.value
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            ids, starts = _flat(batch.column(1))
            n, listed, at = np.diff(starts), ids >= 0, np.maximum(ids, 0)
            k = _with_ends(_classes_of(np.append(classes, 0), ids), starts, CLASSES + TAIL)
            text = np.repeat(np.arange(len(n)), n)
            total = lambda x, text=text, n=n: np.bincount(text, x, len(n))
            steps = np.bincount(np.repeat(np.arange(len(n)), n + 1), step[k[:-1], k[1:]], len(n))
            columns = [n + 1, total(listed).astype(np.int64) + ends, total(np.where(listed, base[at], 0)) + base_end, total(np.where(listed, emit[at], 0)) + steps]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, columns)], names=["uid", "doc_id", "n_tokens", "n_known", "base", "value"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("uid", "ids", "doc_id").mapInArrow(run, f"uid bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, value double")
    per = [float(-np.log10(model.class_tokens[CLASSES + i] + HALF * (model.class_words[CLASSES + i] + 1))) for i in range(TAIL)]
    rare = rows.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.x", F.element_at(F.array(*map(F.lit, per)), F.col("r.tail") + 1).alias("per"))
    # A word that training lacks may be in every text that is scored: such words are looked up by broadcast.
    seen = rare.groupBy("word").agg(F.count("*").alias("rows")).join(counts, "word", "left")
    seen = common.stage(seen.select("word", "rows", F.coalesce("n", F.lit(0)).alias("c")), "rare-words")
    rare = common.attach(rare, seen, ["word"], "rows", seen.agg(F.sum("rows")).first()[0] or 0)
    each = F.col("x") * F.log10(F.col("c") + HALF)
    flat = float(np.log10(model.n + HALF * (model.v + 1)))
    sums = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("x")).otherwise(0)).alias("more_known"),
        F.sum(each - F.col("x") * flat).alias("more_base"),
        F.sum(each + F.col("x") * F.col("per")).alias("more_value"),
    )
    out = scored.join(sums, "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), plus("base", "more_base").alias("base_score"), plus("value", "more_value").alias("score"))


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, base_score, score."""
    return score_encoded(encode(docs, model.symbols), model, counts)


def score_documents(docs: DataFrame) -> DataFrame:
    """Learns from the training fold and scores every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = common.crc_fold(F.col("doc_id"), 5) == HELD_OUT
    listed = list_words(docs.filter(~held))
    encoded = encode(docs, Symbols({w: i for i, w in enumerate(listed.names)}))
    model = fit(encoded.filter(~held), listed)
    out = score_encoded(encoded, model, listed.counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
