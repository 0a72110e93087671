"""SentencePiece encoding and decoding, with segmentations sampled without replacement by Gumbel top-k.

Lattice: the pieces of a SentencePiece model file over the characters of a text (a blank before it, blanks as in the
model); a character without a piece of its own has its UTF-8 bytes as one edge, so every text has a segmentation and
decodes to itself. A BPE model has merge ranks in place of probabilities; by Zipf's law an edge gets ALPHA times
-log(rank + ZIPF), and a segmentation's probability is its share of exp(sum of edges) over all segmentations. No piece
crosses from a non-blank to a blank or over a line end, so the lattice is a chain of small lattices (a word and the blanks before it),
and each distinct word of a batch is solved once, those of a task's first HELD_CHARS characters once a task: backward sums give every
edge's probability at its node.

Search: a set of segmentations is a prefix of edges and a node with the edges still open there. The agenda holds each set
with the maximum of its perturbed log-probabilities; popping the largest gives a segmentation whose prefix is shared with
an earlier one, whose next edge is drawn among those open, and whose rest is drawn edge by edge. The sets left beside it
get maxima drawn from Gumbels truncated at the popped value. Since a set's bound is its exact maximum, the first k pops
are the top k of all perturbed segmentations: k different ones, sampled without replacement. The next value on the
agenda is the threshold kappa, and log(1 - exp(-exp(log p - kappa))) the log inclusion score of a segmentation.

All rows of a batch are searched at once in numpy. Random numbers come from a counter hash seeded by the row's key (its id and the
seed), so a row's samples don't depend on batches or partitions.

Defined results: a null text counts as empty; it has one segmentation without pieces (log p and inclusion 0). A text with
fewer than k segmentations returns them all, with inclusion 0 (certain). A byte that isn't
UTF-8 is a character without a piece: an edge of its own byte. Repeated rows and rows with null ids get the samples of their key. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 3
ALPHA = 1.0
ZIPF = 2.7
SEED = "pieces-1"
#: Characters that are searched at once (a longer text is searched alone).
BATCH_CHARS = 1_000_000
#: Characters of distinct words whose lattices a task keeps from batch to batch (about 75 bytes each).
HELD_CHARS = 250_000

_CHUNK = re.compile(r" *[^ \n]+| +|\n")
#: Before a word that begins a line; see _keys.
_LINE = "\n\n"
_P = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 17
#: Probability that counts as none.
EPSILON = 1e-12


@dataclass
class Vocabulary:
    pieces: list[str]  # by id; blanks as " ", "" for those that aren't text
    data: list[bytes]  # by id: what the id decodes to
    byte_ids: list[int]
    weight: np.ndarray
    longest: int
    hashes: np.ndarray  # sorted hashes of pieces and of their beginnings
    hash_ids: np.ndarray  # -1 for a beginning that is no piece
    bucket: np.ndarray  # where the hashes with given leading bits begin
    unseen: float
    def __post_init__(self):
        self.table = pa.array(self.data, pa.binary())

    def __reduce__(self):  # the table is made again where the vocabulary is read
        return Vocabulary, (self.pieces, self.data, self.byte_ids, self.weight, self.longest, self.hashes, self.hash_ids, self.bucket, self.unseen)

    @staticmethod
    def load(path: str = MODEL, zipf: float = ZIPF) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, data, byte_ids = [], [], [0] * 256
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                pieces.append("")
                data.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                pieces.append("")
                data.append(b"")
            else:
                pieces.append(piece.replace("▁", " "))
                data.append(pieces[-1].encode())
        if any(" " in p.lstrip(" ") or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a word or line end")
        score = np.array([m.get_score(i) for i in range(len(pieces))])
        rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
        weight = -np.log(rank + zipf)
        named = {p: i for i, p in enumerate(pieces) if p}
        starts = sorted({p[:k] for p in named for k in range(1, len(p) + 1)})  # no piece goes on where no start is found
        ids = np.fromiter((named.get(p, -1) for p in starts), np.int32, len(starts))
        codes, lengths = _codes(starts)
        first = np.cumsum(lengths) - lengths
        h = np.zeros(len(ids), np.uint64)
        for k in range(lengths.max()):
            on = lengths > k
            h[on] = _roll(h[on], codes[first[on] + k])
        if len(np.unique(h)) < len(h):
            raise ValueError("piece hashes collide")
        order = np.argsort(h)
        bucket = np.searchsorted((h[order] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64), np.arange((1 << _FILTER_BITS) + 1)).astype(np.int32)
        return Vocabulary(pieces, data, byte_ids, weight, int(lengths.max()), h[order], ids[order], bucket, float(weight.min()))

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
        """What the ids decode to, one after the other, and where each begins (one more at the end)."""
        _, offsets, flat = self.table.take(pa.array(ids, pa.int32())).buffers()
        return np.frombuffer(offsets, np.int32)[: len(ids) + 1], flat

    def decode(self, ids) -> bytes:
        """The UTF-8 text of a segmentation; the blank before the text is taken off."""
        if not len(ids):
            return b""
        at, flat = self.decode_all(ids)
        return flat.slice(1, int(at[-1]) - 1).to_pybytes()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.fromiter(map(len, texts), np.int64, len(texts))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    x = (h + code + np.uint64(1)) * _P
    return x ^ (x >> np.uint64(29))


def _counter(key: np.ndarray, sample: int, use: int, at: np.ndarray) -> np.ndarray:
    return key + _mix(np.array([sample * 16 + use + 1], np.uint64)) + at.astype(np.uint64) * _P


def _unit(counter: np.ndarray) -> np.ndarray:
    return ((_mix(counter) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _uniform(key: np.ndarray, sample: int, use: int, at: np.ndarray) -> np.ndarray:
    """In (0, 1), by row key, sample, use and place."""
    return _unit(_counter(key, sample, use, at))


@dataclass
class Lattices:
    """Chained arrays of the lattices of distinct chunks. Nodes are characters; -1 is the end of a chunk."""

    first: np.ndarray  # by chunk: its first node
    edge_at: np.ndarray  # by node (one more at the end): its first edge
    to: np.ndarray
    source: np.ndarray
    log_p: np.ndarray  # of an edge at its node
    upto: np.ndarray  # running sum of probabilities at the node
    piece: np.ndarray  # -1: the bytes of a character over 127
    code: np.ndarray  # by node: character


def lattices(codes: np.ndarray, lengths: np.ndarray, v: Vocabulary, alpha: float) -> Lattices:
    """codes: characters of all chunks, lengths: their number by chunk."""
    n, ends = len(codes), np.cumsum(lengths)
    first = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(n)  # characters to the chunk's end
    width = min(v.longest, int(lengths.max(initial=1)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by size: nodes, their pieces of that size, and how many shorter ones
    pos, h, degree = np.arange(n), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(width):
        if k:
            on = left[pos] > k
            pos, h = pos[on], h[on]
        if not len(pos):
            break
        h = _roll(h, codes[pos + k])
        b = (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        i, end = v.bucket[b], v.bucket[b + 1]
        hit = np.flatnonzero(i < end)
        i, end, wanted, ids = i[hit], end[hit], h[hit], np.full(len(pos), -2, np.int32)
        while len(hit):
            ok = v.hashes[i] == wanted
            ids[hit[ok]] = v.hash_ids[i[ok]]
            on = ~ok & (i + 1 < end)
            hit, i, end, wanted = hit[on], i[on] + 1, end[on], wanted[on]
        # A character always has an edge: its piece, or its bytes.
        full = ids >= 0
        at, its = (pos[full], ids[full]) if k else (pos, np.maximum(ids, -1))
        found.append((at, its, degree[at]))
        degree[at] += 1
        goes_on = ids > -2
        pos, h = pos[goes_on], h[goes_on]
    edge_at = np.concatenate(([0], np.cumsum(degree)))
    m = int(edge_at[-1])
    source, piece, to = np.repeat(np.arange(n, dtype=np.int32), degree), np.empty(m, np.int32), np.empty(m, np.int32)
    for k, (at, its, shorter) in enumerate(found, 1):
        slot = edge_at[at + 1] - 1 - shorter  # longest first
        piece[slot] = its
        to[slot] = np.where(left[at] > k, at + k, -1)
    del found
    weight = alpha * np.where(piece >= 0, v.weight[piece], 2 * v.unseen)
    lone = np.flatnonzero(piece < 0)
    lone = lone[codes[source[lone]] < 128]
    piece[lone] = np.array(v.byte_ids)[codes[source[lone]].astype(np.int64)]
    # Backward sums, by distance from the end of the chunk.
    beta = np.zeros(n + 1)  # the last for -1
    order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(left, minlength=1)[1:]))) if n else np.zeros(1, np.int64)
    d = degree[order]
    turned = _spread(edge_at[order], d)  # edges in the order of their nodes
    heads = np.concatenate(([0], np.cumsum(d)))
    x, ahead = weight[turned], to[turned]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        p, q = int(heads[a]), int(heads[b])
        y = x[p:q] + beta[ahead[p:q]]
        starts = heads[a:b] - p
        top = np.maximum.reduceat(y, starts)
        beta[order[a:b]] = top + np.log(np.add.reduceat(np.exp(y - np.repeat(top, d[a:b])), starts))
    log_p = weight + beta[to] - np.repeat(beta[:n], degree)
    p = np.exp(log_p)
    upto, on, rank = p.copy(), np.flatnonzero(degree > 1), 1  # summed node by node, so that a chunk's sums don't depend on other chunks
    while len(on):
        at = edge_at[on] + rank
        upto[at] += upto[at - 1]
        rank += 1
        on = on[degree[on] > rank]
    upto[edge_at[1:] - 1] = 2.0  # the last edge takes what rounding leaves
    return Lattices(first, edge_at.astype(np.int32), to, source, log_p, upto, piece, codes.astype(np.uint32))


def _slow(text: str) -> bool:
    """Whether blanks (the one before the text too) stand at an end of a line or in a row, so that they don't divide it into chunks."""
    return "  " in text or text[:1] in (" ", "\n") or text[-1:] == " " or " \n" in text or "\n " in text


def _keys(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts with a blank before each, and their number by text.

    In short: a word after one blank as the word, a word that begins a line after _LINE.
    """
    parts, counts = [pa.array([], pa.binary())], [np.zeros(0, np.int64)]
    for slow, group in groupby(texts, _slow):
        if slow:
            short = [[c if c in (" ", "\n") or c[:2] == "  " else c[1:] if c[0] == " " else _LINE + c for c in _CHUNK.findall(" " + t)] for t in group]
            parts.append(pa.array([c.encode(errors="surrogateescape") for keys in short for c in keys], pa.binary()))
            counts.append(np.fromiter(map(len, short), np.int64, len(short)))
            continue
        # The first line has its blank; an empty text has no chunk (its one part is empty), nor has an empty line (its part is _LINE alone).
        split = pc.split_pattern(pa.array([t.replace("\n", f" \n {_LINE}").encode(errors="surrogateescape") for t in group], pa.binary()), b" ")
        keys, ends = split.values, split.offsets.to_numpy()
        full = pc.invert(pc.is_in(keys, pa.array([b"", _LINE.encode()], pa.binary())))
        ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[ends]
        parts.append(keys.filter(full))
        counts.append(np.diff(ends))
    return pa.concat_arrays(parts), np.concatenate(counts)


def _chunk_codes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the chunks that the keys stand for, and how many by chunk."""
    line = pc.starts_with(keys, _LINE)
    bare = pc.or_(pc.equal(keys, b"\n"), pc.starts_with(keys, " "))
    before = pc.if_else(pc.or_(line, bare), pa.scalar(b""), pa.scalar(b" "))
    chunks = pc.binary_join_element_wise(before, pc.if_else(line, pc.binary_replace_slice(keys, 0, len(_LINE), b""), keys), b"")
    try:
        chunks = chunks.cast(pa.string())
    except pa.ArrowInvalid:
        return _codes([c.decode(errors="surrogateescape") for c in chunks.to_pylist()])
    return _codes(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "").to_pylist())[0], pc.utf8_length(chunks).to_numpy().astype(np.int64)


class Solved:
    """Lattices of distinct chunks, each solved when it is met first. Those of the first `held` characters stay; the
    others go when the next texts come, so memory is bounded by them and one batch."""

    def __init__(self, v: Vocabulary, alpha: float, held: int = HELD_CHARS):
        self.v, self.alpha, self.held = v, alpha, held
        self.keys = pa.array([], pa.binary())  # by number, of those that stay
        self.g = lattices(*_codes([]), v, alpha)
        self.room = {name: np.empty(8 * held + 8, a.dtype) for name, a in vars(self.g).items()}
        self.room["edge_at"][0] = 0

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Lattices]:
        """Numbers of all chunks, how many by text, and the lattices."""
        stay, (keys, counts) = len(self.keys), _keys(texts)
        found = pa.concat_arrays([self.keys, keys]).dictionary_encode()  # numbers by first occurrence, so those that stay keep theirs
        at = int(self.g.first[stay]) if stay < len(self.g.first) else len(self.g.code)
        new = lattices(*_chunk_codes(found.dictionary.slice(stay)), self.v, self.alpha)
        new.first += at
        new.source += at
        new.to[new.to >= 0] += at
        new.edge_at = new.edge_at[1:] + self.g.edge_at[at]
        used = {"first": stay, "edge_at": at + 1, "code": at}
        for name, old in self.room.items():
            more, n = getattr(new, name), used.setdefault(name, int(self.g.edge_at[at]))
            if n + len(more) > len(old):
                self.room[name] = np.empty((n + len(more)) * 5 // 4, old.dtype)
                self.room[name][:n] = old[:n]
            self.room[name][n : n + len(more)] = more
            used[name] = n + len(more)
        self.g = Lattices(**{name: a[: used[name]] for name, a in self.room.items()})
        ends = np.append(self.g.first[1:], len(self.g.code))[: len(self.g.first)]
        self.keys = pa.concat_arrays([found.dictionary.slice(0, int(np.searchsorted(ends, self.held, side="right")))])
        return found.indices.to_numpy()[stay:].astype(np.int64), counts, self.g


@dataclass
class Paths:
    """A segmentation for each row: edges in order; row r has those from off[r] to off[r + 1]."""

    edges: np.ndarray
    item: np.ndarray  # by step: place of its chunk among all chunks
    off: np.ndarray
    log_p: np.ndarray  # by row
    bound: np.ndarray  # by step: log of what the set left there adds to exp(-ceiling), see _top
    ceiling: np.ndarray  # by row: maximum of the set that the row was drawn from
    taken: list[np.ndarray]  # by row: edges used before at the row's branching step
    branch: np.ndarray  # by row: branching step within the row, -1 for none


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times each, in a row."""
    total = int(counts.sum())
    heads = np.cumsum(counts) - counts
    return np.repeat(starts - heads, counts) + np.arange(total)


def _walk(g: Lattices, node: np.ndarray, key: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """From each node on, edges to the end of the chunk: all in order, and how many for each."""
    count = np.zeros(len(node), np.int64)
    live, parts, depth = np.flatnonzero(node >= 0), [], 0
    now, counter = node[live], _counter(key[live], sample, 0, place[live] << np.int64(20))
    while len(live):
        u = _unit(counter)
        e = g.edge_at[now].astype(np.int64)
        on = np.flatnonzero(u > g.upto[e])
        v, f = u[on], e[on]
        while len(on):
            f += 1
            over = v > g.upto[f]
            e[on] = f
            on, v, f = on[over], v[over], f[over]
        parts.append((live, e))
        count[live] += 1
        depth += 1
        now = g.to[e]
        go = np.flatnonzero(now >= 0)
        live, now, counter = live[go], now[go], counter[go] + _P
    off = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for d, (i, e) in enumerate(parts):
        out[off[i] + d] = e
    return out, count


def _bounds(g: Lattices, edges: np.ndarray, off: np.ndarray, key: np.ndarray, sample: int, from_step: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the sets left beside each step from from_step on: log of an exponential over the set's probability (infinite before,
    and where nothing is left), and log p of each row.

    others: by row, probability at step from_step of edges that are taken besides the path's own.
    """
    counts = np.diff(off)
    lp = g.log_p[edges]
    run = np.concatenate(([0.0], np.cumsum(lp)))
    spare = 1 - np.exp(lp)
    spare[(off[:-1] + from_step)[others > 0]] -= others[others > 0]
    bound = np.full(len(edges), np.inf)
    on = _spread(off[:-1] + from_step, counts - from_step)
    on = on[spare[on] > EPSILON]
    row = np.repeat(np.arange(len(counts)), counts)[on]
    e = -np.log(_uniform(key[row], sample, 1, on - off[row]))
    bound[on] = np.log(e) - (run[on] - run[off[row]] + np.log(spare[on]))
    return bound, run[off[1:]] - run[off[:-1]]


def search(g: Lattices, rows: np.ndarray, chunk: np.ndarray, key: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, Paths]], np.ndarray]:
    """rows (one more at the end): row r has chunks rows[r]:rows[r + 1] of `chunk`. Samples as (row numbers, paths), and kappa."""
    n = len(rows) - 1
    item_row = np.repeat(np.arange(n), np.diff(rows))
    place = np.arange(len(chunk)) - rows[:-1][item_row]
    gumbel = -np.log(-np.log(_uniform(key, 0, 2, np.zeros(n, np.int64))))
    edges, count = _walk(g, g.first[chunk], key[item_row], place, 0)
    item = np.repeat(np.arange(len(chunk)), count)
    ends = np.concatenate(([0], np.cumsum(count)))[rows]
    bound, log_p = _bounds(g, edges, ends, key, 0, np.zeros(n, np.int64), np.zeros(n))
    out = [(np.arange(n), Paths(edges, item, ends, log_p, bound, gumbel, [], np.full(n, -1)))]
    for s in range(1, k):
        best, which, step = _top(out, n)
        alive = np.flatnonzero(best > -np.inf)
        if not len(alive):
            break
        m = len(alive)
        own_edge, own_item, prefix_parts = np.empty(m, np.int64), np.empty(m, np.int64), [None] * len(out)
        taken: list[np.ndarray] = [np.full(m, -1, np.int64) for _ in range(s)]
        prefix_len = np.empty(m, np.int64)
        for q, (numbers, path) in enumerate(out):
            mine = np.flatnonzero(which[alive] == q)
            if not len(mine):
                continue
            local = np.searchsorted(numbers, alive[mine])
            j = step[alive[mine]]
            at = path.off[local] + j
            own_edge[mine], own_item[mine], prefix_len[mine] = path.edges[at], path.item[at], j
            path.bound[at] = np.inf
            taken[0][mine] = path.edges[at]
            same = path.branch[local] == j
            for i, t in enumerate(path.taken):
                taken[i + 1][mine] = np.where(same, t[local], -1)
            prefix_parts[q] = (mine, path.off[local], j)
        node = g.source[own_edge]
        others = np.zeros(m)
        for t in taken:
            others += np.where(t >= 0, np.exp(g.log_p[t]), 0)
        # Draw among the edges that are still open at the node.
        u = _uniform(key[alive], s, 3, np.zeros(m, np.int64)) * np.maximum(1 - others, 0)
        e, last = g.edge_at[node].copy(), g.edge_at[node + 1]
        chosen = np.full(m, -1, np.int64)
        on = np.arange(m)
        while len(on):
            is_open = np.ones(len(on), bool)
            for t in taken:
                is_open &= t[on] != e[on]
            p = np.exp(g.log_p[e[on]])
            chosen[on[is_open]] = np.where((u[on] >= 0)[is_open], e[on][is_open], chosen[on[is_open]])
            u[on[is_open]] -= p[is_open]
            e[on] += 1
            on = on[(e[on] < last[on]) & (u[on] >= 0)]
        # What follows: the rest of the branching chunk, then the row's chunks after it.
        after = rows[alive + 1] - own_item - 1
        starts = np.cumsum(after + 1) - (after + 1)
        items = _spread(own_item, after + 1)
        nodes = g.first[chunk[items]]
        nodes[starts] = g.to[chosen]
        place_now = place[items]
        tail, tail_count = _walk(g, nodes, key[alive][np.repeat(np.arange(m), after + 1)], place_now, s)
        tail_rows = np.add.reduceat(tail_count, starts)
        size = prefix_len + 1 + tail_rows
        off = np.concatenate(([0], np.cumsum(size)))
        new, new_item = np.empty(off[-1], np.int64), np.empty(off[-1], np.int64)
        for q, part in enumerate(prefix_parts):
            if part:
                mine, at, j = part
                src, dst = _spread(at, j), _spread(off[mine], j)
                new[dst], new_item[dst] = out[q][1].edges[src], out[q][1].item[src]
        new[off[:-1] + prefix_len], new_item[off[:-1] + prefix_len] = chosen, own_item
        dst = _spread(off[:-1] + prefix_len + 1, tail_rows)
        new[dst], new_item[dst] = tail, np.repeat(items, tail_count)
        bound, log_p = _bounds(g, new, off, key[alive], s, prefix_len, others)
        out.append((alive, Paths(new, new_item, off, log_p, bound, best[alive], taken, prefix_len)))
    return out, _top(out, n)[0]


def _top(paths: list[tuple[np.ndarray, Paths]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: the largest value on the agenda, which path has it, and at which step.

    A set's maximum, truncated at the ceiling of its path, is -log(exp(-ceiling) + exp(bound)): largest where bound is least.
    """
    best, which, step = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for q, (numbers, path) in enumerate(paths):
        full = np.flatnonzero(np.diff(path.off) > 0)
        if not len(full):
            continue
        least = np.minimum.reduceat(path.bound, path.off[full])
        hits = np.flatnonzero(path.bound == np.repeat(least, np.diff(path.off)[full]))  # paths without steps have no entries, so bounds align with full
        first = hits[np.searchsorted(hits, path.off[full])]
        top = np.where(least < np.inf, -np.logaddexp(-path.ceiling[full], least), -np.inf)
        better = top > best[numbers[full]]
        i = numbers[full[better]]
        best[i], which[i], step[i] = top[better], q, (first - path.off[full])[better]
    return best, which, step


def row_key(doc_id, seed: str) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{'' if doc_id is None else doc_id}")


def _ids(g: Lattices, edges: np.ndarray, off: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows, and where each row's begin (one more at the end)."""
    ids = g.piece[edges]
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, off
    codes, which = np.unique(g.code[g.source[edges[bare]]], return_inverse=True)
    own = [[v.byte_ids[c] for c in chr(x).encode(errors="surrogateescape")] for x in codes.tolist()]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    counts = np.ones(len(ids), np.int64)
    counts[bare] = sizes[which]
    ends = np.concatenate(([0], np.cumsum(counts)))
    ids = np.repeat(ids, counts)
    ids[_spread(ends[bare], counts[bare])] = np.concatenate(own)[_spread((np.cumsum(sizes) - sizes)[which], sizes[which])]
    return ids, ends[off]


def samples(texts: list[str], keys: list[int], k: int, solved: Solved) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Samples of all texts, searched together: the sample's number, and of the rows that have it: row, log p, log
    inclusion, piece ids, and where each row's begin (one more at the end)."""
    chunk, counts, g = solved.numbers(texts)
    rows = np.concatenate(([0], np.cumsum(counts)))
    paths, kappa = search(g, rows, chunk, np.array(keys, np.uint64), k) if rows[-1] else ([], np.full(len(texts), -np.inf))
    for s, (numbers, path) in enumerate(paths):
        over = np.clip(path.log_p - kappa[numbers], -1e9, 50)
        inclusion = np.where(over < -20, over, np.log(-np.expm1(-np.exp(np.maximum(over, -20)))))  # 1 - exp(-x) is x for small x
        inclusion[np.isneginf(kappa[numbers])] = 0.0
        ids, off = _ids(g, path.edges, path.off, solved.v)
        full = np.flatnonzero(np.diff(off) > 0)
        yield s, numbers[full], path.log_p[full], np.minimum(inclusion, 0.0)[full], ids, off[np.append(full, len(off) - 1)]
    none = np.flatnonzero(counts == 0)
    if len(none):
        yield 0, none, np.zeros(len(none)), np.zeros(len(none)), np.zeros(0, np.int32), np.zeros(len(none) + 1, np.int64)


def sample(texts: list[str], keys: list[int], v: Vocabulary, k: int, alpha: float, solved: Solved | None = None) -> Iterator[tuple[int, int, float, float, np.ndarray]]:
    """(row, sample, log p, log inclusion, piece ids) for all texts.

    solved: lattices that earlier calls with this vocabulary and alpha have left.
    """
    for s, rows, log_p, inclusion, ids, off in samples(texts, keys, k, solved or Solved(v, alpha)):
        for i, (r, p, c) in enumerate(zip(rows.tolist(), log_p.tolist(), inclusion.tolist(), strict=True)):
            yield r, s, p, c, ids[off[i] : off[i + 1]]


def _groups(batch, text: int, most: int) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch, some together: (first row, texts)."""
    held, size, first = [], 0, 0
    for i, t in enumerate(batch.column(text).to_pylist()):
        t = (t or b"").decode(errors="surrogateescape")
        if held and size + len(t) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def encode(docs: DataFrame, k: int = K, alpha: float = ALPHA, seed: str = SEED, model: str = MODEL, digest: bool = False, batch_chars: int = BATCH_CHARS, check: bool = False) -> DataFrame:
    """Up to k rows per row of docs: doc_id, sample, n_pieces, log_p, log_inclusion, and ids.

    digest: in place of ids their XXH64, and whether they decode to the text. check: whether they do, beside the ids.
    batch_chars trades memory (about 160 bytes a character) for speed; results don't depend on it.
    """
    bc = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "ids_hash string, decodes boolean" if digest else "ids array<int>" + ", decodes boolean" * check

    def run(batches):
        v = bc.value
        solved = Solved(v, alpha)
        for batch in batches:
            keys = [row_key(i, seed) for i in batch.column(0).to_pylist()]
            for first, texts in _groups(batch, 1, batch_chars):
                for s, rows, log_p, inclusion, ids, off in samples(texts, keys[first : first + len(texts)], k, solved):
                    spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
                    columns = [batch.column(0).take(pa.array(first + rows)), pa.array(np.full(len(rows), s, np.int32)), pa.array(np.diff(off)), pa.array(log_p), pa.array(inclusion)]
                    if digest:
                        little = ids.astype("<i4", copy=False)
                        columns.append(pa.array([xxhash.xxh64_hexdigest(little[a:b]) for a, b in spans], pa.string()))
                        names = ["ids_hash"]
                    else:
                        columns.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)))
                        names = ["ids"]
                    if digest or check:
                        at, flat = v.decode_all(ids)
                        back = [flat.slice(int(at[a]) + 1, int(at[b] - at[a]) - 1).to_pybytes() if a < b else b"" for a, b in spans]
                        columns.append(pa.array([x == texts[r].encode(errors="surrogateescape") for x, r in zip(back, rows.tolist(), strict=True)], pa.bool_()))
                        names.append("decodes")
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sample", "n_pieces", "log_p", "log_inclusion", *names])

    schema = f"doc_id {kind}, sample int, n_pieces bigint, log_p double, log_inclusion double, {last}"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (ids, and any other columns) with `text` in place of ids."""
    bc = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf("binary")
    def text(ids):
        return ids.map(bc.value.decode)

    return encoded.withColumn("text", text("ids").cast("string")).drop("ids")
