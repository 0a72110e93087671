"""SimHash, mixing and sentence spans against brute force, with odd rows."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webinsight.llm import common, exact_dedup, mixing, quality_rules, simhash, substring_dedup
from webinsight.llm.common import documents

from ..conftest import SF
from .test_exact_and_rules import ODD, SCHEMA


def print_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_codes_are_perfect_and_links_are_met():
    """Construction asserts that each syndrome has one pattern within the radius; here pairs at 1 and 2 bits meet at an anchor."""
    rng = np.random.default_rng(1)
    blocks = simhash.code(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    at = lambda v: set(zip(*(a.tolist() for a in simhash.anchors_of(v, blocks, 1)), strict=True))
    mine = at(x)
    for t in (1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, t, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        met = {i for i, _ in mine & at(y)}
        assert met == set(range(len(x)))


def test_near_duplicates_brute_force(spark):
    docs = documents(spark, SF)
    rows = docs.select("doc_id", "text").collect()
    fp = {r["doc_id"]: print_of(r["text"]) for r in rows}
    parent = {i: i for i in fp}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(fp)
    for i in ids:
        for j in ids:
            if j > i and (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (format(fp[i], "016x"), find(i)) for i in ids}


def test_chain_of_links_is_one_component(spark):
    prints = [0, 3, 15, 63, 255, 7 << 40]
    rows = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(rows)).collect()}
    assert label == {0: 0, 3: 0, 15: 0, 63: 0, 255: 0}


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"fp": F.lit(1), "label": F.lit("x"), "n": F.lit(2)})
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {3, 4, 5} and {r["component_id"] for r in zero} == {3}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns


def brute_mix(rows, seed=mixing.SEED):
    """rows (doc_id, source, size)."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    level = 0.0
    for _ in range(200):
        full = [s for s in sources if 2 * size[s] <= level * weight[s]]
        room = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        active = sum(weight[s] for s in sources if s not in full)
        level = max(level, room / active) if active else level
    target = {s: min(level * weight[s], 2.0 * size[s]) for s in sources}
    out = {}
    for s in sources:
        whole = int(target[s] // size[s]) if size[s] else 0
        goal, run = target[s] - whole * size[s], 0
        u = lambda i: int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
        for i, n in sorted(((i, n) for i, t, n in rows if t == s), key=lambda r: (u(r[0]), r[0])):
            run += n
            out[i] = (n, size[s], target[s], n * (whole + (2 * run - n <= 2 * goal)))
    return out


def test_mix_brute_force(spark):
    docs = documents(spark, SF)
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    want = brute_mix(rows)
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert set(got) == set(want)
    for i, (size, source, target, taken) in got.items():
        assert (size, source, taken) == (want[i][0], want[i][1], want[i][3])
        assert target == pytest.approx(want[i][2], rel=1e-12)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {i: g[3] for i, g in got.items()}


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 50), "en", None if i % 3 == 0 else f"s{i % 4}", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("s"), F.max("size").alias("m"), F.max(F.col("taken") / F.col("size")).alias("times")).collect():
        assert abs(r["taken"] - r["s"]) <= r["m"] and r["times"] <= 2


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"key": F.lit(1), "u": F.lit(1), "target": F.lit(1.0), "times": F.lit(3)})
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    again = mixing.repeat_documents(docs)
    assert again.columns == docs.columns
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in again.collect())
    assert words == taken


def test_empty_sources_have_target_zero(spark):
    docs = spark.createDataFrame([(1, "", "en", "a", 0), (2, "x y", "en", "b", 3)], SCHEMA)
    got = {r["doc_id"]: r["target"] for r in mixing.mix(docs).collect()}
    assert got[1] == 0.0 and got[2] > 0


def brute_runs(rows, span, least, fixed):
    """Runs of span sentences (fixed), or of any number from span on: all but the first occurrence goes, in stretches of enough words."""
    cut = {i: substring_dedup.sentences((t or "").encode()) for i, t in rows}
    first, marks = {}, {}
    for turn in (0, 1):
        for i, t in sorted(rows):
            data = (t or "").encode()
            parts = [(k, tuple(data[a:b].split())) for k, (a, b) in enumerate(cut[i]) if data[a:b].split()]
            for p in range(len(parts)):
                for q in range(p + span, min(p + span, len(parts)) + 1 if fixed else len(parts) + 1):
                    h = tuple(w for _, w in parts[p:q])
                    if turn == 0:
                        first.setdefault(h, (i, p))
                    elif first[h] != (i, p):
                        marks.setdefault(i, set()).update(range(p, q))
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        parts = [(k, len(data[a:b].split())) for k, (a, b) in enumerate(cut[i]) if data[a:b].split()]
        gone, p = set(), 0
        while p < len(parts):
            q = p
            while q < len(parts) and q in marks.get(i, ()):
                q += 1
            if q > p and sum(n for _, n in parts[p:q]) >= least:
                gone |= set(range(parts[p][0], parts[q - 1][0] + 1))
            p = max(q, p + 1)
        out[i] = b"".join(data[a:b] for k, (a, b) in enumerate(cut[i]) if k not in gone).decode()
    return out


@pytest.mark.parametrize(("span", "least"), [(2, 25), (3, 0), (2, 0)])
def test_spans_brute_force(spark, span, least):
    docs = documents(spark, SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs, span, least).collect()}
    assert got == brute_runs(rows, span, least, True)


def test_sentences_cover_the_text():
    data = ("A b. " + "word, " * 50 + "end! No\nline  ").encode()
    cuts = substring_dedup.sentences(data)
    assert b"".join(data[a:b] for a, b in cuts) == data and max(len(data[a:b].split()) for a, b in cuts) < 40


def sentence(rng, n, tag):
    return " ".join([f"{tag}{rng.integers(0, 10**9)}" for _ in range(n)]) + "."


@pytest.mark.parametrize("sizes", [(14, 14, 12, 12), (30, 3, 3), (3, 3, 30), (13, 12), (5, 5, 5, 5, 5, 5, 5), (24, 1, 24, 1)])
def test_all_runs_brute_force(spark, sizes):
    rng = np.random.default_rng(len(sizes))
    passage = " ".join(sentence(rng, n, "p") for n in sizes)
    rows = [(i, f"{sentence(rng, 6, 'a')} {passage} {sentence(rng, 40, 'z')} {sentence(rng, 2, 'z')}") for i in range(5)]
    rows += [(9, f"{passage} {sentence(rng, 3, 'm')} {passage}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_runs(rows, substring_dedup.SPAN, 0, False)
    assert all(" p" not in f" {got[i]}" for i in (1, 2, 3, 4))


def test_planted_passage(spark):
    passage = " ".join(f"This is sentence number {i} of a passage that many documents share." for i in range(6))
    rows = [(i, f"Document {i} begins in its own way, number {i * 7}. {passage} And it ends {i * 13} alone.", "en", "s", 1) for i in range(30)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == (rows[0][1], 0)
    for i in range(1, 30):
        assert "passage" not in got[i][0] and got[i][1] == 6
        assert got[i][0].startswith(f"Document {i} begins") and got[i][0].endswith("alone.")


def test_spans_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"tag": F.lit(1), "spans": F.lit("x"), "first": F.lit(1)})
    rows = substring_dedup.remove_repeats(docs)
    assert rows.columns == [*docs.columns, "n_sentences", "n_removed"]
    assert rows.count() == len(ODD)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    named = docs.withColumns({"n_removed": F.lit("mine"), "n_sentences": F.lit(1)})
    again = substring_dedup.remove_repeats(named)
    assert again.columns == rows.columns and again.agg(F.sum("n_removed")).first()[0] is not None


def test_spans_keep_bytes_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"One \xff two. Three.")), (2, None)], "doc_id bigint, raw binary").select("doc_id", F.expr("cast(raw as string)").alias("text"))
    got = substring_dedup.remove_repeats(docs).select("doc_id", F.col("text").cast("binary").alias("raw")).collect()
    assert {r["doc_id"]: bytes(r["raw"]) for r in got} == {1: b"One \xff two. Three.", 2: b""}


def test_near_stage_tells_rows_apart_by_id_and_text(spark):
    a, b = "a b c d e f g h", "quite another text that shares no word with it"
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (None, b, "en", "s", 1), (None, "third one of them", "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "third one of them"), (1, a), (5, b), (7, "")]
    assert simhash.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_stage_with_many_equal_rows(spark):
    rows = [(1, "same text", "en", "s", 1)] * 60 + [(2, "same  text", "en", "s", 1)] * 30 + [(1, "other", "en", "s", 1), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)]
    kept = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "x"), (1, "other"), (1, "same text")]


@pytest.mark.parametrize("share", [0.001, 0.9])
def test_failed_hosts_leave_however_many_rows_they_have(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    good, bad = " ".join(f"word{i}" for i in range(40)), " ".join(f"wo#rd$%&{i}" for i in range(40))
    rows = [(i, bad, "en", "bad", 1) for i in range(400)] + [(i, good, "en", "good" if i % 2 else "fine", 1) for i in range(400, 2000)]
    kept = quality_rules.keep_quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"] for r in kept} == set(range(400, 2000)) and len(kept) == 1600
