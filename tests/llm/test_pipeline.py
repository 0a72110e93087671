"""The pipeline stage by stage against brute force, on the smallest tables."""

import re
from collections import Counter

import pytest

from webinsight.llm import common, mixing

from ..conftest import SF
from .test_exact_and_rules import brute_rules, norm
from .test_near_mix_spans import brute_mix, print_of

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = common.documents(spark, SF)
    columns, rows = docs.columns, [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    now = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        now = common.stage(stage(spark, now, SF), f"test-{name}")
        if k < 4:
            assert now.columns == columns
        got = Counter(r["doc_id"] for r in now.select("doc_id").collect())
        if name == "quality":
            rows = [r for r in rows if not brute_rules(r[2])[5]]
        elif name == "exact":
            first = {}
            for i, s, t in sorted(rows):
                first.setdefault(norm(t), (i, s, t))
            rows = list(first.values())
        elif name == "near":
            prints = {i: print_of(t) for i, _, t in rows}
            gone = set()
            group = {i: i for i in prints}
            for i in sorted(prints):
                for j in sorted(prints):
                    if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                        low = min(group[i], group[j])
                        old = {group[i], group[j]}
                        group = {m: low if g in old else g for m, g in group.items()}
            gone = {i for i, g in group.items() if i != g}
            rows = [r for r in rows if r[0] not in gone]
        elif name == "mixture":
            taken = brute_mix([(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows], mixing.SEED)
            assert got == Counter({i: taken[i][3] // taken[i][0] for i, _, _ in rows if taken[i][3]})
            continue
        else:
            assert sum(got.values()) == now.count() and "ids" in now.columns
            continue
        assert got == Counter(i for i, _, _ in rows)


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("n_pieces > 0").count() == out.count()


def test_pieces_are_all_samples_and_decode(spark):
    """Tiny texts: the stage emits the operator's K distinct segmentations, or all there are, with brute-force probabilities."""
    import math

    from webinsight.llm import piece_sampling

    v = piece_sampling.Vocabulary.load()
    ids = {p: i for i, p in enumerate(v.pieces) if p}

    def every(c):
        return [((), 0.0)] if not c else [((ids[c[:k]], *a), w + v.weight[ids[c[:k]]]) for k in range(1, len(c) + 1) if c[:k] in ids for a, w in every(c[k:])]

    texts = {1: "the cat", 2: "a", 3: "house", 4: "the cat"}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars int")
    out = pipeline.pieces(spark, docs, SF)
    back = {(r["doc_id"], r["sample"]): r["text"] for r in piece_sampling.decode(out).collect()}
    rows = out.collect()
    for i, text in texts.items():
        whole = every(" " + text)
        z = math.log(sum(math.exp(w) for _, w in whole))
        p = {a: w - z for a, w in whole}
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["sample"])
        assert [r["sample"] for r in mine] == list(range(min(piece_sampling.K, len(p))))
        assert len({tuple(r["ids"]) for r in mine}) == len(mine)
        for r in mine:
            assert r["log_p"] == pytest.approx(p[tuple(r["ids"])])
            assert r["decodes"] and back[i, r["sample"]] == text
