"""License scan, Merkle manifest and filter audit: brute force, and odd rows."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from webinsight.llm import filter_audit, license_scan, merkle_manifest

from .test_exact_and_rules import ODD, SCHEMA

CLASH = {"uid": 1, "pos": 2, "part": "x", "leaf": "y", "n": 3, "w": "z", "words": 4, "blocks": 5, "left": 6, "sha": 7}


# Licenses


def want_blocks(text, templates, share=0.9):
    w = re.findall(license_scan.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    out = set()
    for at in range(0, max(len(w) - 32, 1), 32):
        block, found = set(w[at : at + 64]), {}
        for name, label, t in templates:
            s = set(license_scan.word_set(t))
            if len(s & block) >= share * len(s):
                found[name] = (s, label, len(s & block))
        for name, (s, label, n) in found.items():
            if not any(s < o for o, _, _ in found.values()):
                out.add((at, name, label, n))
    return out


def license_texts():
    grant, gpl = license_scan.TEMPLATES[1][2], "is under the GNU General Public License, version 3"
    fill = lambda n: " ".join(f"w{i}" for i in range(n))
    return [
        "Released under the MIT License.", "the mit  License; MIT-license", grant, grant.replace("granted", "given").upper(), " ".join(grant.split()[4:]), fill(31) + " " + grant, fill(60) + "\n" + grant + " " + fill(70) + " " + gpl,
        "This work " + gpl, "it is under the GNU Lesser General Public License", "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0 or licensed under CC-BY-SA 4.0", "mit", "license", "",
        "general public apache license", "General public licence", "\x00MIT\x7flicense", "mİt license", "éMIT License", fill(2000) + " Apache License", grant + " " + grant, None, fill(64), fill(65), fill(96), fill(97),
    ]


@pytest.mark.parametrize("share", [0.9, 0.5])
def test_blocks_brute_force(spark, share):
    texts = license_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = license_scan.license_blocks(docs, containment=share).collect()
    mine = defaultdict(set)
    for r in got:
        mine[r["doc_id"]].add((r["start"], r["template"], r["label"], r["overlap"]))
    assert len(got) == sum(map(len, mine.values()))
    for i, t in enumerate(texts):
        assert mine[i] == want_blocks(t, license_scan.TEMPLATES, share), t


def test_phrases_brute_force(spark):
    texts = license_texts()
    for r in license_scan.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect():
        w = re.findall(license_scan.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or ""))
        at = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        base = {x for _, x in at}
        more = {x for _, _, x, _ in want_blocks(texts[r["doc_id"]], license_scan.TEMPLATES)}
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(base)), ",".join(sorted(base | more)))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(base | more)


def test_licenses_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASH.items()})
    rows = license_scan.scan(docs).collect()
    assert len(rows) == len(ODD) and {r["labels"] for r in rows} == {""}
    assert license_scan.scan(docs.limit(0)).count() == 0
    raw = spark.createDataFrame([(1, bytearray(b"\xff mit license \xfe"))], "doc_id int, b binary").select("doc_id", F.expr("cast(b as string)").alias("text"))
    assert license_scan.scan(raw).first()["base_labels"] == "mit"
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Manifest


def join_all(xs):
    return sha256("".join(xs).encode()).hexdigest()


def grown(level, run):
    out = [level]
    while len(out[-1]) > 1:
        out.append([join_all(out[-1][i : i + run]) for i in range(0, len(out[-1]), run)])
    return out


def want_manifest(rows, run):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: join_all(map(field, (r[0], r[3], r[2], r[4], t)))
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    trees = {}
    for k, v in by.items():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[k] = grown([leaf(r, r[1]) for r in v], run)
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    top, out = grown([trees[k][-1][0] for k in order], run), []
    for s, k in enumerate(order):
        for i, r in enumerate(by[k]):
            siblings, now = [], leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else trees[k][0][i]
            for tree, at in ((trees[k], i), (top, s)):
                for level in tree[:-1]:
                    own, q = level[at // run * run :][:run], at % run
                    siblings += own[:q] + own[q + 1 :]
                    now, at = join_all([*own[:q], now, *own[q + 1 :]]), at // run
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], join_all(siblings), now, now == top[-1][0]))
    return sorted(out, key=repr)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("n", "run", "levels"), [(1, 16, 2), (17, 16, 2), (300, 16, 2), (70, 2, 2), (70, 3, 1), (260, 4, 2)])
def test_manifest_brute_force(spark, n, run, levels):
    """One source has most rows, others one or two; small runs make many tables of blocks."""
    rows = [(i, f"Text {i} É" if i % 7 else None, "en" if i % 3 else None, "big" if i % 4 else [None, "", "ä", f"s{i}"][i // 4 % 4], i) for i in range(n)]
    got = merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA), levels, run)
    assert sorted((tuple(r[c] for c in NAMES) for r in got.collect()), key=repr) == want_manifest(rows, run)


def test_manifest_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(v) for c, v in CLASH.items()})
    got = merkle_manifest.manifest(docs).collect()
    assert sorted((tuple(r[c] for c in NAMES) for r in got), key=repr) == want_manifest([list(r) for r in ODD], 16)
    assert merkle_manifest.manifest(docs.limit(0)).count() == 0


def test_versions_share_untouched_nodes():
    leaves = [join_all([str(i)]) for i in range(200)]
    t = merkle_manifest.Tree(leaves, 2)
    size, root = len(t.digests), t.root
    new = t.version(77, join_all(["x"]))
    assert len(t.digests) == size + 3 and t.root == root  # the leaf and its two ancestors
    same = [a == b for a, b in zip(t.children[root], t.children[new], strict=True)]
    assert same.count(False) == 1 and not same[77 // 16]
    other = merkle_manifest.Tree([*leaves[:77], join_all(["x"]), *leaves[78:]], 2)
    assert t.digests[new] == other.digests[other.root]
    t.drop(size)
    assert len(t.digests) == size


# Audit


def fails(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {
        f
        for f, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)), ("D", any(c in "#$%&*|" for c in t)))
        if bad
    }


def want_audit(rows, labels):
    by = defaultdict(list)
    for i, t, _, s, _ in rows:
        f = fails(t)
        if i is not None and any(o[0] is not None and o[0] < i and (o[1] or "") == (t or "") for o in rows):
            f.add("E")
        by[s or ""].append((f, labels.get(i, (0, 0))))
    out = []
    for part, docs in by.items():
        steps = []
        for order in permutations("ABCDE"):
            left = docs
            for k, c in enumerate(order, 1):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                steps.append((c, "".join(order), k, len(left), len(gone), sum(c in d[0] for d in docs) - len(gone), sum(d[0] == {c} for d in docs), sum(d[1][0] for d in gone), sum(d[1][1] for d in gone)))
        total = {c: sum(s[4] for s in steps if s[0] == c) for c in "ABCDE"}
        out += [(part, *s[1:], total[s[0]]) for s in steps]
    return sorted(out)


def test_audit_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(250))
    texts = [many, many + " #", "A b c", "a a a a", many.upper(), ("x y " * 150), "x y " * 150 + "%", "", None, "é" * 60 + "A", "É" * 49 + "A"]
    rows = [(i * 7 % 60, texts[i % len(texts)], "en", ["hot", "hot", "s", None, ""][i % 5], 1) for i in range(60)] + [(3, many, "en", "s", 1), (3, many, "en", "s", 1), (None, many, "en", "hot", 1), (None, "only", "en", "t", 1)]
    labels = {i: (i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)}
    given = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = filter_audit.audit(docs.withColumns({c: F.lit(v) for c, v in CLASH.items()}), given)
    assert sorted(tuple(r) for r in got.collect()) == want_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), given).count() == 0
    assert filter_audit.audit(docs, given.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_on_odd_rows(spark):
    got = filter_audit.audit(spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == want_audit(ODD, {})


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_orders_come_up_once_each(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for k in filter_audit.walked_orders(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == list(permutations(range(n)))


def test_swaps_keep_counts():
    counts = {m: (m * 7 % 5, m % 2, m % 3 % 2) for m in range(32)}
    d = filter_audit.Diagram(counts, 5)
    whole, size = d.weights[d.root], len(d.nodes)
    for k in (0, 3, 1, 2, 2, 1, 3, 0):
        d.swap(k)
        assert d.weights[d.root] == whole
    assert d.order == list(range(5)) and d.root == filter_audit.Diagram(counts, 5).root and size == len(filter_audit.Diagram(counts, 5).nodes)
