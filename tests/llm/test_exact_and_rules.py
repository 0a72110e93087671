"""Exact dedup and quality rules against brute force, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from webinsight.llm import exact_dedup, quality_rules
from webinsight.llm.common import documents

from ..conftest import SF

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 5000
ODD = [
    (1, "a b  c", "en", "s", 6), (2, "a\tb c", "en", None, 5), (3, None, None, "s", None), (4, "", "en", "s", 0), (5, "   ", "en", "t", 3), (None, "a b c", "en", "s", 5),
    (6, LONG, "en", "s", None), (7, LONG + "x", "en", "s", None), (8, LONG, "en", "s", None), (9, "ab c", "en", "s", 4), (1, "a b  c", "en", "s", 6), (10, "é" * 40, "fr", "s", 40), (11, "é" * 41, "fr", "s", 41),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize(("block", "bits"), [(4096, 40), (7, 40), (7, 2), (3, 1)])
def test_identity_is_equality(spark, odd, block, bits):
    """With 1 or 2 bits of bucket nearly all blocks share buckets: ranks alone must keep them apart."""
    small = odd.withColumn("text", F.substring("text", 1, 60)) if bits < 40 else odd
    rows = exact_dedup.identities(small, block=block, bits=bits).collect()
    by = defaultdict(set)
    for r in rows:
        by[(r["n_blocks"], r["identity"])].add(r["text_sha256"])
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({r["text_sha256"] for r in rows})
    assert len(rows) == len(ODD)


def test_exact_duplicates_brute_force(spark):
    docs = documents(spark, SF)
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        groups[norm(r["text"])].append(r["doc_id"])
    want = {i: (min(v), len(v), i == min(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i in v}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == want


def test_exact_duplicates_odd_rows(odd):
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert Counter(r["kept"] for r in rows)[True] == len({norm(r[1]) for r in ODD})
    null = next(r for r in rows if r["doc_id"] is None)
    assert (null["keep_id"], null["group_size"], null["kept"]) == (1, 4, False)
    assert sum(r["kept"] for r in rows if r["doc_id"] == 1) == 1


def test_drop_exact_duplicates(odd):
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    texts = [norm(r["text"]) for r in left.collect()]
    assert sorted(texts) == sorted({norm(r[1]) for r in ODD})


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    cover = {k for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_rule_counts(spark, odd, which):
    docs = odd if which == "odd" else documents(spark, SF)
    by = {r["text"]: brute_rules(r["text"]) for r in docs.select("text").collect()}
    rows = docs.join(quality_rules.quality_rules(docs).dropDuplicates(["doc_id"]), "doc_id").collect()
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == by[r["text"]]


def test_host_verdicts(spark):
    """A host of junk is rejected with its good documents, a small host with one bad document is not."""
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 else "too short", "en", "junk", 1) for i in range(200)] + [(1000 + i, good, "en", f"h{i % 30}", 1) for i in range(900)] + [(5000, "bad", "en", "tiny", 1), (5001, good, "en", "tiny", 1)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[0]["kept"] and got[0]["host_failed"] and not got[0]["base_failed"]
    assert got[1000]["kept"] and got[5001]["kept"] and not got[5000]["kept"]
    kept = quality_rules.keep_quality(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_rules.keep_quality(none).count() == 0


def test_clashing_columns(spark, odd):
    more = odd.withColumns({"uid": F.lit(1), "names": F.lit("x"), "host": F.lit("y"), "kept": F.lit(True), "t": F.lit(0), "w": F.lit(0)})
    assert exact_dedup.exact_duplicates(more).count() == len(ODD)
    assert quality_rules.quality_rules(more).count() == len(ODD)
    assert exact_dedup.drop_exact_duplicates(more).columns == more.columns
    assert quality_rules.keep_quality(more).columns == more.columns
