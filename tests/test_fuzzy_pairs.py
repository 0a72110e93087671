"""Candidates of fuzzy matching: none is lost, and few pairs are handed on."""

import random

import pytest

from webinsight.operators import keywords as K


def phrases(n, seed):
    rng = random.Random(seed)
    syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    random.Random(7).shuffle(syllables)
    word = lambda: "".join(rng.choice(syllables[:19]) for _ in range(rng.randint(2, 4)))
    return sorted({word() + " " + word() for _ in range(n)})


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("threshold", [80, 95])
def test_no_pair_is_lost(spark, threshold):
    rng = random.Random(3)

    def hurt(t):
        t = list(t)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "ab", "é"])
        return "".join(t)

    left = [*phrases(60, 1), "abc", "ab", "", "x" * 90, "long text " * 30, "aab", "𝒳yz𝒳"]
    right = [hurt(t) for t in left for _ in range(3)] + phrases(40, 2)
    to = lambda texts, c: spark.createDataFrame([(t,) for t in texts], f"{c} string")
    got = [(r["k"], r["vk"]) for r in K.near_pairs(to(left, "k"), to(right, "vk"), threshold).collect()]
    assert len(got) == len(set(got))
    want = {(a, b) for a in left for b in right if min(len(a), len(b)) >= K.MIN_LENGTH and 200 * lcs(a, b) >= threshold * (len(a) + len(b))}
    assert want <= set(got) and want


def test_few_pairs_are_handed_on(spark):
    a, b = phrases(1500, 11), phrases(1500, 12)
    to = lambda texts, c: spark.createDataFrame([(t,) for t in texts], f"{c} string")
    assert K.near_pairs(to(a, "k"), to(b, "vk")).count() < 0.02 * len(a) * len(b)


def test_ratio_of_very_different_lengths(spark):
    rows = [("abc", "abd"), ("x" * 10_000, "x" * 9_000 + "y"), ("", ""), ("a", ""), *((t, t[::-1]) for t in phrases(300, 5))]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", K.indel_ratio("a", "b").alias("r")).collect()
    for r in got:
        n = len(r["a"]) + len(r["b"])
        want = 200 * 9000 / n if n > 15_000 else 200 * lcs(r["a"], r["b"]) / n if n else 100
        assert r["r"] == pytest.approx(want)
