"""Quality rules with host verdicts (native: DataFrame functions only).

Each document gets counts and rule failures in its own row. Failures are then summed by host (here: source) with
map-side partial sums; each rule's failure rates get a beta prior whose two parameters are fitted to the hosts by
moments, and a host is rejected if a shrunk rate passes the rule's line. A small host with a few bad documents is pulled
to the mean of all hosts and stays. Verdicts are joined back: hosts with many rows are broadcast (1000 at most).

Repeats are found by XXH64 of five words; two different windows of one text agree with probability 2^-64 a pair.

Defined results: a null text counts as empty (base_failed); a null host is the host ''. Repeated rows are judged each on
its own. An empty table gives an empty result. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected if the shrunk rate of any rule is over this.
MAX_HOST_RATE = 0.5
#: Prior strength (a + b) where the hosts don't differ more than chance explains.
MAX_STRENGTH = 1000.0
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")


def _covered(windows: Column) -> Column:
    """windows: their hashes in order. Number of words in windows that occur twice or more."""

    def spans(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, j: F.get(s, j)["h"] == x["h"]
        twice = F.filter(s, lambda x, j: ((j > 0) & F.coalesce(same(x, F.greatest(j - 1, F.lit(0))), F.lit(False))) | ((j < n - 1) & F.coalesce(same(x, j + 1), F.lit(False))))
        return common.let(
            F.array_sort(F.transform(twice, lambda x: x["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda i, j: F.least(F.coalesce(F.get(p, j + 1), i + WINDOW) - i, F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    pos = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(common.let(F.array_sort(pos), spans))


def repeat_words(words: Column) -> Column:
    at = lambda w, i, k: F.get(w, i + k)
    return common.let(
        words,
        lambda w: F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(
            common.let(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(at(w, i, k) for k in range(WINDOW)))), _covered)
        ),
    )


def rule_counts(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Per row: key, host, the counts, base_failed, one failure flag a rule, and the columns in keep."""
    keep = keep or []
    t = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(F.col(key), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), t.alias("t"), common.words(F.col(text)).alias("w"), *keep)
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike(common.WORD))
    long = lambda c: c.cast("long")
    one = one.select(
        key,
        "host",
        *keep,
        long(F.size("w")).alias("n_words"),
        long(F.char_length(F.regexp_replace("t", f"{common.SPACE}+", ""))).alias("word_chars"),
        long(F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        common.let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        common.let(lines, lambda x: long(F.size(x))).alias("n_lines"),
    )
    few, rep = F.col("n_words") < MIN_WORDS, 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return one.select(
        "*",
        (few | rep).alias("base_failed"),
        few.alias("few_words"),
        rep.alias("repeats"),
        (10 * F.col("n_symbols") > F.col("word_chars")).alias("symbols"),
        (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")).alias("dup_lines"),
        ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))).alias("word_length"),
    )


def host_verdicts(counts: DataFrame) -> DataFrame:
    """Per host: host_docs, failures and shrunk rate of each rule, host_failed. counts should be a staged table."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("host_docs"), *(F.count_if(F.col(r)).alias(f"host_{r}") for r in RULES))
    hosts = common.stage(hosts, "host-failures")
    n = F.col("host_docs").cast("double")
    moments = []
    for r in RULES:
        p = F.col(f"host_{r}") / n
        moments += [F.sum(f"host_{r}").cast("double").alias(f"s_{r}"), F.sum(n * p * p).alias(f"q_{r}")]
    got = hosts.agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(n * n).alias("nn"), *moments).first()
    out = hosts
    for r in RULES:
        total, k = got["n"] or 0.0, got["k"]
        mean = (got[f"s_{r}"] or 0.0) / total if total else 0.0
        # Between hosts: weighted variance of rates less what chance gives; a + b = m (1 - m) / var - 1.
        spread = (got[f"q_{r}"] or 0.0) - total * mean * mean
        chance = (k - 1) * mean * (1 - mean)
        room = total - (got["nn"] or 0.0) / total if total else 0.0
        var = (spread - chance) / room if room > 0 else 0.0
        strength = MAX_STRENGTH if var <= 0 else min(MAX_STRENGTH, max(1.0, mean * (1 - mean) / var - 1))
        out = out.withColumn(f"rate_{r}", (F.col(f"host_{r}") + F.lit(strength * mean)) / (n + F.lit(strength)))
    return out.withColumn("host_failed", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > MAX_HOST_RATE)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: counts, base_failed, host_docs, host_failed, kept."""
    counts = common.stage(rule_counts(docs, text, host, key), "rule-counts")
    verdicts = host_verdicts(counts).select("host", "host_docs", "host_failed")
    out = common.attach(counts, verdicts, ["host"], "host_docs", counts.count())
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_docs", "host_failed", kept.alias("kept"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, all columns. Rules are judged once, in the row itself, so texts aren't shuffled: rows are
    written beside their failures, hosts are summed from these, and the rows of failed hosts are left out on reading."""
    mine = F.struct(*(F.col(c) for c in docs.columns)).alias("__row")
    judged = rule_counts(docs.select("doc_id", "text", "source", mine), keep=["__row"])
    # A rejected row is needed for its host's counts only.
    row = F.when(~F.col("base_failed"), F.col("__row")).alias("__row")
    judged = common.stage(judged.select("host", *RULES, "base_failed", row), "judged-rows")
    hosts = common.stage(host_verdicts(judged.drop("__row")).select("host", "host_docs", "host_failed"), "host-verdicts")
    line = max(1.0, (hosts.agg(F.sum("host_docs")).first()[0] or 0) * common.HOT_SHARE)
    hot, bad = hosts.filter(F.col("host_docs") >= line), hosts.filter("host_failed")
    out = judged.filter(~F.col("base_failed")).join(F.broadcast(hot.filter("host_failed").select("host")), "host", "left_anti")
    rare = bad.filter(F.col("host_docs") < line).select("host")
    if not rare.isEmpty():  # rows of hosts with many rows are never dealt by host
        big = F.broadcast(hot.select("host"))
        out = out.join(big, "host", "left_semi").unionByName(out.join(big, "host", "left_anti").join(rare, "host", "left_anti"))
    return out.select("__row.*")
