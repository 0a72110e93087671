"""Keywords: volumes, hygiene, matching to facet values, scores and tiers, dominant categories, colours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webinsight.functions.norm import keyword_norm
from webinsight.functions.text import plain_tokens, stem
from webinsight.operators.common import stage

#: Fixed values: (threshold, adjustment), the first that the value meets.
COVERAGE_BANDS = ((90.0, 8), (75.0, 3), (60.0, 0), (40.0, -8), (0.0, -18))
DOMINANCE_BANDS = ((0.85, 6), (0.65, 2), (0.45, 0), (0.30, -8), (0.0, -15))
COUNT_BANDS = ((1000, 0), (500, -3), (200, -8), (100, -12), (0, -15))
DOMINANCE_MIN_COUNT = 1000
FUZZY_MIN, FUZZY_STRICT, MIN_LENGTH, LENGTH_RATIO, SYNONYM_SCORE = 80, 95, 3, 0.4, 95
STRICT_FACETS = ("winkel", "merk")
#: Words that alone don't tell what is searched (sizes, colours, shapes; nouns; forms of a product).
GENERIC_ADJECTIVES = (
    "mini midi maxi mega micro macro small medium large xs s m l xl xxl xxxl klein kleine groot grote middel middelgroot middelgrote "
    "kort korte lang lange smal smalle breed brede dun dunne dik dikke hoog hoge laag lage compact compacte "
    "wit witte zwart zwarte grijs grijze rood rode blauw blauwe groen groene geel gele oranje paars paarse roze bruin bruine "
    "beige creme crème goud gouden zilver zilveren rond ronde vierkant vierkante rechthoekig rechthoekige ovaal ovale plat platte "
    "glad gladde ruw ruwe zacht zachte hard harde metalen houten plastic rubber rubberen basic standaard algemeen algemene"
).split()
GENERIC_NOUNS = "meubel meubels meubilair set sets kast kasten huis huisje huisjes tafel tafels stoel stoelen lamp lampen accessoire accessoires onderdeel onderdelen systeem systemen unit units pakket pakketten".split()
GENERIC_FORMS = "poeder poeders spray sprays gel gels tablet tabletten capsule capsules korrel korrels vloeibaar vloeistof pasta schuim stick sticks doekje doekjes druppels".split()
#: Names of shops that often match by chance, and (pattern in the query, pattern in the value, penalty).
GENERIC_VALUES = ["action", "action.com", "hema", "ikea", "kruidvat", "kruidvat.nl", "blokker", "gamma", "praxis", "karwei", "bol.com", "amazon", "mediamarkt", "coolblue", "wehkamp", "leen bakker"]
BAD_PAIRS = [
    (r"\bboren\b", "appelboren", -40),
    (r"\bzwembad\b", "zwembadfonteinen", -30),
    (r"\bpomp\b", "pompons", -40),
    (r"(?:\btoilet\b.*fontein|fontein.*toilet|fontein.*wc|wc.*fontein)\b", "vijverfonteinen", -40),
    (r"\bopblaasba", "buttplugs|dildo|vibrator", -50),
    (r"\bmagnetron\b", "magnetronsterilisators", -30),
    (r"\bauto\b", "autopeds", -30),
    (r"\bbank\b.*kopen|kopen.*bank\b", "bankhoezen", -20),
    (r"\bkeuken\b", "keukenpincetten", -30),
]
LONG_TOKEN, SEMANTIC_MIN_COUNT, MAX_DEPTH = 8, 10, 6


def category_volume(keywords: DataFrame, forms: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volume per category, main category and in total (rollup): each keyword before and after each form of a category."""
    combos = keywords.join(forms, "main_cat").select("main_cat", "deepest_cat", F.explode(F.array(F.concat_ws(" ", "keyword", "form"), F.concat_ws(" ", "form", "keyword"))).alias("combo"))
    combos = combos.withColumn("k", keyword_norm(F.col("combo"))).select("main_cat", "deepest_cat", "k").distinct()
    best = volumes.groupBy(keyword_norm(F.col("keyword")).alias("k")).agg(F.max("volume").alias("volume"))
    return combos.join(best, "k").rollup("main_cat", "deepest_cat").agg(F.sum("volume").alias("volume"), F.count("*").alias("combos"))


def facet_volume(rows: DataFrame, volumes: DataFrame) -> DataFrame:
    """rows (row_id, combos): distinct (combo, row) pairs joined to volumes; one combo may credit several rows."""
    pairs = rows.select("row_id", F.explode("combos").alias("c")).select("row_id", keyword_norm(F.col("c")).alias("k")).distinct()
    best = volumes.groupBy(keyword_norm(F.col("keyword")).alias("k")).agg(F.max("volume").alias("volume"))
    return rows.select("row_id").join(pairs.join(best, "k").groupBy("row_id").agg(F.sum("volume").alias("volume")), "row_id", "left").na.fill(0, ["volume"])


def keyword_hygiene(keywords: DataFrame, volumes: DataFrame) -> DataFrame:
    """Clean form, reason to skip, and volume by the clean form, else by the form without blanks."""
    clean = keyword_norm(F.col("keyword"))
    rows = keywords.select("keyword", clean.alias("clean")).distinct()
    skip = F.when(F.col("clean") == "", "empty").when(F.length("clean") > 80, "too_long")
    best = volumes.groupBy(keyword_norm(F.col("keyword")).alias("k")).agg(F.max("volume").alias("v"))
    tight = best.groupBy(F.replace("k", F.lit(" "), F.lit("")).alias("t")).agg(F.max("v").alias("tv"))
    rows = rows.withColumn("skip", skip).join(best, F.col("clean") == F.col("k"), "left").withColumn("nt", F.replace("clean", F.lit(" "), F.lit(""))).join(tight, F.col("nt") == F.col("t"), "left")
    return rows.select("keyword", "clean", "skip", F.when(F.col("skip").isNull(), F.coalesce("v", "tv")).alias("volume"))


def keyword_redirects(paths: DataFrame, results: DataFrame) -> DataFrame:
    """paths (old, combos): the combo with most results, the first in the list on a tie."""
    rows = paths.select("old", F.posexplode("combos").alias("pos", "combo")).join(results, "combo")
    best = rows.groupBy("old").agg(F.max(F.struct(F.col("n"), (-F.col("pos")).alias("p"), "combo")).alias("b"))
    return best.select("old", F.col("b.combo").alias("combo"), F.col("b.n").alias("n"))


def common_length(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, all pairs at once: a row of bits for each a, a step for each place in b
    (bit-parallel; letters beyond 63 are carried in further words)."""
    n = len(a)
    wide = max((len(x) for x in a), default=0)
    long = max((len(x) for x in b), default=0)
    words = max((wide + 62) // 63, 1)
    code = lambda texts, width, pad: np.array([[*map(ord, x), *[pad] * (width - len(x))] for x in texts], np.int32).reshape(n, width)
    left, right = code(a, words * 63, -1).reshape(n, words, 63), code(b, long, -2)
    weight = np.uint64(1) << np.arange(63, dtype=np.uint64)
    full = np.uint64((1 << 63) - 1)
    rows = np.full((n, words), full)
    for j in range(long):
        match = ((left == right[:, j, None, None]) * weight).sum(axis=2, dtype=np.uint64)
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            row = rows[:, w]
            hit = row & match[:, w]
            total = row + hit + carry
            carry = total >> np.uint64(63)
            rows[:, w] = (total & full) | (row & ~match[:, w])
    inside = np.arange(words * 63).reshape(words, 63) < np.array([len(x) for x in a]).reshape(n, 1, 1)
    return ((((rows[:, :, None] >> np.arange(63, dtype=np.uint64)) & np.uint64(1)) == 0) & inside).sum(axis=(1, 2))


#: Letters of texts that are compared at once.
CELLS = 4_000_000


@F.pandas_udf(T.DoubleType())
def indel_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """100 (len a + len b - insertions and deletions) / (len a + len b)."""
    for a, b in pairs:
        la, lb = a.str.len().to_numpy(), b.str.len().to_numpy()
        order, common = np.lexsort((lb, la)), np.zeros(len(a), np.int64)
        # Pairs of about equal lengths are compared together: arrays are as wide as these, in slices of CELLS at most.
        at = 0
        while at < len(order):
            width = max(int(la[order[at]]), 63)
            end = int(np.searchsorted(la[order], 2 * width, "right"))
            end = min(end, at + max(1, CELLS // (2 * width)))
            mine = order[at:end]
            common[mine] = common_length(a.iloc[mine].tolist(), b.iloc[mine].tolist())
            at = end
        size = (la + lb).astype(float)
        yield pd.Series(np.where(size > 0, 200.0 * common / np.maximum(size, 1), 100.0))


#: Letters fall into eight groups of about equal weight; a common part of T letters is compared over fewer groups the longer it is.
GROUPS = 8
MERGED = {8: (0, 1, 2, 3, 4, 5, 6, 7), 6: (0, 1, 2, 3, 4, 4, 5, 5), 5: (0, 1, 2, 2, 3, 3, 4, 4), 4: (0, 0, 1, 1, 2, 2, 3, 3), 3: (0, 0, 0, 1, 1, 2, 2, 2), 2: (0, 0, 0, 0, 1, 1, 1, 1), 1: (0,) * 8}


def _n_groups(common: int) -> int:
    return next((g for most, g in ((8, 8), (12, 6), (18, 5), (26, 4), (60, 3), (200, 2)) if common <= most), 1)


def letter_groups(texts: DataFrame, column: str) -> tuple[str, str]:
    """Letters in use (Unicode bounds them) and the group of each as a digit, so that groups hold about as many letters of the texts."""
    letters = texts.select(F.explode(F.split(column, "")).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    held, chars, digits = [0] * GROUPS, [], []
    for r in letters:
        g = held.index(min(held))
        held[g] += r["count"]
        chars.append(r["c"])
        digits.append(str(g))
    return "".join(chars), "".join(digits)


@cache
def _taken(groups: int, n: int) -> np.ndarray:
    """Every way to take n letters out of groups: a row of counts each."""
    if groups == 1:
        return np.array([[n]])
    return np.concatenate([np.column_stack([np.full(len(rest := _taken(groups - 1, n - k)), k), rest]) for k in range(n + 1)])


def common_parts(counts: np.ndarray, least: Callable[[int], range], need: Callable[[int], int], swap: bool) -> tuple[np.ndarray, np.ndarray]:
    """(other length, key) for each part that a text with these group counts may have in common with a text of another length. swap: the
    other text is the one of the left side."""
    n, others, keys = int(counts.sum()), [], []
    for m in least(n):
        t = need(n + m)
        if t > min(n, m):
            continue
        g = _n_groups(t)
        mine = np.bincount(MERGED[g], counts, g).astype(np.int64)
        left = mine - _taken(g, n - t)
        left = left[(left >= 0).all(axis=1)]
        a, b = (m, n) if swap else (n, m)
        h = np.full(len(left), a * 1_000_003 + b, np.uint64)
        for c in left.T.astype(np.uint64):
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        others.append(np.full(len(h), m, np.int32))
        keys.append(h.view(np.int64))
    return (np.concatenate(others), np.concatenate(keys)) if keys else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def near_pairs(left: DataFrame, right: DataFrame, threshold: int = FUZZY_MIN) -> DataFrame:
    """(k, vk): every pair of k of left and vk of right whose indel ratio may reach the threshold; none is lost.

    A ratio of t needs a common subsequence of T = t (len k + len vk) / 200 letters. In counts of letter groups it is a part of T
    letters of both texts: each side lists the parts of T letters that its counts allow, and they meet in an equi-join on
    (lengths, part). Texts with equal counts are one class there, so classes are joined, not texts; classes with T letters in common
    by all groups are then expanded, and pairs of texts with T common letters stay (a letter counts as often as it occurs).
    """
    slack = (100 - threshold) / 100
    low, high = max(LENGTH_RATIO, (1 - slack) / (1 + slack)), min(1 / LENGTH_RATIO, (1 + slack) / (1 - slack))
    lengths = lambda n: range(max(MIN_LENGTH, math.ceil(n * low - 1e-9)), math.floor(n * high + 1e-9) + 1)
    need = lambda both: math.ceil(threshold / 200 * both - 1e-9)
    left, right = left.select(F.col("k").alias("t")).distinct(), right.select(F.col("vk").alias("t")).distinct()
    long = F.length("t") >= MIN_LENGTH
    left, right = stage(left.filter(long), "near-left"), stage(right.filter(long), "near-right")
    chars, digits = letter_groups(left.unionByName(right), "t")
    in_group = F.translate("t", chars, digits) if chars else F.col("t")
    count = lambda g: F.length(F.col("d")) - F.length(F.replace(F.col("d"), F.lit(str(g)), F.lit("")))
    classed = lambda df: df.withColumn("d", in_group).select("t", F.array(*(count(g) for g in range(GROUPS))).alias("c"))

    def parts(df: DataFrame, swap: bool, c: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                for counts in batch.column(0).to_pylist():
                    other, key = common_parts(np.array(counts), lengths, need, swap)
                    yield pa.RecordBatch.from_arrays([pa.array([counts] * len(key), batch.schema.field(0).type), pa.array(other), pa.array(key)], names=[c, "other", "key"])

        return df.select(F.col("c").alias(c)).distinct().mapInArrow(run, f"{c} array<int>, other int, key bigint")

    a, b = classed(left), classed(right)
    met = parts(a, False, "ca").drop("other").join(parts(b, True, "cb").drop("other"), "key").select("ca", "cb").distinct()
    total = lambda *arrays: F.aggregate(F.concat(*arrays), F.lit(0), lambda x, y: x + y)
    needed = F.ceil(F.lit(threshold / 200) * total("ca", "cb") - 1e-9)
    met = met.filter(total(F.zip_with("ca", "cb", lambda x, y: F.least(x, y))) >= needed)
    # Letters numbered by occurrence, so that sets of them are bags.
    letters = F.split("t", "")
    bag = F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x)).cast("string")))
    pairs = stage(met, "near-classes").join(a.select(F.col("c").alias("ca"), F.col("t").alias("k"), bag.alias("ba")), "ca").join(b.select(F.col("c").alias("cb"), F.col("t").alias("vk"), bag.alias("bb")), "cb")
    enough = F.size(F.array_intersect("ba", "bb")) >= F.ceil(F.lit(threshold / 200) * (F.length("k") + F.length("vk")) - 1e-9)
    return pairs.filter(enough).select("k", "vk")


def match_keywords(queries: DataFrame, values: DataFrame, synonyms: DataFrame, threshold: int = FUZZY_MIN) -> DataFrame:
    """queries (query) to values (value_id, value, count, and facet where there is one): exact, then without blanks and marks,
    then by synonym, then fuzzy. Only queries without an equi-join match reach the fuzzy stage, which sees every value that
    may reach the threshold; values of a STRICT_FACETS facet need FUZZY_STRICT. The largest count wins among equals."""
    facet = F.lower("facet") if "facet" in values.columns else F.lit(None).cast("string")
    q = queries.select("query", keyword_norm(F.col("query")).alias("k")).distinct()
    v = values.select("value_id", "value", "count", keyword_norm(F.col("value")).alias("vk"), F.coalesce(facet.isin(*STRICT_FACETS), F.lit(False)).alias("strict"))
    tight = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    cols = ["query", "value_id", "value", "count", "score", "how"]
    exact = q.join(v, F.col("k") == F.col("vk")).withColumns({"score": F.lit(100.0), "how": F.lit("exact")}).select(cols)
    near = q.join(v, tight(F.col("k")) == tight(F.col("vk"))).withColumns({"score": F.lit(99.0), "how": F.lit("measure")}).select(cols)
    syn = q.join(synonyms, F.col("k") == F.col("word")).join(v, F.col("meaning") == F.col("vk")).withColumns({"score": F.lit(float(SYNONYM_SCORE)), "how": F.lit("synonym")}).select(cols)
    sure = exact.unionByName(near).unionByName(syn)
    open_q = q.join(sure.select("query").distinct(), "query", "left_anti").filter(F.length("k") >= MIN_LENGTH)
    pairs = near_pairs(open_q, v, threshold).withColumn("score", indel_ratio("k", "vk")).filter(F.col("score") >= threshold)
    fuzzy = open_q.join(pairs, "k").join(v, "vk").filter(~F.col("strict") | (F.col("score") >= FUZZY_STRICT)).withColumn("how", F.lit("fuzzy")).select(cols)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("count"), "value_id")
    return sure.unionByName(fuzzy).withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")


def numeric_signature(text: Column) -> Column:
    """Number groups of a text as a set: dimensions with their sides in order ("5x3" is "3x5"), and the numbers outside them."""
    dimension, number = r"\d+(?:[.,]\d+)?\s*[x×]\s*\d+(?:[.,]\d+)?", r"\d+(?:[.,]\d+)?"
    low = F.lower(F.coalesce(text, F.lit("")))
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(number), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    in_order = lambda c: F.transform(F.array_sort(F.transform(numbers(c), lambda x, i: F.struct(x.cast("double").alias("n"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    sides = F.transform(F.regexp_extract_all(low, F.lit(dimension), F.lit(0)), lambda d: F.array_join(in_order(d), "x"))
    return F.array_distinct(F.concat(sides, numbers(F.regexp_replace(low, dimension, " "))))


def token_coverage(queries: DataFrame, values: DataFrame, least: int = 50) -> DataFrame:
    """floor(50 coverage + 30 specificity + 20 adjacency) of value tokens in the query, joined on stems; a value whose number
    groups aren't all in the query is no match; best value a query."""
    q = queries.select("query", F.posexplode(F.transform(plain_tokens(F.col("query")), stem)).alias("pos", "s"), F.size(plain_tokens(F.col("query"))).alias("nq"))
    v = values.select("value_id", "count", "value", F.explode(F.array_distinct(F.transform(plain_tokens(F.col("value")), stem))).alias("s"), F.size(F.array_distinct(F.transform(plain_tokens(F.col("value")), stem))).alias("nv"))
    q = q.withColumn("q_numbers", numeric_signature(F.col("query")))
    v = v.withColumn("v_numbers", numeric_signature(F.col("value"))).drop("value")
    rows = q.join(v, "s").filter(F.size(F.array_except("v_numbers", "q_numbers")) == 0).groupBy("query", "value_id", "count", "nq", "nv").agg(F.count_distinct("s").alias("m"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    adj = F.when(F.col("hi") - F.col("lo") + 1 <= F.col("m"), 1.0).otherwise(F.col("m") / (F.col("hi") - F.col("lo") + 1))
    rows = rows.withColumn("score", F.floor(50.0 * F.col("m") / F.col("nv") + 30.0 * F.least(F.col("m") / F.col("nq"), F.lit(1.0)) + 20.0 * adj).cast("long")).filter(F.col("score") >= least)
    w = Window.partitionBy("query").orderBy(F.desc("m"), F.desc("score"), F.desc("count"), "value_id")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("query", "value_id", "m", "score")


def resolve_duplicates(values: DataFrame, share: float = 0.7) -> DataFrame:
    """values (name, category, count): of a name in several categories the one with the largest count; a descendant of it
    with at least `share` of that count is taken instead."""
    w = Window.partitionBy("name").orderBy(F.desc("count"), "category")
    lead = values.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("name", F.col("category").alias("lead"), F.col("count").alias("lead_count"))
    rows = values.join(lead, "name").filter((F.col("category") == F.col("lead")) | (F.col("category").startswith(F.concat(F.col("lead"), F.lit("_"))) & (F.col("count") >= share * F.col("lead_count"))))
    deep = Window.partitionBy("name").orderBy(F.desc(F.length("category")), F.desc("count"), "category")
    return rows.withColumn("rn", F.row_number().over(deep)).filter("rn = 1").select("name", "category", "count")


def dominant_category(counts: DataFrame) -> DataFrame:
    """counts (query, category, name, depth, n): the category that a query's results lie in.

    From the largest category of the least depth, down to its largest child at each further depth (a child's key begins with its
    parent's and _), until there is none. Then a category elsewhere whose name holds more of the query's words takes over, if it
    has SEMANTIC_MIN_COUNT results or more and isn't above the one found. Ties go to the least key. share: of the siblings.
    """
    rows = counts.withColumn("level", F.dense_rank().over(Window.partitionBy("query").orderBy("depth")))
    words = lambda c: F.array_distinct(F.transform(plain_tokens(c), stem))
    rows = rows.withColumn("sem", F.size(F.array_intersect(words(F.col("query")), words(F.col("name")))))
    rows = stage(rows.withColumn("parent", F.when(F.col("category").contains("_"), F.regexp_replace("category", "_[^_]*$", "")).otherwise("")), "category-counts")
    pick = lambda df, order: df.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter("rn = 1")
    total = F.sum("n").over(Window.partitionBy("query")).alias("of")
    top = pick(rows.filter("level = 1").select("query", "category", "depth", "n", "sem", total), [F.desc("n"), "category"]).drop("rn").withColumn("open", F.lit(True))
    for level in range(2, MAX_DEPTH + 1):
        kids = rows.filter(F.col("level") == level).select("query", *(F.col(c).alias(f"k_{c}") for c in ("category", "depth", "n", "sem")))
        kids = kids.join(top.filter("open").select("query", "category"), "query").filter(F.startswith("k_category", F.concat("category", F.lit("_"))))
        kids = kids.withColumn("k_of", F.sum("k_n").over(Window.partitionBy("query"))).drop("category")
        top = top.join(pick(kids, [F.desc("k_n"), "k_category"]).drop("rn"), "query", "left")
        went = F.col("k_category").isNotNull()
        # A depth of the query at which the branch has no child ends it.
        ended = rows.filter(F.col("level") == level).select("query").distinct().withColumn("there", F.lit(True))
        top = top.join(ended, "query", "left")
        top = top.select("query", *(F.when(went, F.col(f"k_{c}")).otherwise(F.col(c)).alias(c) for c in ("category", "depth", "n", "sem", "of")), (F.col("open") & (went | F.col("there").isNull())).alias("open"))
    other = rows.select("query", *(F.col(c).alias(f"o_{c}") for c in ("category", "depth", "n", "sem", "parent"))).join(top.select("query", "category", "sem"), "query")
    other = other.filter((F.col("o_category") != F.col("category")) & ~F.startswith("category", F.concat("o_category", F.lit("_"))))
    other = pick(other, [F.desc("o_sem"), F.desc("o_n"), "o_category"]).filter((F.col("o_sem") > F.col("sem")) & (F.col("o_n") >= SEMANTIC_MIN_COUNT))
    sisters = rows.groupBy("query", F.col("depth").alias("o_depth"), F.col("parent").alias("o_parent")).agg(F.sum("n").alias("o_of"))
    other = other.join(sisters, ["query", "o_depth", "o_parent"]).select("query", "o_category", "o_depth", "o_n", "o_of", "o_sem")
    out = top.join(other, "query", "left")
    better = lambda c: F.coalesce(F.col(f"o_{c}"), F.col(c)).alias(c)
    out = out.select("query", better("category"), better("depth"), better("n"), better("of"), F.coalesce("o_sem", F.lit(0)).cast("int").alias("semantic"))
    return out.select("query", "category", "depth", F.col("n").alias("count"), (F.col("n") / F.col("of")).alias("share"), "semantic")


def overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that occur in b, where a stem, a prefix of four or more letters, or a compound part counts."""
    ta, tb = F.transform(plain_tokens(a), stem), F.transform(plain_tokens(b), stem)
    same = lambda x, y: (x == y) | ((F.length(x) >= 4) & y.contains(x)) | ((F.length(y) >= 4) & x.contains(y))
    hit = F.size(F.filter(ta, lambda x: F.exists(tb, lambda y: same(x, y))))
    return F.when(F.size(ta) > 0, hit / F.size(ta)).otherwise(0.0)


def heading_overlap(query: Column, heading: Column) -> Column:
    """F1 of token recall and precision, in percent."""
    r, p = overlap(query, heading), overlap(heading, query)
    return F.when(r + p > 0, F.bround(200.0 * r * p / (r + p))).otherwise(0.0).cast("int")


def lifted(score: Column, f1: Column) -> Column:
    """A full overlap lifts a score by 10, to 89 at most."""
    return F.when((f1 >= 100) & (score < 89), F.least(score + 10, F.lit(89))).otherwise(score)


def band(value: Column, bands) -> Column:
    out = F.when(value.isNull(), 0)
    for line, add in bands:
        out = out.when(value >= line, add)
    return out.otherwise(bands[-1][1])


def search_score(base: Column, coverage: Column, share: Column, count: Column, faceted: Column) -> Column:
    cov = band(coverage, COVERAGE_BANDS)
    cov = F.when((cov < 0) & ~faceted, cov - 8).otherwise(cov)
    dom = band(share, DOMINANCE_BANDS)
    thin = F.coalesce(count < DOMINANCE_MIN_COUNT, F.lit(False)) | F.coalesce(coverage < 60, F.lit(False))
    dom = F.when((dom > 0) & ~faceted & thin, 0).otherwise(dom)
    few = F.when(faceted, 0).otherwise(band(count, COUNT_BANDS))
    return F.greatest(F.lit(0), F.least(F.lit(100), (base + cov + dom + few).cast("int")))


def tier(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 50, "C").otherwise("D")


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def value_is_query(keyword: Column, value: Column) -> Column:
    """All words of the keyword are in the value, plurals aside, and the value has one more at most."""
    plain = lambda c: F.array_distinct(F.transform(_tokens(c), lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.regexp_replace(t, "s$", "")).otherwise(t)))
    k, v = plain(keyword), plain(value)
    return (F.size(k) > 0) & (F.size(v) > 0) & (F.size(F.array_except(k, v)) == 0) & (F.size(v) - F.size(k) <= 1)


def bridges(keyword: Column, value: Column) -> Column:
    """A word of the keyword and one of the value are equal, or share a stem of four letters or more; plural spellings
    (a last v or z for f or s, double vowels) count as one."""
    loose = lambda t: F.regexp_replace(F.regexp_replace(t, "s+$", ""), "e+$", "")
    cut = lambda t: F.regexp_replace(t, "^(.{3,}?)(?:eren|en|s)$", "$1")
    deep = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(cut(t), "v$", "f"), "z$", "s"), r"([aeou])\1+", "$1")
    forms = lambda ts: F.transform(ts, lambda t: F.struct(t.alias("t"), loose(t).alias("l"), deep(t).alias("d")))
    k, v = forms(F.filter(_tokens(keyword), lambda t: F.length(t) >= 3)), forms(_tokens(value))
    long = lambda c: F.length(c) >= 4
    same = lambda a, b: (
        (a["t"] == b["t"])
        | (long(a["l"]) & (b["t"].contains(a["l"]) | (long(b["t"]) & a["t"].contains(b["l"]))))
        | (long(a["t"]) & long(b["t"]) & (b["d"].contains(a["d"]) | a["d"].contains(b["d"])))
    )
    return F.exists(k, lambda a: F.exists(v, lambda b: same(a, b)))


def reject_reason(matched: Column, unmatched: Column, kind: Column) -> Column:
    """Why a match is worth nothing; null where it stands. Words are lower-cased; a null list is empty."""
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    have, lack = clean(matched), clean(unmatched)
    listed = lambda *lists: F.array(*(F.lit(w) for ws in lists for w in ws))
    only = lambda *lists: (F.size(have) > 0) & (F.size(F.array_except(have, listed(*lists))) == 0)
    every = (GENERIC_ADJECTIVES, GENERIC_NOUNS, GENERIC_FORMS)
    special = F.exists(F.array_except(lack, listed(*every)), lambda w: w.rlike(r"^\p{L}{4,}$"))
    return (
        F.when(only(GENERIC_ADJECTIVES), "generic adjectives only")
        .when((kind == "cross_category_type") & only(GENERIC_ADJECTIVES, GENERIC_NOUNS), "generic words across categories")
        .when(special & only(*every), "generic words only, special ones unmatched")
        .when(F.exists(lack, lambda w: F.length(w) >= LONG_TOKEN), "long word unmatched")
    )


def reliability(matches: DataFrame) -> DataFrame:
    """matches (keyword, value_names, kind, match_score, facet_count, cross, reason, coverage, h1, matched, unmatched) with
    reject, score (0 to 100) and tier.

    A match by the name of a sub-category is rated by its score and coverage; any other by 60 points of its score, bonuses for staying
    in the category and for exact matches, penalties for fallbacks, shop names, known bad pairs, coverage and unlike headings. Then
    rejects give 0, a dropped facet 25 at most, and a value that is the query 90 (a synonym 80) at least.
    """
    zero = lambda cond, n: F.when(cond, F.lit(float(n))).otherwise(0.0)
    rows = matches.withColumn("reject", reject_reason(F.col("matched"), F.col("unmatched"), F.col("kind")))
    low, values = F.lower(F.coalesce("keyword", F.lit(""))), F.lower(F.coalesce("value_names", F.lit("")))
    rows = rows.withColumns({
        "__generic": F.exists(F.array(*map(F.lit, GENERIC_VALUES)), lambda g: values.contains(g)),
        "__bad": F.least(F.lit(0.0), F.lit(0.0), *(zero(low.rlike(a) & values.rlike(b), n) for a, b, n in BAD_PAIRS)),
        "__bridged": (F.col("kind") != "facet_probe_fallback") | bridges(F.col("keyword"), F.col("value_names")),
        "__equal": value_is_query(F.col("keyword"), F.col("value_names")),
        "cross": F.coalesce("cross", F.lit(False)),
    })
    m, cov, kind, cross = F.col("match_score"), F.coalesce("coverage", F.lit(100.0)), F.col("kind"), F.col("cross")
    name = F.when(m == 100, 95.0).when(m >= 95, 75 + (m - 95) * 2.5).otherwise(50 + (m - 80) * 1.4)
    name = name - F.when(cov < 50, 30).when(cov < 75, 15).when(cov < 100, 5).otherwise(0)
    facet = m / 100 * 60 + zero(~cross, 20) + zero(m == 100, 10) + zero(kind == "category_fallback", -25) + zero(kind == "cross_category_type", -15) + zero(F.col("__generic"), -15)
    facet = facet + zero(F.col("__generic") & cross, -10) + F.col("__bad") + zero(cross & F.contains("reason", F.lit("[maincat]")), -10) + zero(cross & F.contains("reason", F.lit("[parent_subcat]")), -5)
    facet = facet + F.when(cov < 25, -35).when(cov < 50, -20).when(cov < 75, -10).otherwise(0)
    facet = facet + F.when(F.col("h1").isNull(), 0).when(F.col("h1") >= 85, 5).when(F.col("h1") >= 70, 0).when(F.col("h1") >= 50, -10).otherwise(-20)
    facet = F.when(kind == "duplicate_facet_dropped", F.least(facet, F.lit(25.0))).otherwise(facet)
    whole = (F.col("facet_count") <= 1) & (cov >= 100) & (F.coalesce(F.size("unmatched"), F.lit(0)) <= 0)
    floor = F.when(whole & F.col("__equal"), 90.0).when(whole & (kind == "synonym"), 80.0).otherwise(0.0)
    dead = (kind != "subcategory_name") & ((cross & (cov < 33)) | ~F.col("__bridged"))
    rows = rows.withColumn("__points", F.when(kind == "subcategory_name", name).otherwise(F.greatest(facet, floor)))
    score = F.when(F.col("reject").isNotNull() | dead, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.col("__points").cast("int"))))
    rows = rows.withColumn("score", score.cast("int")).withColumn("tier", tier(F.col("score")))
    return rows.drop("__generic", "__bad", "__bridged", "__equal", "__points")


def run_summary(scored: DataFrame, done: DataFrame) -> DataFrame:
    """Per tier: rows and share in percent, without what was processed before."""
    rows = scored.join(done.select("query"), "query", "left_anti")
    total = F.sum(F.count("*")).over(Window.partitionBy(F.lit(1)))
    return rows.groupBy("tier").agg(F.count("*").alias("n"), (F.count("*") * 100.0 / total).alias("pct"))


COLOURS = ["red", "blue", "green", "black", "white", "yellow", "small", "large"]


def colours(text: Column, listed=COLOURS) -> Column:
    """Listed colours of a text, in the list's order."""
    return F.array_intersect(F.array(*map(F.lit, listed)), plain_tokens(text))


def colour_combinations(queries: DataFrame, combos: DataFrame) -> DataFrame:
    """queries with two colours or more, joined to the combination value of exactly these."""
    rows = queries.withColumn("key", F.array_join(F.array_sort(colours(F.col("query"))), "+")).filter(F.col("key").contains("+"))
    return rows.join(combos, "key", "left")


def compound_parts(tokens: DataFrame, suffixes: DataFrame, least: int = 3) -> DataFrame:
    """tokens (token) split before their longest listed suffix: an equi-join on the tail of each length."""
    tails = tokens.select("token", F.explode(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length("token") - least))).alias("n")).filter(F.length("token") - F.col("n") >= least)
    rows = tails.withColumn("suffix", F.right("token", F.col("n"))).join(suffixes, "suffix")
    best = rows.groupBy("token").agg(F.max_by("suffix", "n").alias("suffix"))
    return best.withColumn("head", F.left("token", F.length("token") - F.length("suffix")))
