"""Mixing sources to target weights by capped water-filling.

Sources are ranked by code point (null last) and weigh 5, 2, 1, repeating. They share `share` of all words by weight; a
source stops at `epochs` times its own words, and what it leaves is shared again by weight until none is above. With the
water level L, a target is min(L * weight, epochs * words); each round takes two sums over the source table and raises L,
until it stays.

Repetitions: a source's documents are each taken floor(target / words) times, and once more while the words of documents
before them, in an order by seeded hash, stay below the fractional remainder. The cut is found in steps: sums by the
hash's top 12 bits, by the next 12 within the bin of the cut and so on, until a bin has BIN_ROWS rows at most, whose documents are
ordered. So a source misses its target by half a document at most, and no document is taken
more than ceil(target / words) times. The same seed gives the same mix, at any partitioning.

Defined results: a null text has 0 words; a null source is one source, ranked last; sources without words get target 0.
Rows with the same id (null ids too) of one source are taken or left together. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
BIN_BITS = 12
#: Rows that one task orders to find a source's cut.
BIN_ROWS = 100_000
HASH_BITS = 60


def source_key(source: Column) -> Column:
    """A text that sorts as the source does, null after all others."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def order_hash(doc_id: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with `rank` from 0 by the unique column key: range partitions, and an offset for each."""
    df = common.stage(df.repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id()), "ranges")
    offsets, at = {}, 0
    for part, n in sorted(tuple(r) for r in df.groupBy("part").count().collect()):  # a row for each partition
        offsets[part], at = at, at + n
    start = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)) if offsets else F.create_map().cast("map<int,int>")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1 + start[F.col("part")]
    return df.withColumn("rank", rank.cast("long")).drop("part")


def water_level(sources: DataFrame, share: float, epochs: int) -> float:
    """sources: source_size, weight."""
    cap = epochs * F.col("source_size")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    room, level = share * total, share * total / weight
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        held, active = sources.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not active or (new := (room - held) / active) <= level:
            return level
        level = new


def source_rates(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes (key, size, u, doc_id), staged -> per key: n_docs, source_size, target, whole, cut_u, cut_id."""
    sources = ranked(sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "key")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = common.stage(sources.withColumn("weight", pick.cast("long")), "sources")
    level = water_level(sources, share, epochs)
    target = F.least(F.lit(level) * F.col("weight"), (epochs * F.col("source_size")).cast("double"))
    sources = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = common.stage(sources, "source-targets")

    # The bin of the hash in which a source's cut lies: by BIN_BITS of it, then by as many more within that bin, until few rows are left.
    shift, near, before = HASH_BITS - BIN_BITS, sizes.withColumn("parent", F.lit(0).cast("long")), None
    while True:
        bins = near.groupBy("key", "parent", F.shiftright("u", shift).alias("bin")).agg(F.sum("size").alias("in_bin"), F.count("*").alias("rows"))
        ahead = F.sum("in_bin").over(Window.partitionBy("key", "parent").orderBy("bin")) - F.col("in_bin")
        bins = bins.withColumn("ahead", ahead).join(sources.select("key", "goal"), "key") if before is None else bins.withColumn("ahead", ahead).join(before, ["key", "parent"]).withColumn("ahead", F.col("ahead") + F.col("before"))
        bins = bins.filter((F.col("ahead") < F.col("goal")) & (F.col("ahead") + F.col("in_bin") >= F.col("goal")))
        bins = common.stage(bins.select("key", "bin", "goal", F.col("ahead").alias("before"), "rows"), "cut-bins")
        near = sizes.withColumn("bin", F.shiftright("u", shift)).join(bins.drop("rows"), ["key", "bin"])
        if shift < BIN_BITS or (bins.agg(F.max("rows")).first()[0] or 0) <= BIN_ROWS:
            break
        before = bins.select("key", F.col("bin").alias("parent"), "goal", "before")
        near = common.stage(near.select("key", "size", "u", "doc_id", F.col("bin").alias("parent")), "cut-rows")
        shift -= BIN_BITS
    near = near.groupBy("key", "u", "doc_id", "before", "goal").agg(F.sum("size").alias("s"))
    end = F.col("before") + F.sum("s").over(Window.partitionBy("key").orderBy("u", "doc_id"))
    near = near.withColumn("end", end).filter(2 * F.col("end") - F.col("s") <= 2 * F.col("goal"))
    cut = near.groupBy("key").agg(F.max(F.struct("u", F.col("doc_id").alias("id"))).alias("cut"))
    out = sources.join(bins.select("key", "bin"), "key", "left").join(cut, "key", "left")
    low = F.shiftleft(F.col("bin"), shift) - 1
    return out.select("key", "n_docs", "source_size", "target", "whole", F.coalesce(F.col("cut.u"), low, F.lit(-1)).alias("cut_u"), F.col("cut.id").alias("cut_id"))


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), source_key(F.col(source)).alias("key"), common.n_words(F.col(text)).alias("size"), order_hash(F.col(key), seed).alias("u"))


def times(u: str = "u", doc_id: str = "doc_id") -> Column:
    """How often a document is taken, of a row that has its source's rates."""
    before_cut = (F.col(u) < F.col("cut_u")) | ((F.col(u) == F.col("cut_u")) & (F.col(doc_id).isNull() | F.coalesce(F.col(doc_id) <= F.col("cut_id"), F.lit(False))))
    return F.col("whole") + before_cut.cast("long")


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sizes = common.stage(sized(docs, seed=seed), "sizes")
    rates = common.stage(source_rates(sizes, weights, share, epochs), "rates")
    out = common.attach(sizes, rates, ["key"], "n_docs", sizes.count())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def repeat_documents(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """docs as the mix takes them: each row as many times as it is repeated, all columns."""
    sizes = common.stage(sized(docs, seed=seed), "sizes")
    rates = common.stage(source_rates(sizes, weights, share, epochs), "rates")
    mine = F.struct(*(F.col(c) for c in docs.columns)).alias("__row")
    rows = docs.select(mine, source_key(F.col("source")).alias("key"), order_hash(F.col("doc_id"), seed).alias("u"), F.col("doc_id").alias("id"))
    out = common.attach(rows, rates, ["key"], "n_docs", sizes.count()).withColumn("times", times(doc_id="id").cast("int"))
    return out.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("__row.*")
