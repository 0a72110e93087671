"""Exact dedup by deterministic block naming (native: DataFrame functions only).

A text is cut into blocks of BLOCK characters. Blocks are sorted into buckets by the leading bits of their XXH64, and
equal blocks fall together before the shuffle; within a bucket the distinct blocks are sorted by content, and a block's
name is the integer (bucket, rank). Then adjacent names are named as pairs in the same way, level by level, until a
document has one name. Ranks keep different blocks apart even when their buckets agree, so the final identity
(number of blocks, name) never collides. A name depends on content alone: recomputed tasks give the same names.

Nearly all buckets hold one block, whose rank is 0. Only names of rank above 0 (`extra`) have to be looked up, so the
text itself is shuffled once, pre-aggregated; the lookup is a plain join, which Spark broadcasts by size.

Defined results: a null text counts as empty; all empty texts are one group. Null ids sort last. Of repeated rows (same
id, same text) one stays. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
#: 40 bits of bucket and 23 of rank make a name.
BUCKET_BITS = 40
RANK_BITS = 23


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; single spaces are left as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{common.SPACE}{{2,}}|[\x09-\x0D]", " ")


def _bucket(bits: int, *cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - bits)


def _extra(parts: DataFrame, name: str) -> DataFrame:
    """Of (bucket, part): the parts whose rank in their bucket is above 0, with their ranks."""
    found = parts.groupBy("bucket").agg(F.collect_set("part").alias("parts")).filter(F.size("parts") > 1)
    found = found.select("bucket", F.posexplode(F.array_sort("parts")).alias("rank", "part")).filter("rank > 0")
    return common.stage(found, name)


def _named(rows: DataFrame, parts: Column, extra: DataFrame, bits: int, part_bucket) -> DataFrame:
    """rows (uid, ...) with `names`: an integer for each part."""
    name = lambda bucket: F.shiftleft(bucket, RANK_BITS)
    if extra.isEmpty():
        return rows.withColumn("names", F.transform(parts, lambda p: name(part_bucket(p))))
    # Row ids are made once: both sides of the join below read them from the same written table.
    rows = common.stage(rows.withColumn("parts", parts), "numbered-rows")
    each = rows.select("uid", F.posexplode("parts").alias("at", "part")).withColumn("bucket", part_bucket(F.col("part")))
    each = each.join(extra, ["bucket", "part"], "left")
    each = each.withColumn("name", name(F.col("bucket")) + F.coalesce(F.col("rank"), F.lit(0)))
    each = each.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("at_names"))
    each = each.select("uid", F.col("at_names.name").alias("names"))
    none = F.lit(None).cast("array<bigint>")
    rows = rows.drop("names", "parts").join(each, "uid", "left")
    return rows.withColumn("names", F.coalesce("names", F.array().cast("array<bigint>"), none))


def identities(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, bits: int = BUCKET_BITS) -> DataFrame:
    """Per row: uid, key, text_sha256, n_blocks, identity; equal (n_blocks, identity) means equal normalised text."""
    source = docs.select(F.col(key), normalised(F.col(text)).alias("norm"))
    blocks = F.regexp_extract_all(F.col("norm"), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    block_bucket = lambda b: _bucket(bits, b)
    parts = source.select(F.explode(blocks).alias("part")).select(block_bucket(F.col("part")).alias("bucket"), "part")
    extra = _extra(parts, "block-names")
    rows = source.select(F.monotonically_increasing_id().alias("uid"), key, F.sha2(F.col("norm"), 256).alias("text_sha256"), blocks.alias("blocks"))
    rows = _named(rows, F.col("blocks"), extra, bits, block_bucket)
    rows = common.stage(rows.select("uid", key, "text_sha256", F.size("names").cast("long").alias("n_blocks"), "names"), "named-blocks")
    longest = rows.agg(F.max("n_blocks")).first()[0] or 0
    pair_bucket = lambda p: _bucket(bits, p["left"], p["right"])
    while longest > 1:
        at = lambda i: F.coalesce(F.get(F.col("names"), i), F.lit(-1).cast("long"))
        pairs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1), lambda i: F.struct(at(i * 2).alias("left"), at(i * 2 + 1).alias("right")))
        more = rows.filter(F.size("names") > 1)
        parts = more.select(F.explode(pairs).alias("part")).select(pair_bucket(F.col("part")).alias("bucket"), "part")
        extra = _extra(parts, "pair-names")
        rows = _named(more, pairs, extra, bits, pair_bucket).unionByName(rows.filter(F.size("names") <= 1))
        rows = common.stage(rows, "named-pairs")
        longest = (longest + 1) // 2
    return rows.select("uid", key, "text_sha256", "n_blocks", F.coalesce(F.get("names", F.lit(0)), F.lit(0)).alias("identity"))


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256."""
    rows = identities(docs, text, key, **how)
    ids = ["n_blocks", "identity"]
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("uid"))).alias("first")
    groups = rows.groupBy(*ids).agg(first, F.count("*").alias("group_size"))
    out = common.attach(rows, groups, ids, "group_size", rows.count())
    return out.select(key, F.col("first.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns; the decisions are joined back by id and content."""
    found = common.stage(exact_duplicates(docs), "exact-duplicates")
    mark = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))).alias("mark")
    seen = F.to_json(F.struct(F.col("doc_id").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("sha")))
    marks = found.groupBy(mark).agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))
    return common.one_of_each(docs, marks, seen, found.count())
