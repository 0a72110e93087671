"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v): each with m, the least of u and all its v. A node with very many edges is no hot key."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree"))
    out = common.attach(edges, least, ["u"], "degree", edges.count())
    return out.select("u", "v", F.least("u", "low").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (node, label): the least node that it reaches. Nodes without edges aren't returned."""
    now = common.stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = common.stage(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links-both")
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stage(large.filter("u <> v"), "large-star")
        small = _least(large)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = common.stage(small, "small-star")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    tops = now.select(F.col("v").alias("node")).distinct()
    return common.stage(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops.select("node", F.col("node").alias("label"))), "labels")
