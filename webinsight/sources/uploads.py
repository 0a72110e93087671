"""User uploads: all-text CSV with normalised names, and wide candidate sheets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tidy(df: DataFrame) -> DataFrame:
    """Names in [a-z0-9_], unnamed columns and rows without any value left out."""
    keep = [c for c in df.columns if not re.match(r"(?i)unnamed|_c\d+$", c)]
    names = [re.sub(r"[^a-z0-9_]", "_", c.strip().lower()) for c in keep]
    out = df.select(*(F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(keep, names, strict=True)))
    some = reduce(lambda a, b: a | b, (F.coalesce(F.trim(c), F.lit("")) != "" for c in names), F.lit(False))
    return out.filter(some)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    return tidy(spark.read.csv(path, header=True, inferSchema=False))


def candidates(df: DataFrame, cells: list[str], stated: str | None = None) -> DataFrame:
    """df with `ids`: the ids of all cells in order, once each (split at separators, quotes off, bare counters ignored), and
    a warning where their number differs from the stated one."""
    ids: Column = F.flatten(F.transform(F.array(*(F.coalesce(c, F.lit("")) for c in cells)), lambda x: F.split(F.replace(F.replace(x, F.lit('"'), F.lit("")), F.lit("'"), F.lit("")), r"[\s,;|]+")))
    ids = F.array_distinct(F.filter(ids, lambda x: (x != "") & ~x.rlike(r"^\d{1,3}$")))
    out = df.withColumn("ids", ids)
    if stated:
        out = out.withColumn("warning", F.when(F.col(stated).try_cast("int") != F.size("ids"), F.format_string("stated %s, found %d", F.col(stated).cast("string"), F.size("ids"))))
    return out
