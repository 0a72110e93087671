"""Ranks in groups of any size: rows are dealt by ranges of (group, order), so a giant group is many partitions' work.

`in_order` writes the rows sorted, each with its partition and place. A group's part of one partition is a piece; pieces are few
(groups + partitions), and what comes before each is summed over them. Only (partition, group) is ever brought together again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, stage

#: Rows of a group that a window may sort in one task; larger groups are ranked in pieces.
GIANT = 500_000

PART, AT = "__part", "__at"


def in_order(rows: DataFrame, key: Sequence[str], order: Sequence[Column], name: str = "in-order") -> DataFrame:
    """rows sorted by ranges, with __part and __at, written. Order should be total: a retried task then gives the same places.

    Bounds are sampled from rows, so these should come from a written table or a cheap plan.
    """
    by = [*(F.col(k).asc_nulls_first() for k in key), *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stage(dealt.select("*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().alias(AT)), name)


def _pieces(ordered: DataFrame, key: Sequence[str], value: str | None) -> DataFrame:
    """(part, key): its first place, the rows and the value before it in its group, and the group's totals."""
    names = [f"__k{i}" for i in range(len(key))]
    total = F.sum(value) if value else F.count("*")
    rows = ordered.groupBy(PART, *(F.col(k).alias(n) for k, n in zip(key, names, strict=True))).agg(F.min(AT).alias("__start"), F.count("*").alias("__rows"), total.alias("__value"))
    before = Window.partitionBy(*names).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    new = {"rows_before": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "value_before": F.coalesce(F.sum("__value").over(before), F.lit(0)), "group_rows": F.sum("__rows").over(whole), "group_value": F.sum("__value").over(whole)}
    return rows.select(F.col(PART).alias("__p"), *names, "__start", *(v.alias(f"__{k}") for k, v in new.items()))


def positions(rows: DataFrame, key: Sequence[str], order: Sequence[Column], value: str | None = None, name: str = "in-order") -> DataFrame:
    """rows with pos (0 first) and group_rows in their group; with a value also run, its sum up to and with the row, and group_value."""
    ordered = in_order(rows, key, order, name)
    pieces = _pieces(ordered, key, value)
    same = [F.col(PART) == F.col("__p"), *(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key))]
    out = ordered.join(pieces, same)
    cols = [F.col(c) for c in rows.columns] + [(F.col(AT) - F.col("__start") + F.col("__rows_before")).alias("pos"), F.col("__group_rows").alias("group_rows")]
    if value:
        w = Window.partitionBy(PART, *key).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
        cols += [(F.sum(value).over(w) + F.col("__value_before")).alias("run"), F.col("__group_value").alias("group_value")]
    return out.select(*cols)


def tie_ranks(rows: DataFrame, key: Sequence[str], value: str, names: tuple[str, str, str] = ("rank", "ties", "group_rows")) -> DataFrame:
    """rows with the rank of a value in its group (the least place of its equals, 1 first), the number of its equals, and of all
    rows. Keys and values aren't null. Different values are ranked, with their counts, and looked up by rows."""
    values = stage(rows.groupBy(*key, value).agg(F.count("*").alias("__n")), "values")
    total = values.agg(F.sum("__n")).first()[0] or 0
    placed = positions(values, key, [F.col(value)], value="__n", name="values-in-order")
    rank, ties, size = names
    dim = placed.select(*key, value, (F.col("run") - F.col("__n") + 1).alias(rank), F.col("__n").alias(ties), F.col("group_value").alias(size))
    return attach(rows, stage(dim, "value-ranks"), [*key, value], ties, total)


def by_size(rows: DataFrame, key: str, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """small(rows of groups that one task can sort), and large(rows of giant groups) where there are such; both give the same columns."""
    rows = stage(rows, "rows-to-rank")
    sizes = rows.groupBy(F.col(key).alias("__g")).count()
    giants = stage(sizes.filter(F.col("count") > (GIANT if most is None else most)).select("__g"), "giant-groups")
    if giants.isEmpty():
        return small(rows)
    same = F.col(key).eqNullSafe(F.col("__g"))
    # A giant group has over `most` rows, so there are few.
    return small(rows.join(F.broadcast(giants), same, "left_anti")).unionByName(large(rows.join(F.broadcast(giants), same, "left_semi")))
