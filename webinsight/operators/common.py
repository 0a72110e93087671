"""Small helpers of the operators."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from webinsight.sources.work import work_path

#: Rows of a dimension that may be broadcast, and the share of rows from which a key counts as hot (so 1000 at most).
BROADCAST_ROWS = 1_000_000
HOT_SHARE = 0.001


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the work folder and read it back: computed once, however many readers it has."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As stage, with metrics over df that are gathered in the write itself: one pass."""
    seen = Observation()
    return stage(df.observe(seen, *(m.alias(k) for k, m in metrics.items())), name), seen.get


def look_up(rows: DataFrame, dim: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of a dimension with unique keys that is safe for hot keys. A dimension of `most` rows or fewer is broadcast.
    Else its rows for the hot keys are, and the other rows, none of which has a hot key or none at all, are shuffled."""
    if dim.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(dim), key, "left")
    known = rows.filter(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count("*").alias("__n"))
    counts = stage(counts, "key-counts")
    line = max(1.0, (counts.agg(F.sum("__n")).first()[0] or 0) * HOT_SHARE)
    keys = F.broadcast(counts.filter(F.col("__n") >= line).select(key))
    hot = known.join(keys, key, "left_semi").join(F.broadcast(dim.join(keys, key, "left_semi")), key, "left")
    rest = known.join(keys, key, "left_anti").join(dim, key, "left")
    return hot.unionByName(rest).unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of one group row (unique keys, `weight`: its number of rows) onto each of `total` rows, safe when one group holds most of
    them: groups of HOT_SHARE of the rows or more, 1000 at most, are broadcast; the shuffled rest has no hot key."""
    line = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(weight) >= line))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(weight) < line), keys))
