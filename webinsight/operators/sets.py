"""Set operations, joins by membership, top-k and write plans (upsert, insert-ignore, retention, diffs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webinsight.operators.common import stage


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def as_of(df: DataFrame, keys: list[str], time: str, at) -> DataFrame:
    """Per key the newest row whose time is not after `at`; of rows with one time, that with the largest other values, in column
    order (nulls least)."""
    rest = [c for c in df.columns if c not in keys and c != time]
    newest = F.max(F.struct(time, *rest)).alias("v")
    return df.filter(F.col(time) <= at).groupBy(*keys).agg(newest).select(*keys, "v.*").select(*df.columns)


def changed_flags(daily: DataFrame, key: str, day: str, flag: str) -> DataFrame:
    """Rows whose flag differs from the day before's (days that are missing don't count)."""
    w = Window.partitionBy(key).orderBy(day)
    rows = daily.withColumns({"__prev": F.lag(flag).over(w), "__day": F.lag(day).over(w)})
    return rows.filter((F.col("__day") == F.col(day) - 1) & (F.col("__prev") != F.col(flag))).select(key, day, F.when(F.col(flag) == 1, "on").otherwise("off").alias("change"))


def excluding(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed; nulls in the list are ignored."""
    return df.join(listed.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def content_gap(urls: DataFrame, texts: DataFrame, faqs: DataFrame, key: str = "url") -> DataFrame:
    """URLs with neither a text nor an FAQ."""
    return excluding(excluding(urls, texts, key), faqs, key)


def prefix_join(pending: DataFrame, prefixes: DataFrame, parts: int) -> DataFrame:
    """URL LIKE prefix || '%' for prefixes of `parts` path parts: an equi-join on the cut-out prefix."""
    cut = F.concat(F.substring_index("url", "/", parts + 1), F.lit("/"))
    return pending.withColumn("prefix", cut).join(prefixes, "prefix")


def last_run(df: DataFrame, key: str, time: str) -> DataFrame:
    return df.withColumn("__last", F.max(time).over(Window.partitionBy(key))).filter(F.col(time) == F.col("__last")).drop("__last")


def expand(keywords: DataFrame, forms: list[str], text: str = "keyword") -> DataFrame:
    """Every keyword before and after every form (a short list); a text that arises twice belongs to the least owner."""
    both = [c for f in forms for c in (F.concat_ws(" ", text, F.lit(f)), F.concat_ws(" ", F.lit(f), text))]
    rows = keywords.withColumn("combo", F.explode(F.array(*both)))
    return rows.groupBy("combo").agg(F.min(F.struct("owner", text)).alias("o")).select("combo", "o.owner", F.col(f"o.{text}").alias(text))


def scalar_row(*counts: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(F.broadcast(c))
    return out


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Spark prunes before the shuffle (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)


def top_union(urls: DataFrame, patterns: list[str], n: int) -> DataFrame:
    """Top n URLs of each pattern (a short list, folded into one array expression); of a URL in several, the largest count once."""
    hits = [F.when(F.col("url").contains(p), F.lit(p)) for p in patterns]
    rows = urls.withColumn("pattern", F.explode(F.array_compact(F.array(*hits))))
    return top_per_group(rows, ["pattern"], [F.desc("visits"), F.asc("url")], n).groupBy("url").agg(F.max("visits").alias("visits"))


def stratified(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 7) -> DataFrame:
    """n rows a stratum in the order of a seeded hash: the same rows at any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return top_per_group(df.withColumn("__h", digest), keys, [F.asc("__h"), F.asc(id_col)], n).drop("__h", "rank")


def flags_to_rows(df: DataFrame, ids: list[str], flags: list[str]) -> DataFrame:
    return df.unpivot(ids, flags, "flag", "value").filter("value = 1").drop("value")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """source's rows win; the rest of target stays. Of source rows with one key, the first in the given order wins; without an order,
    that with the least values, in column order (nulls first)."""
    order = order or tuple(F.col(c).asc_nulls_first() for c in source.columns if c not in keys)
    mine = latest_by(source, keys, *order) if order else source.dropDuplicates(keys)
    return mine.unionByName(target.join(source.select(*keys), keys, "left_anti"))


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """A target that can be changed in place: rows by hash of their key, a folder a bucket."""
    rows.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert_buckets(source: DataFrame, path: str, keys: list[str], *order: Column, buckets: int = 64) -> list[int]:
    """Upsert into such a target: only the buckets that source has keys of are read and rewritten. Returns them.

    Buckets are merged into a table of their own before they replace the old ones, so running it again after a failure gives the
    same target.
    """
    spark = source.sparkSession
    source = stage(source.withColumn("bucket", bucket_of(keys, buckets)), "upsert-source")
    touched = sorted(r[0] for r in source.select("bucket").distinct().collect())  # `buckets` at most
    if touched:
        target = spark.read.schema(source.schema).parquet(path).filter(F.col("bucket").isin(touched))
        merged = stage(upsert(target, source, keys, *order), "upsert-merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """target, and source's first row of each key that target lacks."""
    fresh = source.join(target.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(latest_by(fresh, keys, *order) if order else fresh.dropDuplicates(keys))


def retain(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last `days` days up to the newest. The bound is read first and becomes a literal, so that the filter reaches
    the scan and prunes its partitions."""
    newest = df.agg(F.max(day)).first()[0]
    return df if newest is None else df.filter(F.col(day) > F.lit(newest) - days)


def merge_plan(target: DataFrame, staged: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """insert / update / unchanged; the last staged row of a key wins."""
    last = latest_by(staged, [key], F.desc(order)).select(key, *values)
    old = target.select(key, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__there"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    action = F.when(F.col("__there").isNull(), "insert").when(same, "unchanged").otherwise("update")
    return last.join(old, key, "left").select(key, *values, action.alias("action"))


def three_sets(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Payload diff: counts of added, dropped, kept with the same value, kept with another."""
    a = old.select(key, F.col(value).alias("a"), F.lit(1).alias("o"))
    b = new.select(key, F.col(value).alias("b"), F.lit(1).alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "dropped").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, key, "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def submit_plan(candidates: DataFrame, sent: DataFrame, key: str, quota: int, batch: int) -> DataFrame:
    """What isn't sent yet, in order up to the quota, with batch numbers. The top `quota` rows are cut before they are numbered."""
    rows = candidates.join(sent.select(key), key, "left_anti").orderBy(key).limit(quota)
    rn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key))
    return rows.withColumn("rn", rn.cast("long")).withColumn("batch", F.ceil(F.col("rn") / batch).cast("long"))


def recovered(recorded: DataFrame, active: DataFrame, key: str, healthy: DataFrame) -> DataFrame:
    """Recorded exclusions that are no longer active; nothing when the (one-row) health test fails."""
    return recorded.join(active.select(key), key, "left_anti").join(F.broadcast(healthy.filter("healthy")), F.lit(True), "left_semi")


def catalog_union(sources: list[DataFrame], url: str = "url", own_hosts: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct canonical URLs over all sources; distinct runs once, after the union."""
    from webinsight.functions.norm import canonical_url

    out = sources[0].select(url)
    for s in sources[1:]:
        out = out.unionByName(s.select(url))
    return out.select(canonical_url(F.col(url), own_hosts).alias("url")).filter(F.col("url").isNotNull()).distinct()


def status_backfill(old: DataFrame, catalog: DataFrame) -> DataFrame:
    """Job status by catalog id: failed on an error, done when processed, else pending; the first row of an id wins."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("processed"), "done").otherwise("pending")
    rows = old.join(catalog, "url").withColumn("status", status)
    return latest_by(rows, ["url_id"], F.asc("seq")).select("url_id", "status")


def import_missing(upload: DataFrame, have: DataFrame) -> DataFrame:
    """Canonical URL and text of upload rows; the last row of a URL wins; ids that have content are left out."""
    from webinsight.functions.norm import canonical_url

    rows = upload.withColumn("url", canonical_url(F.col("url"), None)).filter(F.col("url").isNotNull() & (F.trim("content") != ""))
    return latest_by(rows, ["url"], F.desc("seq")).join(have.select("url"), "url", "left_anti")


def combined_export(urls: DataFrame, texts: DataFrame, faqs: DataFrame) -> DataFrame:
    """URLs with a text or an FAQ, control characters taken out."""
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    rows = urls.join(texts, "url", "left").join(faqs, "url", "left")
    return rows.filter(F.col("text").isNotNull() | F.col("faq").isNotNull()).select("url", clean(F.col("text")).alias("text"), clean(F.col("faq")).alias("faq"))
