"""Visit and revenue reporting: channel and category aggregates, comparisons, distributions, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webinsight.functions.norm import date_key, key_to_date, month_of

#: Labels of clicks that don't count.
DEAD_LABELS = ("cpa_after_180_days", "rejected_click")


def live_rows(clicks: DataFrame) -> DataFrame:
    return clicks.filter((F.col("actual_ind") == 1) & (F.col("deleted_ind") == 0) & ~F.col("label").isin(*DEAD_LABELS))


def device_class(ua: Column) -> Column:
    """Tablet before mobile; absent agents are tested third."""
    low = F.lower(ua)
    any_of = lambda *xs: F.coalesce(reduce(lambda a, b: a | b, (low.contains(x) for x in xs)), F.lit(False))
    return F.when(any_of("ipad", "tablet"), "tablet").when(any_of("mobi", "iphone", "android"), "mobile").when(ua.isNull() | (ua == ""), "unknown").otherwise("desktop")


def landing_type(url: Column) -> Column:
    return F.when(url.contains("/r/"), "R-url").when(url.contains("/c/"), "C-url").when(url.contains("/p/"), "PLP").when(url.contains("/products/"), "Browse").otherwise("Other")


def url_terms(url: Column, contains=(), any_of=(), none_of=()) -> Column:
    """Literal substring conditions: all, at least one, none."""
    low = F.lower(url)
    out = reduce(lambda a, b: a & b, (low.contains(x.lower()) for x in contains), F.lit(True))
    if any_of:
        out = out & reduce(lambda a, b: a | b, (low.contains(x.lower()) for x in any_of))
    return reduce(lambda a, b: a & b, (~low.contains(x.lower()) for x in none_of), out)


def with_channel(visits: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join to the channel map, whose size Spark checks before it broadcasts."""
    return visits.join(channels, keys)


def money(c: str) -> Column:
    return F.sum(c).cast("double").alias(c)


def channel_daily(visits: DataFrame, clicks: DataFrame) -> DataFrame:
    """Visits and revenue come from two facts: each is summed, then they meet in a full outer join."""
    v = visits.groupBy("date_key", "channel").agg(F.count("*").alias("visits"), F.sum("clicks").alias("clicks"), F.count_if("noprod").alias("noprod"))
    r = live_rows(clicks).groupBy("date_key", "channel").agg(money("revenue"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("visits", "clicks", "noprod")]
    return v.join(r, ["date_key", "channel"], "full").select("date_key", "channel", *zero, F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def rates(df: DataFrame) -> DataFrame:
    """ctr and bounce in percent, revenue per visit; null without visits."""
    per = lambda num, scale: F.when(F.col("visits") > 0, F.col(num) * scale / F.col("visits"))
    return df.withColumns({"ctr": per("clicks", 100.0), "bounce": per("noprod", 100.0), "rpv": per("revenue", 1.0)})


def pct_delta(now: Column, before: Column) -> Column:
    return F.when(before.isNotNull() & (before != 0), (now - before) * 100.0 / before)


def two_point(daily: DataFrame, day: int, visit_lag: int = 7, revenue_lag: int = 1) -> DataFrame:
    """Per channel: visits on the day and visit_lag days before, revenue revenue_lag days back and 7 days before that."""
    at = lambda lag: date_key(F.date_sub(F.to_date(F.lit(str(day)), "yyyyMMdd"), lag))
    on = lambda lag, c: F.sum(F.when(F.col("date_key") == at(lag), F.col(c)))
    out = daily.groupBy("channel").agg(
        F.coalesce(on(0, "visits"), F.lit(0)).alias("visits"),
        F.coalesce(on(visit_lag, "visits"), F.lit(0)).alias("visits_before"),
        F.coalesce(on(revenue_lag, "revenue"), F.lit(0.0)).alias("revenue"),
        F.coalesce(on(revenue_lag + 7, "revenue"), F.lit(0.0)).alias("revenue_before"),
    )
    return out.withColumns({"visits_delta": F.col("visits") - F.col("visits_before"), "visits_pct": pct_delta(F.col("visits"), F.col("visits_before")), "revenue_pct": pct_delta(F.col("revenue"), F.col("revenue_before"))})


def category_measures(visits: DataFrame, clicks: DataFrame, level: str) -> DataFrame:
    """Visits and revenue of different facts by category; null-safe on the key."""
    v = visits.groupBy(level).agg(F.count("*").alias("visits")).withColumnRenamed(level, "vk")
    r = live_rows(clicks).groupBy(level).agg(money("revenue")).withColumnRenamed(level, "rk")
    out = v.join(r, F.col("vk").eqNullSafe(F.col("rk")), "full")
    return out.select(F.coalesce("vk", "rk").alias("category"), F.coalesce("visits", F.lit(0)).alias("visits"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def category_deltas(visits: DataFrame, level: str, now: tuple[int, int], before: tuple[int, int], n: int = 100, cats: DataFrame | None = None) -> DataFrame:
    """The n best and n worst categories by change in visits; the deepest level takes lowest categories only."""
    if level == "deepest_cat" and cats is not None:
        visits = visits.join(cats.filter("is_lowest").select("deepest_cat"), "deepest_cat", "left_semi")
    part = lambda p: F.count_if(F.col("date_key").between(*p))
    rows = visits.groupBy(F.col(level).alias("category")).agg(part(now).alias("now"), part(before).alias("before")).withColumn("delta", F.col("now") - F.col("before"))
    best = rows.orderBy(F.desc("delta"), "category").limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(rows.orderBy("delta", "category").limit(n).withColumn("side", F.lit("worst")))


def distribution(df: DataFrame, bucket: str, order: list[str], now: Column, before: Column) -> DataFrame:
    """Ordered buckets with share (1 decimal) and change of the bucket's own value; empty buckets are dropped, unlisted ones come last."""
    rows = df.groupBy(bucket).agg(F.count_if(now).alias("value"), F.count_if(before).alias("before")).filter("value > 0")
    total = F.sum("value").over(Window.partitionBy(F.lit(1)))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(bucket))
    return rows.select(bucket, "value", F.round(100.0 * F.col("value") / total, 1).alias("share"), pct_delta(F.col("value"), F.col("before")).alias("wow"), F.when(place > 0, place).otherwise(len(order) + 1).cast("long").alias("place"))


def standup_daily(visits: DataFrame) -> DataFrame:
    v = F.nullif(F.count("*"), F.lit(0))
    revenue = F.sum("revenue").cast("double")
    direct = F.sum(F.when(F.col("channel") != "5-LOW", F.col("revenue")).otherwise(0)).cast("double")
    return visits.groupBy("date_key").agg(F.count("*").alias("visits"), revenue.alias("total"), direct.alias("total_direct"), (revenue / v).alias("opb"), (F.count_if("noprod") / v).alias("bounce"), (F.sum("clicks") / v).alias("ctr"))


def period_comparison(visits: DataFrame, p1: tuple[int, int], p2: tuple[int, int]) -> DataFrame:
    part = lambda p, c: F.coalesce(F.sum(F.when(F.col("date_key").between(*p), F.col(c))), F.lit(0)).cast("double")
    rows = visits.groupBy("main_cat", "channel").agg(part(p1, "revenue").alias("p1"), part(p2, "revenue").alias("p2"))
    return rows.filter("p1 > 0 or p2 > 0").withColumn("delta", F.col("p2") - F.col("p1"))


def channel_trend(visits: DataFrame, last_month: int) -> DataFrame:
    rows = visits.withColumn("month", month_of(F.col("date_key"))).filter(F.col("month") <= last_month)
    return rows.groupBy("month", "channel").agg(F.count("*").alias("visits"), money("revenue"))


def weighted_position(df: DataFrame, keys: list[str], position: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(position) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("avg_position"), F.sum(weight).alias("impressions"))


def search_finder(visits: DataFrame, wanted: list[tuple[int, list[str]]], min_visits: int = 1, n: int = 20) -> DataFrame:
    """wanted: (row id, terms), a user's short list. For each row its own URLs that contain all terms, most visited first.

    Visits are summed first; the list is folded into one array expression, so no join is needed.
    """
    urls = visits.filter(F.col("url").contains("/r/")).groupBy("url").agg(F.count("*").alias("visits")).filter(F.col("visits") > min_visits)
    hits = [F.when(reduce(lambda a, b: a & b, (F.col("url").contains(x) for x in terms), F.lit(True)), F.lit(i)) for i, terms in wanted]
    rows = urls.withColumn("row_id", F.explode(F.array_compact(F.array(*hits))))
    w = Window.partitionBy("row_id").orderBy(F.desc("visits"), "url")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("row_id", "url", "visits", F.col("rn").cast("long").alias("rn"))


def search_stats(visits: DataFrame, exact: bool = True) -> DataFrame:
    rows = visits.filter(F.col("url").contains("/r/"))
    count = F.count_distinct("url") if exact else F.approx_count_distinct("url")
    return rows.agg(count.alias("urls"), F.count("*").alias("visits"))


def trailing_series(daily: DataFrame, day: int, days: int = 14) -> DataFrame:
    """A row for each channel and day of the window that ends on `day`, zeros where nothing happened."""
    end = F.to_date(F.lit(str(day)), "yyyyMMdd")
    spine = daily.select("channel").distinct().withColumn("d", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    spine = spine.select("channel", date_key(F.col("d")).alias("date_key"))
    return spine.join(daily, ["channel", "date_key"], "left").select("channel", "date_key", F.coalesce("visits", F.lit(0)).alias("visits"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def label_windows(visits: DataFrame, as_of: int, level_days: int = 90, recent_days: int = 14) -> DataFrame:
    """Rows tagged level / recent / prior by distance to as_of, summed by window and channel."""
    gap = F.datediff(F.to_date(F.lit(str(as_of)), "yyyyMMdd"), key_to_date(F.col("date_key")))
    tags = F.array_compact(F.array(F.when(gap.between(0, level_days - 1), "level"), F.when(gap.between(0, recent_days - 1), "recent"), F.when(gap.between(recent_days, 2 * recent_days - 1), "prior")))
    return visits.withColumn("window", F.explode(tags)).groupBy("window", "channel").agg(F.count("*").alias("visits"))
