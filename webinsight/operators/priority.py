"""Facet priority: attribution of URL traffic to facets, shares within the category, and the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webinsight.functions.norm import facet_pairs, leaf_slug
from webinsight.operators.common import stage

#: Thresholds of the decision.
DEFAULTS = {"on_min_visits_pct": 10.0, "on_min_revenue_pct": 10.0, "on_min_abs_visits": 50, "off_max_visits_pct": 2.0, "off_max_revenue_pct": 2.0}


def parse_urls(urls: DataFrame) -> DataFrame:
    """url, ... -> deepest slug and facets of those that have both."""
    pairs = facet_pairs(F.col("url"))
    return urls.withColumn("cat_slug", leaf_slug(F.col("url"))).withColumn("facets", pairs).filter((F.col("cat_slug") != "") & (F.size("facets") > 0))


def url_totals(visits: DataFrame) -> DataFrame:
    return visits.groupBy("main_cat", "url").agg(F.count("*").alias("visits"), F.sum("revenue").alias("revenue"))


def attribute(parsed: DataFrame) -> DataFrame:
    """Each distinct facet of a URL gets the URL's full visits and revenue; the example is the least URL."""
    rows = parsed.withColumn("slug", F.explode(F.array_distinct(F.transform("facets", lambda p: p["slug"]))))
    return rows.groupBy("cat_slug", "slug").agg(F.sum("visits").alias("visits"), F.sum("revenue").cast("double").alias("revenue"), F.count("*").alias("url_count"), F.min("url").alias("example"))


def denominators(parsed: DataFrame) -> DataFrame:
    """Category totals, each URL once."""
    return parsed.groupBy("cat_slug").agg(F.sum("visits").alias("cat_visits"), F.sum("revenue").cast("double").alias("cat_revenue"), F.count("*").alias("cat_urls"))


def shares(facets: DataFrame, totals: DataFrame) -> DataFrame:
    pct = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100.0).otherwise(0.0)
    return facets.join(totals, "cat_slug").withColumns({"pct_visits": pct("visits", "cat_visits"), "pct_revenue": pct("revenue", "cat_revenue")})


def decide(rows: DataFrame, cats: DataFrame, settings: DataFrame, t: dict = DEFAULTS) -> DataFrame:
    """Settings are three-valued (on, off, inherit); unknown categories and unlinked facets keep what they have."""
    known = cats.select(F.col("deepest_cat").alias("cat_slug"), F.lit(True).alias("known_cat")).distinct()
    linked = settings.select(F.col("deepest_cat").alias("cat_slug"), "slug", "seo_prio", F.lit(True).alias("linked"))
    df = rows.join(known, "cat_slug", "left").join(linked, ["cat_slug", "slug"], "left")
    on = F.coalesce(F.col("seo_prio"), F.lit(False))
    up = (F.col("pct_visits") >= t["on_min_visits_pct"]) & (F.col("pct_revenue") >= t["on_min_revenue_pct"]) & (F.col("visits") >= t["on_min_abs_visits"])
    down = (F.col("pct_visits") < t["off_max_visits_pct"]) & (F.col("pct_revenue") < t["off_max_revenue_pct"])
    action = F.when(F.col("known_cat").isNull() | F.col("linked").isNull(), "keep").when(up & ~on, "turn_on").when(down & on, "turn_off").otherwise("keep")
    df = df.withColumn("action", action)
    reason = (
        F.when(F.col("known_cat").isNull(), F.format_string("no category for slug '%s'", "cat_slug"))
        .when(F.col("linked").isNull(), F.format_string("facet '%s' is not linked to the category", "slug"))
        .when(F.col("action") == "turn_on", F.format_string("%d visits across %d URLs, now %s", "visits", "url_count", F.when(F.col("seo_prio").isNull(), "inherit").otherwise("off")))
        .when(F.col("action") == "turn_off", F.format_string("only %d visits, now on", "visits"))
        .otherwise("no flip")
    )
    proposed = (
        F.when(F.col("known_cat").isNull() | F.col("linked").isNull(), "unknown")
        .when(F.col("action") == "turn_on", "1")
        .when(F.col("action") == "turn_off", "0")
        .when(on, "1")
        .when(F.col("seo_prio").isNull(), "inherit")
        .otherwise("0")
    )
    return df.select("cat_slug", "slug", "visits", "revenue", "url_count", "pct_visits", "pct_revenue", "action", proposed.alias("proposed"), reason.alias("reason"))


def priority_run(visits: DataFrame, cats: DataFrame, settings: DataFrame) -> DataFrame:
    parsed = stage(parse_urls(url_totals(visits)), "parsed-urls")  # each URL is parsed once, for both sums
    return decide(shares(attribute(parsed), denominators(parsed)), cats, settings)


def run_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count("*").alias("n"))
