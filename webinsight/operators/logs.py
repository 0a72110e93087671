"""Crawler-log analytics: classification columns, cube, URL facts, reports and verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webinsight.functions.addresses import address_key, cell, network
from webinsight.operators.common import look_up, stage

#: Buckets of URL types in display order.
BUCKETS = [("R-url", ["search"]), ("C-url", ["category_facet"]), ("PLP", ["product", "product_legacy"]), ("Cat-url", ["category", "category_legacy"]), ("Homepage", ["home"]), ("Other", ["list", "sitemap", "robots", "info", "other"])]
CATALOG_TYPES = ("category_facet", "category", "category_legacy")
PRODUCT_TYPES = ("product", "product_legacy")
#: The operator whose published ranges verify a family.
OPERATORS = {"Googlebot": "google", "OpenAI": "openai", "Bing": "bing"}
CUBE_KEYS = ["log_date", "host", "bot_family", "url_type", "facet_depth", "is_known_url", "status_class", "edge_result", "verify_state"]


def url_type(path: Column) -> Column:
    """Path prefixes. /r/ anywhere comes first."""
    return (
        F.when(path.contains("/r/"), "search")
        .when(path.startswith("/p/"), "product")
        .when(path.startswith("/products/") & path.contains("/c/"), "category_facet")
        .when(path.startswith("/products/"), "category")
        .when(path.startswith("/categories/"), "category_legacy")
        .when(path.startswith("/sitemap"), "sitemap")
        .when(path == "/", "home")
        .when(path.startswith("/robots.txt"), "robots")
        .when(path.startswith("/info/") | path.startswith("/service"), "info")
        .when(path.startswith("/l/"), "list")
        .when(path.rlike(r"^/[a-z0-9_-]+/d\d{6,}/"), "product_legacy")
        .otherwise("other")
    )


def url_type_bucket(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for name, raws in BUCKETS for raw in raws for x in (raw, name)))[kind], F.lit("Other"))


def bucket_order(bucket: Column) -> Column:
    return F.array_position(F.array(*(F.lit(n) for n, _ in BUCKETS)), bucket)


def facet_depth(path: Column) -> Column:
    """Facet values behind the first /c/."""
    at = F.instr(path, "/c/")
    tail = F.trim(F.substring(path, at + 3, F.length(path)), F.lit("/"))
    marks = (F.length(tail) - F.length(F.replace(tail, F.lit("~~"), F.lit("")))) / 2 + 1
    return F.when((at > 0) & (tail != ""), marks.cast("int")).otherwise(0)


def norm_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(host, F.lit("-"))), r"^www\.", "")


def keep_host(host: Column, domains: tuple[str, ...]) -> Column:
    """A listed domain or a sub-domain of one."""
    return reduce(lambda a, b: a | b, ((host == d) | host.endswith("." + d) for d in domains))


def status_class(status: Column) -> Column:
    return F.when(status.rlike("^[0-9]"), F.concat(F.substring(status, 1, 1), F.lit("xx"))).otherwise("?")


def lenient_bytes(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0)).cast("long")


def lenient_ms(c: Column) -> Column:
    """Milliseconds of decimal seconds, cut."""
    return F.coalesce((c.try_cast("decimal(18,6)") * 1000).cast("long"), F.lit(0)).cast("long")


def parse_hits(hits: DataFrame, domains: tuple[str, ...] = ("shop.example",)) -> DataFrame:
    """Raw log rows -> classified rows of the kept domains (agents are looked up, the rest is in place; the path is decoded
    in a step of its own, so that what reads it doesn't repeat that)."""
    from webinsight.functions.agents import classify_agents
    from webinsight.functions.norm import log_stem

    rows = hits.withColumn("host", norm_host(F.col("host"))).filter(keep_host(F.col("host"), domains))
    rows = classify_agents(rows).filter(F.col("bot_family").isNotNull())
    rows = rows.withColumn("path", log_stem(F.col("path")))
    path = F.col("path")
    return rows.withColumns({"url_type": url_type(path), "facet_depth": facet_depth(path), "status_class": status_class(F.col("status")), "bytes": lenient_bytes(F.col("bytes")), "time_ms": lenient_ms(F.col("time_taken"))})


def known_urls(catalog: DataFrame) -> DataFrame:
    """(url, url_id), one row a URL: literal spellings win over decoded aliases, and of equal ones the largest id."""
    from webinsight.functions.norm import percent_decode, strip_trailing

    literal = catalog.select(strip_trailing(F.col("url")).alias("url"), "url_id").withColumn("url", F.when(F.col("url") == "", "/").otherwise(F.col("url")))
    literal = literal.groupBy("url").agg(F.max("url_id").alias("url_id"))
    alias = literal.select(percent_decode(F.col("url")).alias("url"), "url_id").groupBy("url").agg(F.max("url_id").alias("url_id"))
    return literal.unionByName(alias.join(literal, "url", "left_anti"))


def with_membership(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    known = known_urls(catalog).withColumnRenamed("url", "path")
    return look_up(hits, known, "path").withColumn("is_known_url", F.col("url_id").isNotNull())


def network_cells(ranges: DataFrame) -> DataFrame:
    """ranges (operator, cidr) -> (operator, version, prefix, cell), once each; texts that aren't networks are left out."""
    rows = ranges.select("operator", network(F.col("cidr")).alias("n")).filter(F.col("n").isNotNull())
    return rows.select("operator", F.substring("n.key", 1, 1).alias("version"), "n.prefix", cell(F.col("n.key"), F.col("n.prefix")).alias("cell")).distinct()


def verify_ips(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """hits (bot_family, ip: address text of either version) with verify_state, by ranges (operator, cidr: network text).

    An address is in a network if its first bits are the network's, so the interval join is an equi-join on (operator, version,
    prefix, bits): each different address has a cell for every prefix length in use (162 at most). Different pairs of operator
    and address are tested, not hits, and the verdicts are looked up by hits in a way that is safe for a crawler's few addresses.
    """
    ops = F.create_map(*(F.lit(x) for kv in OPERATORS.items() for x in kv))
    hits = hits.withColumn("__op", ops[F.col("bot_family")])
    cells = stage(network_cells(ranges.filter(F.col("operator").isin(*OPERATORS.values()))), "network-cells")
    lengths = sorted((r["version"], r["prefix"]) for r in cells.select("version", "prefix").distinct().collect())
    listed = [r[0] for r in ranges.filter(F.col("operator").isin(*OPERATORS.values())).select("operator").distinct().collect()]
    address = F.when(F.col("__op").isNotNull() & F.col("ip").isNotNull(), F.concat_ws(" ", "__op", "ip"))
    pairs = hits.select("__op", "ip", address.alias("__address")).filter(F.col("__op").isin(*listed) & F.col("__address").isNotNull()).distinct()
    pairs = stage(pairs.withColumn("key", address_key(F.col("ip"))), "addresses").filter(F.col("key").isNotNull())
    used = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(p).alias("p")) for v, p in lengths)) if lengths else F.array().cast("array<struct<v:string,p:int>>")
    mine = F.filter(used, lambda x: x["v"] == F.substring("key", 1, 1))
    each = pairs.select("__address", F.explode_outer(F.transform(mine, lambda x: F.concat_ws(" ", F.col("__op"), cell(F.col("key"), x["p"])))).alias("cell"))
    known = cells.select(F.concat_ws(" ", "operator", "cell").alias("cell"), F.lit(True).alias("inside"))
    tested = look_up(each, known, "cell").groupBy("__address").agg(F.coalesce(F.bool_or("inside"), F.lit(False)).alias("__inside"))
    out = look_up(hits.withColumn("__address", address), stage(tested, "address-verdicts"), "__address")
    state = F.when(F.col("__op").isNull(), "unverifiable").when(F.col("__inside").isNull(), "unchecked").when(F.col("__inside"), "verified").otherwise("failed")
    return out.select(*hits.drop("__op").columns, state.alias("verify_state"))


def build_cube(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*CUBE_KEYS).agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"), F.sum("time_ms").alias("sum_time_ms"))


def build_url_daily(hits: DataFrame, tracked: tuple[str, ...] = ("ai", "search")) -> DataFrame:
    rows = hits.filter(F.col("is_known_url") & F.col("bot_class").isin(*tracked))
    by = [F.count_if(F.col("status_class") == f"{n}xx").alias(f"n_{n}xx") for n in (2, 3, 4, 5)]
    return rows.groupBy("log_date", "url_id", "host", "bot_family").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"), *by)


def build_unknown_top(hits: DataFrame, n: int = 500, tracked: tuple[str, ...] = ("ai", "search")) -> DataFrame:
    rows = hits.filter(~F.col("is_known_url") & F.col("bot_class").isin(*tracked) & ~F.col("url_type").isin(*PRODUCT_TYPES))
    counts = rows.groupBy("log_date", "host", "bot_family", "path").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("log_date", "bot_family").orderBy(F.desc("hits"), F.desc("host"), F.desc("path"))
    return counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def filters(host=None, bot_class=None, bot_family=None, kind=None, known=None) -> Column:
    """Conjunction of the filters that are given; several values as a comma-separated text."""
    out = F.lit(True)
    for name, value in (("host", host), ("bot_class", bot_class), ("bot_family", bot_family)):
        if value:
            out = out & F.col(name).isin([v.strip() for v in value.split(",") if v.strip()])
    if kind:
        raw = dict(BUCKETS)
        out = out & F.col("url_type").isin([t for v in kind.split(",") if v.strip() for t in raw.get(v.strip(), [v.strip()])])
    if known:
        out = out & (F.col("is_known_url") if known == "known" else ~F.col("is_known_url"))
    return out


def search_terms(path: Column, text: str, most: int = 6) -> Column:
    """All of the first `most` terms occur in the path, case folded."""
    return reduce(lambda a, b: a & b, (F.lower(path).contains(t) for t in text.lower().split()[:most]), F.lit(True))


def daily_series(cube: DataFrame, dimension: str = "bot_class") -> DataFrame:
    """Hits by day and a listed dimension; an unknown name means the class."""
    dims = {"bot_class": F.col("bot_class"), "bot_family": F.col("bot_family"), "url_type": url_type_bucket(F.col("url_type")), "status": F.col("status_class"), "host": F.col("host"), "verify": F.col("verify_state")}
    return cube.groupBy("log_date", dims.get(dimension, dims["bot_class"]).alias("series")).agg(F.sum("hits").alias("hits"))


def family_summary(cube: DataFrame) -> DataFrame:
    part = lambda cond, name: F.sum(F.when(cond, F.col("hits"))).alias(name)
    by = [part(F.col("status_class") == f"{n}xx", f"hits_{n}xx") for n in (2, 3, 4, 5)]
    return cube.groupBy("bot_family").agg(F.sum("hits").alias("hits"), F.sum("bytes").alias("bytes"), part(F.col("is_known_url"), "hits_known"), *by, part(F.col("edge_result").ilike("hit%"), "cache_hits"), F.count_distinct("log_date").alias("days"))


def crawl_waste(cube: DataFrame, filtered_on_known: bool = False) -> DataFrame:
    """Share of catalog crawling on URLs that aren't in the catalog, percent; null when the filter decides it, 0 when empty."""
    catalog = F.col("url_type").isin(*CATALOG_TYPES)
    sums = cube.agg(F.sum(F.when(catalog, F.col("hits"))).alias("total"), F.sum(F.when(catalog & F.col("is_known_url"), F.col("hits"))).alias("known"))
    waste = F.when(F.coalesce("total", F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round((1 - F.coalesce("known", F.lit(0)) / F.col("total")) * 100, 1))
    return sums.select(F.coalesce("total", F.lit(0)).alias("catalog_hits"), F.coalesce("known", F.lit(0)).alias("catalog_known"), (F.lit(None).cast("double") if filtered_on_known else waste).alias("waste_pct"))


def split_by(cube: DataFrame, column: str) -> DataFrame:
    if column == "facet_depth":
        cube = cube.filter(F.col("url_type").isin(*CATALOG_TYPES))
    return cube.groupBy(column).agg(F.sum("hits").alias("hits"), F.sum(F.when(F.col("is_known_url"), F.col("hits"))).alias("hits_known"))


def top_urls(url_daily: DataFrame, unknown: DataFrame, catalog: DataFrame, n: int = 50) -> DataFrame:
    """Known and unknown URLs in one ranking. The texts of known URLs are joined after their counts are summed."""
    known = url_daily.groupBy("url_id").agg(F.sum("hits").alias("hits")).join(known_urls(catalog).groupBy("url_id").agg(F.min("url").alias("url")), "url_id")
    rows = known.select("url", "hits", F.lit(True).alias("is_known")).unionByName(unknown.groupBy(F.col("path").alias("url")).agg(F.sum("hits").alias("hits")).withColumn("is_known", F.lit(False)))
    return rows.orderBy(F.desc("hits"), "url", "is_known").limit(n)


def url_detail(url_daily: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the URLs in ids (semi-join): hits by family, by day, and in total, in one pass of grouping sets; status counts with the rest."""
    rows = url_daily.join(ids.select("url_id"), "url_id", "left_semi")
    total = rows.groupingSets([["bot_family"], ["log_date"], []], "bot_family", "log_date").agg(
        F.sum("hits").alias("hits"),
        F.sum("n_2xx").alias("n_2xx"),
        F.sum(F.col("hits") - F.col("n_2xx") - F.col("n_3xx") - F.col("n_4xx") - F.col("n_5xx")).alias("n_other"),
        F.count_distinct("log_date").alias("days_seen"),
        F.grouping_id().cast("long").alias("level"),
    )
    return total


def ledger_complete() -> Column:
    return (F.col("hours_present") == 24) & (F.col("failed_files") == 0) & (F.col("files") >= F.col("expected_files"))


def coverage(cube: DataFrame, ledger: DataFrame) -> DataFrame:
    """First and last day of the cube beside the ledger's sums: two one-row aggregates."""
    days = cube.agg(F.min("log_date").alias("first_day"), F.max("log_date").alias("last_day"))
    books = ledger.agg(F.count("*").alias("days"), F.count_if(~ledger_complete()).alias("partial_days"), F.sum("raw_lines").alias("raw_lines"), F.sum("bot_lines").alias("bot_lines"))
    return days.crossJoin(F.broadcast(books))
