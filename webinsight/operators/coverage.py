"""Coverage-driven URL selection: features, knees, scores, caps, selection, evaluation, payloads."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webinsight.functions.norm import month_of, npath
from webinsight.operators.common import stage
from webinsight.operators.ranks import by_size, positions, tie_ranks

WEIGHT_VISITS, WEIGHT_REVENUE = 0.889, 0.111


def url_visits(visits: DataFrame) -> DataFrame:
    """Visits and revenue by normal path and category."""
    return visits.groupBy(npath(F.col("url")).alias("npath"), "deepest_cat", "main_cat").agg(F.count("*").alias("visits"), F.sum("revenue").cast("double").alias("revenue"))


def features(visits: DataFrame, recent: tuple[int, int], prior: tuple[int, int]) -> DataFrame:
    """One aggregation: counts, rates, and momentum ln((recent + 1) / (prior + 1))."""
    part = lambda p: F.count_if(F.col("date_key").between(*p))
    rows = visits.groupBy(npath(F.col("url")).alias("npath")).agg(F.count("*").alias("visits"), F.sum("clicks").alias("clicks"), F.count_if("noprod").alias("noprod"), F.sum("revenue").cast("double").alias("revenue"), part(recent).alias("visits_recent"), part(prior).alias("visits_prior"))
    return rows.select("npath", "visits", "revenue", (F.col("clicks") / F.col("visits")).alias("ctr"), (F.col("noprod") / F.col("visits")).alias("bounce_rate"), "visits_recent", "visits_prior", F.ln((F.col("visits_recent") + 1) / (F.col("visits_prior") + 1)).alias("momentum"))


def flag_members(visits: DataFrame, selected: DataFrame) -> DataFrame:
    """visits with in_set: left join to the distinct paths of a selection."""
    chosen = selected.select("npath").distinct().withColumn("__in", F.lit(True))
    return visits.withColumn("npath", npath(F.col("url"))).join(chosen, "npath", "left").withColumn("in_set", F.col("__in").isNotNull()).drop("__in")


def coverage_table(flagged: DataFrame, kind: Column) -> DataFrame:
    """By type, and __ALL__ (rollup): visits, of which in the set, in percent of visits and revenue."""
    rows = flagged.withColumn("type", kind).rollup("type").agg(F.count("*").alias("visits"), F.count_if("in_set").alias("visits_in"), F.sum("revenue").cast("double").alias("revenue"), F.coalesce(F.sum(F.when(F.col("in_set"), F.col("revenue"))), F.lit(0)).cast("double").alias("revenue_in"))
    return rows.withColumn("type", F.coalesce("type", F.lit("__ALL__"))).withColumn("coverage_pct", 100.0 * F.col("visits_in") / F.col("visits"))


def weighted_coverage(runs: DataFrame) -> DataFrame:
    """Of sums, not the mean of percentages."""
    return runs.agg((F.sum("visits_in") * 100.0 / F.nullif(F.sum("visits"), F.lit(0))).alias("coverage_pct"), F.count("*").alias("runs"))


def category_months(visits: DataFrame) -> DataFrame:
    return visits.groupBy("deepest_cat", month_of(F.col("date_key")).alias("month")).agg(F.count("*").alias("visits"), F.sum("revenue").cast("double").alias("revenue"))


def selection_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct paths of two selections: counts, both, either."""
    left, right = a.select("npath").distinct().withColumn("a", F.lit(1)), b.select("npath").distinct().withColumn("b", F.lit(1))
    both = left.join(right, "npath", "full")
    return both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count("*").alias("n_union"))


def knees(urls: DataFrame, key: str = "deepest_cat", shares: Sequence[int] = (80, 90, 95)) -> DataFrame:
    """Per category: the least rank by visits that reaches each share of its volume, its volume and its URLs."""
    order = [F.desc("visits"), F.col("npath")]

    def small(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        return rows.withColumns({"rn": F.row_number().over(w), "run": F.sum("visits").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("visits").over(Window.partitionBy(key))})

    def large(rows: DataFrame) -> DataFrame:
        placed = positions(rows, [key], order, "visits")
        return placed.select(*rows.columns, (F.col("pos") + 1).alias("rn"), "run", F.col("group_value").alias("total"))

    rows = by_size(urls.filter("visits > 0"), key, small, large)
    cut = [F.min(F.when(F.col("run") * 100 >= F.col("total") * p, F.col("rn"))).cast("long").alias(f"knee{p}") for p in shares]
    return rows.groupBy(key).agg(*cut, F.sum("visits").alias("yearly"), F.count("*").alias("urls"))


def blend_score(urls: DataFrame, key: str = "deepest_cat", wv: float = WEIGHT_VISITS, wr: float = WEIGHT_REVENUE) -> DataFrame:
    """wv * percent_rank of ln(1 + visits) + wr * percent_rank of ln(1 + revenue), within the category."""
    values = {"__v": F.log1p("visits"), "__r": F.log1p(F.greatest(F.col("revenue"), F.lit(0.0)))}
    score = lambda v, r: (F.lit(wv) * v + F.lit(wr) * r).alias("score")

    def small(rows: DataFrame) -> DataFrame:
        pr = lambda c: F.percent_rank().over(Window.partitionBy(key).orderBy(c))
        return rows.select(*urls.columns, score(pr(values["__v"]), pr(values["__r"])))

    def large(rows: DataFrame) -> DataFrame:
        named = rows.withColumns(values | {"__key": F.struct(key)})
        ranked = tie_ranks(tie_ranks(named, ["__key"], "__v", ("__vr", "__vt", "__vn")), ["__key"], "__r", ("__rr", "__rt", "__rn"))
        part = lambda rank, n: (F.col(rank) - 1) / (F.col(n) - 1)
        return ranked.select(*urls.columns, score(part("__vr", "__vn"), part("__rr", "__rn")))

    return by_size(urls, key, small, large)


def rank_pct(df: DataFrame, key: str, column: str) -> DataFrame:
    """Average-tie rank over the number of rows; 0.5 for nulls."""
    name = f"{column}_pct"
    filled = F.col(column).isNotNull()

    def small(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(key, F.col(column).isNull())
        rank = F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(key, column)) - 1) / 2
        return rows.withColumn(name, F.when(filled, rank / F.count("*").over(w)).otherwise(0.5))

    def large(rows: DataFrame) -> DataFrame:
        ranked = tie_ranks(rows.filter(filled).withColumn("__key", F.struct(key)), ["__key"], column, ("__rank", "__ties", "__n"))
        pct = ((F.col("__rank") + (F.col("__ties") - 1) / 2) / F.col("__n")).alias(name)
        return ranked.select(*df.columns, pct).unionByName(rows.filter(~filled).withColumn(name, F.lit(0.5)))

    return by_size(df, key, small, large)


def select_top(scored: DataFrame, key: str = "deepest_cat", caps: DataFrame | None = None, default: int = 300) -> DataFrame:
    """Rows by rank up to the category's cap. The largest cap bounds the ranking itself, so each task keeps as many rows a category at most
    before these meet."""
    most = default if caps is None else max(default, caps.agg(F.max("cap")).first()[0] or 0)
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("visits"), "npath")
    rows = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= int(most)).withColumn("rank", F.col("rank").cast("long"))
    if caps is None:
        return rows
    return rows.join(caps.select(key, "cap"), key, "left").filter(F.col("rank") <= F.coalesce("cap", F.lit(default))).drop("cap")


def main_cat_selection(urls: DataFrame, mapping: DataFrame, default: int = 100) -> DataFrame:
    """The same score and cap over the pool of the main category; rows without a mapping are left out."""
    mapped = urls.drop("main_cat").join(mapping.select("deepest_cat", "main_cat").distinct(), "deepest_cat")
    return select_top(blend_score(mapped, "main_cat"), "main_cat", default=default)


def seasonal_caps(knee: DataFrame, months: DataFrame, column: str = "knee90", cap_min: int = 5, cap_max: int = 400, alpha: float = 1.0, mult_min: float = 0.4, mult_max: float = 2.5) -> DataFrame:
    """Per category and calendar month: clamp(round(clamp(knee) * clamp(max(index of this and the next month) ^ alpha)))."""
    clim = months.groupBy("deepest_cat", (F.col("month") % 100).alias("m")).agg(F.avg("visits").alias("mean"))
    base = clim.groupBy("deepest_cat").agg(F.avg("mean").alias("level"))
    index = clim.join(base, "deepest_cat").select("deepest_cat", "m", F.when(F.col("level") > 0, F.col("mean") / F.col("level")).otherwise(1.0).alias("idx"))
    grid = knee.filter(F.col(column).isNotNull()).withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long")))).withColumn("next", F.col("m") % 12 + 1)
    grid = grid.join(index, ["deepest_cat", "m"], "left").join(index.select("deepest_cat", F.col("m").alias("next"), F.col("idx").alias("idx_next")), ["deepest_cat", "next"], "left")
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    top = F.greatest(F.coalesce("idx", F.lit(1.0)), F.coalesce("idx_next", F.lit(1.0)))
    base_cap = clamp(F.col(column), cap_min, cap_max)
    size = F.round(base_cap * clamp(F.pow(top, F.lit(alpha)), mult_min, mult_max), 9)  # halves stay halves
    cap = clamp(F.bround(size).cast("long"), cap_min, cap_max)
    return grid.select("deepest_cat", F.col("m").alias("month"), base_cap.cast("long").alias("base"), cap.cast("long").alias("cap"), "yearly")


def size_caps(selected: DataFrame, key: str, factor: float, lo: int, hi: int) -> DataFrame:
    """Caps as a multiple of the live set's size."""
    n = selected.groupBy(key).agg(F.count_distinct("npath").alias("live"))
    return n.withColumn("cap", F.greatest(F.lit(lo), F.least(F.lit(hi), F.ceil(F.col("live") * factor))).cast("long"))


def new_values(loads: DataFrame, as_of_day: int, days: int) -> DataFrame:
    """Values whose first and last load are both within `days` of as_of."""
    return loads.groupBy("value").agg(F.min("day").alias("first"), F.max("day").alias("last")).filter((F.col("first") > as_of_day - days) & (F.col("last") > as_of_day - days))


def three_way(old: DataFrame, new: DataFrame, traffic: DataFrame) -> DataFrame:
    """Paths of either set or with traffic: kept, added, dropped or neither, with visits."""
    a, b = old.select("npath", F.lit(1).alias("o")).distinct(), new.select("npath", F.lit(1).alias("n")).distinct()
    rows = a.join(b, "npath", "full").join(traffic.groupBy("npath").agg(F.sum("visits").alias("visits")), "npath", "full")
    outcome = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), "kept").when(F.col("n").isNotNull(), "added").when(F.col("o").isNotNull(), "dropped").otherwise("neither")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("urls"), F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"))


def shadow_compare(visits: DataFrame, live: DataFrame, split: int, cap: int = 50) -> DataFrame:
    """Score on visits before `split`, select, and cover the visits from it on; the live set beside it."""
    past, future = visits.filter(F.col("date_key") < split), visits.filter(F.col("date_key") >= split)
    picked = select_top(blend_score(url_visits(past)), default=cap).select("npath").distinct().withColumn("new", F.lit(True))
    rows = future.withColumn("npath", npath(F.col("url"))).join(picked, "npath", "left").join(live.select("npath").distinct().withColumn("old", F.lit(True)), "npath", "left")
    new, old = F.col("new").isNotNull(), F.col("old").isNotNull()
    total = F.nullif(F.count("*"), F.lit(0))
    return rows.agg(F.count("*").alias("visits"), (F.count_if(new) * 100.0 / total).alias("new_pct"), (F.count_if(old) * 100.0 / total).alias("old_pct"), F.count_if(new & ~old).alias("add_visits"), F.count_if(old & ~new).alias("drop_visits"))


FEATURES = ("visits", "revenue", "ctr", "bounce_rate", "momentum")


def backtest(frame: DataFrame, targets: DataFrame, key: str, cap: int = 300, rounds: int = 2, steps: Sequence[float] = (0.0, 0.5, 1.0, 2.0, 4.0), names: Sequence[str] = FEATURES) -> tuple[dict[str, float], float]:
    """Coordinate ascent over feature weights: half visit and half revenue coverage of the top `cap` a category.

    The driver only decides; each coordinate's candidates are ranked in one job over the percentile frame.
    """
    for c in names:
        frame = rank_pct(frame, key, c)
    joined = frame.join(targets.select("npath", F.col("visits").alias("t_visits"), F.col("revenue").alias("t_revenue")), "npath", "left").na.fill(0, ["t_visits", "t_revenue"])
    joined = stage(joined.select(key, "npath", "t_visits", "t_revenue", *(f"{c}_pct" for c in names)), "backtest-frame")
    whole = joined.agg(*(F.sum(t).alias(t) for t in ("t_visits", "t_revenue"))).first()
    weights, best = {c: 1.0 for c in names}, -math.inf
    for _ in range(rounds):
        before = dict(weights)
        for c in names:
            trials = F.explode(F.array(*(F.lit(s) for s in steps)))
            fixed = sum((F.lit(weights[o]) * F.col(f"{o}_pct") for o in names if o != c), F.lit(0.0))
            rows = joined.withColumn("w", trials).select("w", key, "npath", "t_visits", "t_revenue", (fixed + F.col("w") * F.col(f"{c}_pct")).alias("s"))
            # Ranks beyond the cap are cut where rows are read, so few of a category meet.
            top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("w", key).orderBy(F.desc("s"), "npath"))).filter(F.col("rank") <= cap)
            got = top.groupBy("w").agg(*(F.sum(t).alias(t) for t in ("t_visits", "t_revenue"))).collect()  # a row a candidate
            share = lambda r, t: (r[t] or 0.0) / whole[t] if whole[t] else 0.0
            for r in sorted(got, key=lambda r: (abs(r["w"] - weights[c]), r["w"])):
                value = 0.5 * share(r, "t_visits") + 0.5 * share(r, "t_revenue")
                if value > best + 1e-12:
                    best, weights[c] = value, r["w"]
        if weights == before:
            break
    return weights, best


def coverage_curve(scored: DataFrame, targets: DataFrame, key: str, sizes: Sequence[int]) -> DataFrame:
    """Coverage by cap, from one ranking down to the largest cap; the total is summed beside it."""
    target = targets.select("npath", F.col("visits").alias("t"))
    scored = stage(scored, "scored")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("visits"), "npath"))
    rows = scored.withColumn("rank", rank).filter(F.col("rank") <= max(sizes)).join(target, "npath")
    total = scored.select("npath").join(target, "npath").agg(F.sum("t").alias("total"))
    sums = rows.agg(*(F.sum(F.when(F.col("rank") <= n, F.col("t"))).alias(f"s{n}") for n in sizes)).crossJoin(F.broadcast(total))
    out = sums.select(*((F.col(f"s{n}") * 100.0 / F.col("total")).alias(str(n)) for n in sizes))
    return out.unpivot([], [str(n) for n in sizes], "cap", "coverage_pct").withColumn("cap", F.col("cap").cast("long"))


def knee_guard(old: DataFrame, new: DataFrame, column: str = "knee90") -> DataFrame:
    """One row: exact medians and whether the new one is at least half of the old."""
    a, b = old.agg(F.percentile(column, F.lit(0.5)).alias("old")), new.agg(F.percentile(column, F.lit(0.5)).alias("new"))
    return a.crossJoin(F.broadcast(b)).withColumn("ok", F.col("new") * 2 >= F.col("old"))


def payload(selected: DataFrame, headings: DataFrame, max_length: int = 120) -> DataFrame:
    """Rows of a sitemap payload, or why they are skipped; ranks follow the largest given order."""
    rows = selected.join(headings, "npath", "left")
    reason = F.when(F.col("npath").contains("/p/"), "product_page").when(F.col("heading").isNull() | (F.col("heading") == ""), "no_heading").when(F.col("rank").isNull(), "no_rank").when(F.length("heading") > max_length, "too_long")
    return rows.withColumn("skip", reason)


def append_preserved(new: DataFrame, old: DataFrame, key: str = "deepest_cat") -> DataFrame:
    """new (key, npath, rank) with the paths that only old has, numbered on after the largest rank of their category."""
    lost = old.select(key, "npath", F.col("rank").alias("old_rank")).join(new.select(key, "npath"), [key, "npath"], "left_anti")
    top = new.groupBy(key).agg(F.max("rank").alias("top"))
    more = F.row_number().over(Window.partitionBy(key).orderBy("old_rank", "npath"))
    kept = lost.join(top, key, "left").select(key, "npath", (F.coalesce("top", F.lit(0)) + more).cast("long").alias("rank"))
    return new.select(key, "npath", "rank").unionByName(kept)


def payload_issues(rows: DataFrame, max_length: int = 120) -> DataFrame:
    """(npath, code) for each rule that a payload row breaks."""
    n = F.count("*").over(Window.partitionBy("npath"))
    rules = [("empty_path", F.coalesce(F.col("npath"), F.lit("")) == ""), ("empty_heading", F.coalesce(F.col("heading"), F.lit("")) == ""), ("duplicate", F.col("n") > 1), ("product_page", F.col("npath").contains("/p/")), ("too_long", F.length("heading") > max_length)]
    found = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules)))
    return rows.withColumn("n", n).select("npath", F.explode(found).alias("code"))


def demand_spikes(visits: DataFrame, recent: tuple[int, int], prior: tuple[int, int], ratio: float = 3.0, least: int = 100) -> DataFrame:
    part = lambda p: F.count_if(F.col("date_key").between(*p))
    rows = visits.groupBy("deepest_cat").agg(part(recent).alias("recent"), part(prior).alias("prior"))
    return rows.filter((F.col("recent") >= least) & (F.col("recent") >= ratio * F.col("prior")))
