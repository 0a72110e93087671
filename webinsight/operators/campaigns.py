"""Campaign and shop decisions: performance sums, budget and bid actions, plans, sessions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the budget action.
HARD_DROP, SOFT_DROP, FLOOR, LINKAGE, TRANSACTIONS, REV_CLICK, DELTA_UPPER, DELTA_LOWER = -25.0, -5.0, 0.0, 0.5, 7, 1.38, -15.0, -30.0


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def shop_performance(items: DataFrame, linked: Column) -> DataFrame:
    """Revenue, cost, margin, transactions, linkage (distinct linked items over distinct items), revenue per click; linked: whether
    a row's item is."""
    linked = F.count_distinct(F.when(linked, F.col("item_id")))
    rows = items.groupBy("shop_id").agg(F.sum("value").cast("double").alias("revenue"), F.sum("cost").cast("double").alias("cost"), F.count("*").alias("transactions"), linked.alias("n_linked"), F.count_distinct("item_id").alias("n_items"), F.sum("clicks").alias("clicks"))
    return rows.withColumns({"margin": F.col("revenue") - F.col("cost"), "linkage": F.col("n_linked") / F.col("n_items"), "rev_click": F.when(F.col("clicks") > 0, F.col("revenue") / F.col("clicks"))})


def pct_delta(new: Column, old: Column) -> Column:
    return F.when(new.isNotNull() & old.isNotNull() & (old != 0), (new - old) / old * 100)


def window_delta(items: DataFrame, recent: Column) -> DataFrame:
    """Revenue per click of the recent rows and of the others, and the change in percent."""
    half = lambda cond: F.sum(F.when(cond, F.col("value"))).cast("double") / F.sum(F.when(cond, F.col("clicks")))
    rows = items.groupBy("shop_id").agg(half(recent).alias("rev_click"), half(~recent).alias("rev_click_old"))
    return rows.withColumn("delta", pct_delta(F.col("rev_click"), F.col("rev_click_old")))


def budget_action(margin: Column, rev_click: Column, delta: Column, linkage: Column, transactions: Column) -> Column:
    """struct(action, reason); all comparisons are strict, so -25, [-5, 0] and 1.38 fall through as listed."""
    say = lambda a, r: F.struct(F.lit(a).cast("string").alias("action"), F.lit(r).cast("string").alias("reason"))
    link, tx = F.coalesce(linkage, F.lit(0.0)), F.coalesce(transactions, F.lit(0))
    strong = (link > LINKAGE) & (tx >= TRANSACTIONS)
    high = (
        F.when(delta.isNull(), say(None, "delta_unknown")).when(delta > DELTA_UPPER, say("raise-20", None)).when(delta < DELTA_LOWER, say("c-lower-20", None)).otherwise(say(None, "missed"))
    )
    positive = (
        F.when(strong & (rev_click > REV_CLICK), high)
        .when(strong & (rev_click < REV_CLICK), say("lower-20", None))
        .when(strong, say(None, "rev_click_unknown"))
        .when(tx < TRANSACTIONS, say(None, "low_transactions"))
        .when(link < LINKAGE, say(None, "low_linkage"))
        .otherwise(say(None, "no_action"))
    )
    return (
        F.when(margin.isNull(), say(None, "no_margin"))
        .when(margin < HARD_DROP, say("lower-25", None))
        .when((margin > HARD_DROP) & (margin < SOFT_DROP), say("lower-20", None))
        .when(margin > FLOOR, positive)
        .otherwise(say(None, "no_action"))
    )


def campaign_gate(action: Column, margin: Column, name: Column, constrained: Column) -> Column:
    """struct(apply, reason)."""
    say = lambda a, r: F.struct(F.lit(a).alias("apply"), F.lit(r).cast("string").alias("reason"))
    lower = F.when(margin < 0, say(True, None)).otherwise(say(False, "campaign_margin_non_negative"))
    label_c = F.when(name.contains("[label:c]"), say(True, None)).otherwise(say(False, "not_label_c"))
    up = F.when((margin > 0) & (constrained == 1), say(True, None)).when(F.coalesce(constrained, F.lit(0)) != 1, say(False, "not_budget_constrained")).otherwise(say(False, "campaign_margin_not_positive"))
    return F.when(action.isin("lower-25", "lower-20"), lower).when(action == "c-lower-20", label_c).when(action == "raise-20", up).otherwise(say(False, "unknown_action"))


def new_budget(current: Column, percent: Column) -> Column:
    """Rounded to cents; null when it would fall under one cent."""
    value = F.bround(current * (1 + percent / 100.0), 2)
    return F.when(value >= 0.01, value)


def campaign_totals(items: DataFrame) -> DataFrame:
    """Per campaign: clicks, value, cost (from millionths), value per click."""
    rows = items.withColumn("cost_micros", (F.col("cost") * 1_000_000).cast("long")).groupBy("campaign").agg(F.sum("clicks").alias("clicks"), F.sum("value").cast("double").alias("value"), (F.sum("cost_micros") / 1e6).alias("cost"))
    return rows.withColumn("opb", F.when(F.col("clicks") > 0, F.col("value") / F.col("clicks")))


def dense_series(facts: DataFrame, days: DataFrame, key: str) -> DataFrame:
    """Every key on every day, zeros filled in; the ratio comes from summed components."""
    spine = facts.select(key).distinct().join(days, F.lit(True), "cross")
    rows = spine.join(facts.groupBy(key, "day").agg(F.sum("clicks").alias("clicks"), F.sum("cost").cast("double").alias("cost")), [key, "day"], "left").na.fill(0, ["clicks", "cost"])
    return rows.withColumn("cpc", F.when(F.col("clicks") > 0, F.col("cost") / F.col("clicks")))


def performers(shops: DataFrame, n: int = 20) -> DataFrame:
    return shops.orderBy(F.desc("revenue"), F.desc("clicks"), F.desc("cost"), "shop_id").limit(n)


def item_sets(items: DataFrame) -> DataFrame:
    """Per item over accounts: sums, and sorted sets of campaigns, labels, shops."""
    s = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    return items.groupBy("item_id").agg(F.sum("clicks").alias("clicks"), F.sum("value").cast("double").alias("value"), F.sum("cost").cast("double").alias("cost"), s("campaign"), s("label"), s("account"))


def keep_first(rows: DataFrame) -> DataFrame:
    """One row for each (shop, upper-cased domain): the earliest day, then the least id."""
    w = Window.partitionBy("shop_id", F.upper("domain")).orderBy("data_day", "id")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def changed_since(daily: DataFrame, key: str, day: str, value: str, look_back: int = 14) -> DataFrame:
    """Of the newest day: rows whose value differs from the one before in the look-back; first seen counts as changed."""
    newest = daily.agg(F.max(day)).first()[0]
    rows = daily.filter(F.col(day) > F.lit(newest) - look_back)
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(day))
    seen = F.lag(F.lit(1)).over(Window.partitionBy(key).orderBy(day))
    rows = rows.withColumns({"prev": prev, "__seen": seen}).filter(F.col(day) == F.lit(newest))
    return rows.filter(F.col("__seen").isNull() | ~F.col(value).eqNullSafe(F.col("prev"))).select(key, day, value, "prev")


def gap_events(actions: DataFrame, minutes: int = 30) -> DataFrame:
    """Per (shop, country, action): events that more than `minutes` separate, last time; and whether the shop is paused now."""
    keys = ["shop_id", "country", "action"]
    before = F.lag("created_at").over(Window.partitionBy(*keys).orderBy("created_at", "event_id"))
    new = before.isNull() | (micros(F.col("created_at")) - micros(before) > minutes * 60_000_000)
    return actions.withColumn("new", new).groupBy(*keys).agg(F.count_if("new").alias("events"), F.max("created_at").alias("last_at"))


def paused_now(actions: DataFrame) -> DataFrame:
    last = lambda a: F.max(F.when(F.col("action") == a, F.col("created_at")))
    rows = actions.groupBy("shop_id", "country").agg(last("Paused").alias("paused_at"), last("Enabled").alias("enabled_at"))
    return rows.withColumn("paused", F.col("paused_at").isNotNull() & (F.col("enabled_at").isNull() | (F.col("paused_at") > F.col("enabled_at"))))


def gap_sessions(actions: DataFrame, minutes: int = 30) -> DataFrame:
    """Rows with session number (running sum of gaps) and the session's start, by shop."""
    w = Window.partitionBy("shop_id").orderBy("created_at", "event_id")
    before = F.lag("created_at").over(w)
    gap = F.when(before.isNull() | (micros(F.col("created_at")) - micros(before) > minutes * 60_000_000), 1).otherwise(0)
    rows = actions.withColumn("gap", gap).withColumn("session", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("started_at", F.min("created_at").over(Window.partitionBy("shop_id", "session"))).drop("gap")


def item_plan(desired: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """missing / reactivate / unchanged / extra."""
    a, b = desired.select(key, F.lit(1).alias("want")), existing.select(key, "enabled", F.lit(1).alias("have"))
    state = F.when(F.col("want").isNull(), "extra").when(F.col("have").isNull(), "missing").when(F.col("enabled"), "unchanged").otherwise("reactivate")
    return a.join(b, key, "full").select(key, state.alias("state"))


def bid_change(level: Column, margin: Column, clicks: Column, cost: Column, revenue: Column, opb: Column, name: Column, include=(), exclude=()) -> Column:
    """Which step on the ladder 1, 2, 3."""
    low = F.lower(name)
    hit = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: low.contains(x)) if xs else F.lit(False)
    roas = F.when(cost > 0, revenue / cost).otherwise(0.0)
    up = (margin > 10) & (clicks > 39) & (roas >= 1.30)
    out = F.when(~hit(include), "not included") if include else F.when(F.lit(False), "")
    return (
        out.when(hit(exclude), "excluded")
        .when(clicks.isNull() | (clicks == 0), "no_data")
        .when((margin < -10) & (level == 3), "3_to_2")
        .when((margin < -10) & (level == 2), "2_to_1")
        .when((margin < -10) & (level == 1), "stuck_l1")
        .when(up & (level == 1) & (opb > 0.15), "1_to_2")
        .when(up & (level == 2) & (opb > 0.20), "2_to_3")
        .otherwise("unchanged")
    )


def linkage_plan(feed: DataFrame, flags: DataFrame) -> DataFrame:
    """feed (shop_id, linkage) with the newest flags: a pause or enable row for each country, or why there is none."""
    rows = feed.join(flags.select("shop_id", "is_nl", "is_be", F.lit(True).alias("known")), "shop_id", "left")
    countries = F.array_compact(F.array(F.when(F.col("is_nl") == 1, "NL"), F.when(F.col("is_be") == 1, "BE")))
    skip = F.when(F.col("known").isNull(), "unknown_shop").when(F.size(countries) == 0, "no_country")
    rows = rows.withColumn("skip", skip).withColumn("country", F.explode_outer(F.when(skip.isNull(), countries)))
    return rows.select("shop_id", "country", F.when(F.col("skip").isNull(), F.when(F.col("linkage") == 1, "enable").otherwise("pause")).alias("action"), "skip")


def flag_changes(daily: DataFrame, flags: list[str]) -> DataFrame:
    """Changes from one day to the next, a row for each flag, with the model."""
    rows = daily.unpivot(["shop_id", "data_day", "model"], flags, "flag", "value")
    w = Window.partitionBy("shop_id", "flag").orderBy("data_day")
    rows = rows.withColumns({"prev": F.lag("value").over(w), "prev_day": F.lag("data_day").over(w)})
    return rows.filter((F.col("prev_day") == F.col("data_day") - 1) & (F.col("prev") != F.col("value"))).select("shop_id", "data_day", "model", "flag", F.when(F.col("value") == 1, "on").otherwise("off").alias("change"))


def duplicate_creatives(ads: DataFrame) -> DataFrame:
    """ads (group_id, ad_id, headlines, descriptions, labels, enabled): of equal content the best scored ad stays, the first on a tie."""
    signature = F.md5(F.to_json(F.struct(F.array_sort("headlines").alias("h"), F.array_sort("descriptions").alias("d"))))
    score = F.col("labels") * 100 + F.when(F.col("labels") > 0, 10).otherwise(0) + F.col("enabled").cast("int")
    rows = ads.withColumns({"signature": signature, "score": score})
    w = Window.partitionBy("group_id", "signature")
    rows = rows.withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy(F.desc("score"), "ad_id"))})
    return rows.filter("n > 1").select("group_id", "ad_id", F.when(F.col("rn") == 1, "keep").otherwise("remove").alias("decision"))


def stock_candidates(feed: DataFrame, items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Out-of-stock items that still serve: sums and sets of CAM-06, flagged when excluded already, dearest first."""
    rows = feed.filter("not in_stock").join(item_sets(items), "item_id")
    rows = rows.join(excluded.select("item_id", F.lit(True).alias("__ex")).distinct(), "item_id", "left")
    return rows.select("item_id", "clicks", "cost", "campaigns", F.coalesce("__ex", F.lit(False)).alias("excluded"))


def snapshot_calendar(daily: DataFrame) -> DataFrame:
    return daily.groupBy("data_day").agg(F.count("*").alias("shops"), F.count_if(F.col("linkage") == 0).alias("paused"), F.count_if(F.col("linkage") == 1).alias("enabled"))


def coverage_matrix(cats: DataFrame, labels: list[str], campaigns: DataFrame) -> DataFrame:
    """Does campaign <category>_<label> exist; all labels present; is the category a leaf (no other names it as its parent)."""
    rows = cats.select("cat").withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    rows = rows.withColumn("name", F.concat_ws("_", "cat", "label")).join(campaigns.select("name").distinct().withColumn("there", F.lit(1)), "name", "left")
    wide = rows.groupBy("cat").agg(*(F.max(F.when((F.col("label") == x) & F.col("there").isNotNull(), 1).otherwise(0)).alias(f"has_{x}") for x in labels), F.count("there").alias("present"))
    parents = cats.select(F.col("parent").alias("cat")).distinct().withColumn("__p", F.lit(True))
    return wide.join(parents, "cat", "left").withColumns({"is_leaf": F.col("__p").isNull(), "complete": F.col("present") == len(labels)}).drop("__p")


def missing_themes(groups: DataFrame, themes: list[str], done: DataFrame, creatives: DataFrame) -> DataFrame:
    """(group, theme) without the done label and without a creative of the theme."""
    grid = groups.select("group_id").distinct().withColumn("theme", F.explode(F.array(*map(F.lit, themes))))
    return grid.join(done.select("group_id", "theme"), ["group_id", "theme"], "left_anti").join(creatives.select("group_id", "theme"), ["group_id", "theme"], "left_anti")


def account_rollup(shops: DataFrame) -> DataFrame:
    return shops.withColumn("country", F.when(F.col("is_nl") == 1, "NL").when(F.col("is_be") == 1, "BE").otherwise("-")).rollup("country").agg(F.count("*").alias("shops"), F.count_if(F.col("linkage") == 1).alias("enabled"), F.count_if(F.col("linkage") == 0).alias("paused"), F.min("data_day").alias("first_day"))


def first_seen(daily: DataFrame, known: DataFrame) -> DataFrame:
    """First day per (shop, country); recorded first days are never overwritten."""
    rows = daily.select("shop_id", "data_day", F.explode(F.array_compact(F.array(F.when(F.col("is_nl") == 1, "NL"), F.when(F.col("is_be") == 1, "BE")))).alias("country"))
    fresh = rows.groupBy("shop_id", "country").agg(F.min("data_day").alias("first_day"))
    return known.unionByName(fresh.join(known.select("shop_id", "country"), ["shop_id", "country"], "left_anti"))
