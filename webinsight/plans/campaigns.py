"""Queries of the campaign operators."""

from pyspark.sql import functions as F

from webinsight.operators import campaigns as C
from webinsight.operators.sets import merge_plan

from .registry import query

_PERF = """perf as (select *, revenue - cost as margin, n_linked::double / n_items as linkage, case when clicks > 0 then revenue / clicks end as rev_click from (select shop_id, cast(sum(value) as double) as revenue, cast(sum(cost) as double) as cost, count(*) as transactions,
  count(distinct item_id) filter (label <> 'label_R') as n_linked, count(distinct item_id) as n_items, cast(sum(clicks) as bigint) as clicks from v_items group by 1))"""
_DELTA = """dl as (select *, case when rev_click is not null and rev_click_old is not null and rev_click_old <> 0 then (rev_click - rev_click_old) / rev_click_old * 100 end as delta from (select shop_id, cast(sum(value) filter (l_linenumber > 3) as double) / sum(clicks) filter (l_linenumber > 3) as rev_click,
  cast(sum(value) filter (l_linenumber <= 3) as double) / sum(clicks) filter (l_linenumber <= 3) as rev_click_old from v_items group by 1))"""
#: Inputs over the whole range of the rules, derived from order lines.
_CASES = """cases as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice % 80) - 30 as margin, case when l_linenumber = 7 then null else (l_quantity % 11) / 4.0 end as rev_click, case when l_linenumber = 6 then null else (l_extendedprice % 60) - 45 end as delta, l_discount * 10 as linkage, cast(l_quantity as bigint) % 15 as transactions from lineitem)"""
_ACTION = """case when margin < -25 then 'lower-25' when margin > -25 and margin < -5 then 'lower-20' when margin > 0 and linkage > 0.5 and transactions >= 7 and rev_click > 1.38 then case when delta > -15 then 'raise-20' when delta < -30 then 'c-lower-20' end
  when margin > 0 and linkage > 0.5 and transactions >= 7 and rev_click < 1.38 then 'lower-20' end"""
_REASON = """case when margin < -25 or (margin > -25 and margin < -5) then null when margin > 0 then case when linkage > 0.5 and transactions >= 7 then case when rev_click > 1.38 then case when delta is null then 'delta_unknown' when delta > -15 or delta < -30 then null else 'missed' end
  when rev_click < 1.38 then null else 'rev_click_unknown' end when transactions < 7 then 'low_transactions' when linkage < 0.5 then 'low_linkage' else 'no_action' end else 'no_action' end"""


def cases(t):
    price, q, n = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (price % 80 - 30).alias("margin"), F.when(n != 7, q % 11 / 4.0).alias("rev_click"), F.when(n != 6, price % 60 - 45).alias("delta"), (F.col("l_discount") * 10).alias("linkage"), (q.cast("long") % 15).alias("transactions"))


def action(df):
    return df.withColumn("a", C.budget_action(F.col("margin"), F.col("rev_click"), F.col("delta"), F.col("linkage"), F.col("transactions")))


@query("cam_01_shop_performance", f"with {_PERF} select * from perf")
def _(t):
    return C.shop_performance(t("v_items"), F.col("label") != "label_R")


@query("cam_02_window_delta", f"with {_DELTA} select * from dl")
def _(t):
    return C.window_delta(t("v_items"), F.col("l_linenumber") > 3)


@query("cam_03_campaign_totals", "select *, case when clicks > 0 then value / clicks end as opb from (select campaign, cast(sum(clicks) as bigint) as clicks, cast(sum(value) as double) as value, cast(sum(cast(trunc(cost * 1000000) as bigint)) as double) / 1e6 as cost from v_items group by 1)")
def _(t):
    return C.campaign_totals(t("v_items"))


@query("cam_04_dense_series", """with f as (select campaign, cast(l_linenumber as bigint) as day, cast(sum(clicks) as bigint) as clicks, cast(sum(cost) as double) as cost from v_items where shop_id % 10 = 3 group by all) select campaign, day, coalesce(clicks, 0) as clicks, coalesce(cost, 0) as cost, case when clicks > 0 then cost / clicks end as cpc
  from (select distinct campaign from f) cross join (select distinct cast(l_linenumber as bigint) as day from lineitem) left join f using (campaign, day)""")
def _(t):
    facts = t("v_items").filter("shop_id % 10 = 3").withColumn("day", F.col("l_linenumber").cast("long"))
    return C.dense_series(facts, t("lineitem").select(F.col("l_linenumber").cast("long").alias("day")).distinct(), "campaign")


@query("cam_05_performers", f"with {_PERF} select * from perf order by revenue desc, clicks desc, cost desc, shop_id limit 20")
def _(t):
    return C.performers(C.shop_performance(t("v_items"), F.col("label") != "label_R"))


@query("cam_06_item_sets", """select item_id, cast(sum(clicks) as bigint) as clicks, cast(sum(value) as double) as value, cast(sum(cost) as double) as cost, array_to_string(list_sort(list(distinct campaign)), ',') as campaigns, array_to_string(list_sort(list(distinct label)), ',') as labels, array_to_string(list_sort(list(distinct account)), ',') as accounts from v_items group by 1""")
def _(t):
    return C.item_sets(t("v_items"))


@query("cam_07_latest_shop", "select * exclude (rn) from (select *, row_number() over (partition by shop_id order by data_day desc) as rn from v_shops) where rn = 1")
def _(t):
    from webinsight.operators.sets import latest_by

    return latest_by(t("v_shops"), ["shop_id"], F.desc("data_day"))


_DOM = "d as (select shop_id, data_day, shop_id * 100 + data_day as id, case data_day % 2 when 0 then 'Shop.nl' else 'SHOP.NL' end || cast(data_day % 3 as varchar) as domain from v_shops)"


@query("cam_08_keep_first", f"with {_DOM} select * exclude (rn) from (select *, row_number() over (partition by shop_id, upper(domain) order by data_day, id) as rn from d) where rn = 1")
def _(t):
    d = t("v_shops").select("shop_id", "data_day", (F.col("shop_id") * 100 + F.col("data_day")).alias("id"), F.concat(F.when(F.col("data_day") % 2 == 0, "Shop.nl").otherwise("SHOP.NL"), (F.col("data_day") % 3).cast("string")).alias("domain"))
    return C.keep_first(d)


@query("cam_09_changed_since", "select shop_id, data_day, linkage, prev from (select *, lag(linkage) over (partition by shop_id order by data_day) as prev, lag(1) over (partition by shop_id order by data_day) as seen from v_shops where data_day > 10 - 14) where data_day = 10 and (seen is null or linkage is distinct from prev)")
def _(t):
    return C.changed_since(t("v_shops"), "shop_id", "data_day", "linkage")


@query("cam_10_gap_events", "select shop_id, country, action, count(*) filter (prev is null or epoch_us(created_at) - epoch_us(prev) > 1800000000) as events, max(created_at) as last_at from (select *, lag(created_at) over (partition by shop_id, country, action order by created_at, event_id) as prev from v_actions) group by all")
def _(t):
    return C.gap_events(t("v_actions"))


@query("cam_10_paused_now", "select *, paused_at is not null and (enabled_at is null or paused_at > enabled_at) as paused from (select shop_id, country, max(created_at) filter (action = 'Paused') as paused_at, max(created_at) filter (action = 'Enabled') as enabled_at from v_actions group by all)")
def _(t):
    return C.paused_now(t("v_actions"))


@query("cam_11_gap_sessions", """with g as (select *, case when lag(created_at) over w is null or epoch_us(created_at) - epoch_us(lag(created_at) over w) > 1800000000 then 1 else 0 end as gap from v_actions window w as (partition by shop_id order by created_at, event_id)),
  s as (select * exclude (gap), cast(sum(gap) over (partition by shop_id order by created_at, event_id rows unbounded preceding) as bigint) as session from g) select *, min(created_at) over (partition by shop_id, session) as started_at from s""")
def _(t):
    return C.gap_sessions(t("v_actions"))


@query("cam_12_budget_action", f"with {_CASES} select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ACTION} as action, {_REASON} as reason from cases")
def _(t):
    return action(cases(t)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a.action", "a.reason")


@query("cam_12_shop_actions", f"with {_PERF}, {_DELTA} select shop_id, {_ACTION} as action, {_REASON} as reason from (select p.shop_id, margin, p.rev_click, delta, linkage, transactions from perf p join dl using (shop_id))")
def _(t):
    rows = C.shop_performance(t("v_items"), F.col("label") != "label_R").join(C.window_delta(t("v_items"), F.col("l_linenumber") > 3).select("shop_id", "delta"), "shop_id")
    return action(rows).select("shop_id", "a.action", "a.reason")


@query("cam_13_campaign_gate", f"""with {_CASES}, x as (select *, {_ACTION} as action, (l_partkey % 21) - 10 as cm, case l_linenumber % 2 when 0 then 'gsd [label:c] x' else 'gsd [label:a]' end as name, cast(l_suppkey % 2 as int) as bc, cast(1 + l_partkey % 50 as double) as cur from cases)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, action, case when action in ('lower-25', 'lower-20') then cm < 0 when action = 'c-lower-20' then contains(name, '[label:c]') else cm > 0 and bc = 1 end as apply,
   case when action in ('lower-25', 'lower-20') then case when cm < 0 then null else 'campaign_margin_non_negative' end when action = 'c-lower-20' then case when contains(name, '[label:c]') then null else 'not_label_c' end when cm > 0 and bc = 1 then null when bc <> 1 then 'not_budget_constrained' else 'campaign_margin_not_positive' end as reason,
   round_even(cur * (1 + (case action when 'lower-25' then -25 when 'raise-20' then 20 else -20 end) / 100.0::double), 2) as budget from x where action is not null""")
def _(t):
    rows = action(cases(t)).withColumn("action", F.col("a.action")).filter("action is not null")
    g = C.campaign_gate(F.col("action"), F.col("l_partkey") % 21 - 10, F.when(F.col("l_linenumber") % 2 == 0, "gsd [label:c] x").otherwise("gsd [label:a]"), (F.col("l_suppkey") % 2).cast("int"))
    pct = F.when(F.col("action") == "lower-25", -25).when(F.col("action") == "raise-20", 20).otherwise(-20)
    rows = rows.withColumns({"g": g, "budget": C.new_budget((1 + F.col("l_partkey") % 50).cast("double"), pct)})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "action", "g.apply", "g.reason", "budget")


@query("cam_14_item_plan", "select coalesce(a.item, b.item) as item, case when a.item is null then 'extra' when b.item is null then 'missing' when enabled then 'unchanged' else 'reactivate' end as state from (select p_partkey as item from part where p_size > 10) a full join (select p_partkey as item, p_size % 2 = 0 as enabled from part where p_size < 40) b on a.item = b.item")
def _(t):
    part = t("part").withColumn("item", F.col("p_partkey"))
    return C.item_plan(part.filter("p_size > 10"), part.filter("p_size < 40").withColumn("enabled", F.col("p_size") % 2 == 0), "item")


@query("cam_15_bid_ladder", """select change, level, count(*) as n from (select level, case when not (contains(lower(name), 'gsd')) then 'not included' when contains(lower(name), 'label_r') then 'excluded' when clicks = 0 then 'no_data' when margin < -10 and level = 3 then '3_to_2' when margin < -10 and level = 2 then '2_to_1' when margin < -10 then 'stuck_l1'
   when margin > 10 and clicks > 39 and revenue / cost >= 1.30 and level = 1 and opb > 0.15 then '1_to_2' when margin > 10 and clicks > 39 and revenue / cost >= 1.30 and level = 2 and opb > 0.20 then '2_to_3' else 'unchanged' end as change
  from (select cast(l_linenumber % 3 + 1 as int) as level, case l_linenumber when 7 then 'x' else 'GSD ' || label end as name, clicks, cast(value as double) / 1000 as revenue, 50.0::double as cost, cast(value as double) / 1000 - 50 as margin, cast(value as double) / 1000 / clicks as opb from v_items)) group by all""")
def _(t):
    rows = t("v_items").select((F.col("l_linenumber") % 3 + 1).cast("int").alias("level"), F.when(F.col("l_linenumber") == 7, "x").otherwise(F.concat(F.lit("GSD "), "label")).alias("name"), "clicks", (F.col("value").cast("double") / 1000).alias("revenue"), F.lit(50.0).alias("cost"))
    change = C.bid_change(F.col("level"), F.col("revenue") - F.col("cost"), F.col("clicks"), F.col("cost"), F.col("revenue"), F.col("revenue") / F.col("clicks"), F.col("name"), ("gsd",), ("label_r",))
    return rows.withColumn("change", change).groupBy("change", "level").agg(F.count("*").alias("n"))


_ASOF = "f as (select * exclude (rn) from (select *, row_number() over (partition by shop_id order by data_day desc) as rn from v_shops where data_day <= 6 and shop_id % 7 <> 0) where rn = 1)"


@query("joi_09_as_of", f"with {_ASOF} select shop_id, data_day, linkage, is_nl, is_be from f")
def _(t):
    from webinsight.operators.sets import as_of

    return as_of(t("v_shops").filter("shop_id % 7 <> 0"), ["shop_id"], "data_day", 6).select("shop_id", "data_day", "linkage", "is_nl", "is_be")


@query("cam_16_linkage_plan", f"""with {_ASOF}, feed as (select s_suppkey as shop_id, cast(s_suppkey % 2 as int) as linkage from supplier), j as (select feed.shop_id, feed.linkage, is_nl, is_be, case when f.shop_id is null then 'unknown_shop' when is_nl = 0 and is_be = 0 then 'no_country' end as skip from feed left join f on f.shop_id = feed.shop_id)
  select shop_id, null as country, null as action, skip from j where skip is not null union all select shop_id, 'NL', case linkage when 1 then 'enable' else 'pause' end, null from j where skip is null and is_nl = 1 union all select shop_id, 'BE', case linkage when 1 then 'enable' else 'pause' end, null from j where skip is null and is_be = 1""")
def _(t):
    from webinsight.operators.sets import as_of

    flags = as_of(t("v_shops").filter("shop_id % 7 <> 0"), ["shop_id"], "data_day", 6)
    return C.linkage_plan(t("supplier").select(F.col("s_suppkey").alias("shop_id"), (F.col("s_suppkey") % 2).cast("int").alias("linkage")), flags)


@query("cam_17_merge_plan", """with st as (select l_partkey as k, cast(max_by(l_quantity, l_orderkey * 10 + l_linenumber) as bigint) as v from (select l_partkey, l_quantity, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_orderkey * 1000000 + l_suppkey * 100 + l_linenumber desc) as rn from lineitem) where rn = 1 group by 1)
  select k, v, case when p_partkey is null then 'insert' when v = cast(p_size as bigint) then 'unchanged' else 'update' end as action from st left join (select * from part where p_partkey % 5 <> 0) on p_partkey = k""")
def _(t):
    staged = t("lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("long").alias("v"), (F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return merge_plan(t("part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v")), staged, "k", ["v"], "seq")


_FLAG = lambda f: f"select shop_id, data_day, model, '{f}' as flag, case {f} when 1 then 'on' else 'off' end as change from (select *, lag({f}) over (partition by shop_id order by data_day) as prev from v_shops) where prev <> {f}"


@query("cam_18_flag_changes", " union all ".join(_FLAG(f) for f in ("linkage", "is_nl", "is_be")))
def _(t):
    return C.flag_changes(t("v_shops"), ["linkage", "is_nl", "is_be"])


@query("joi_10_yesterday", "select shop_id, data_day, case linkage when 1 then 'on' else 'off' end as change from (select *, lag(linkage) over (partition by shop_id order by data_day) as prev, lag(data_day) over (partition by shop_id order by data_day) as pd from v_shops where (shop_id + data_day) % 6 <> 0) where pd = data_day - 1 and prev <> linkage")
def _(t):
    from webinsight.operators.sets import changed_flags

    return changed_flags(t("v_shops").filter("(shop_id + data_day) % 6 <> 0"), "shop_id", "data_day", "linkage")


_ADS = "ads as (select source as group_id, doc_id as ad_id, list_sort(string_split(lower(left(text, 3)), '')) as h, [lang] as d, cast(doc_id % 3 as int) as labels, doc_id % 2 = 0 as enabled from documents)"


@query("cam_19_duplicate_creatives", f"with {_ADS}, s as (select *, count(*) over (partition by group_id, h, d) as n, row_number() over (partition by group_id, h, d order by labels * 100 + case when labels > 0 then 10 else 0 end + enabled::int desc, ad_id) as rn from ads) select group_id, ad_id, case rn when 1 then 'keep' else 'remove' end as decision from s where n > 1")
def _(t):
    ads = t("documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("ad_id"), F.split(F.lower(F.left("text", F.lit(3))), "").alias("headlines"), F.array("lang").alias("descriptions"), (F.col("doc_id") % 3).cast("int").alias("labels"), (F.col("doc_id") % 2 == 0).alias("enabled"))
    return C.duplicate_creatives(ads)


@query("cam_20_stock_candidates", """with i as (select item_id, cast(sum(clicks) as bigint) as clicks, cast(sum(cost) as double) as cost, array_to_string(list_sort(list(distinct campaign)), ',') as campaigns from v_items group by 1) select i.*, i.item_id in (select cast(p_partkey as varchar) from part where p_size = 8) as excluded from i join part on cast(p_partkey as varchar) = item_id where p_size < 10""")
def _(t):
    feed = t("part").select(F.col("p_partkey").cast("string").alias("item_id"), (F.col("p_size") >= 10).alias("in_stock"))
    return C.stock_candidates(feed, t("v_items"), t("part").filter("p_size = 8").select(F.col("p_partkey").cast("string").alias("item_id")))


@query("cam_21_snapshot_calendar", "select data_day, count(*) as shops, count(*) filter (linkage = 0) as paused, count(*) filter (linkage = 1) as enabled from v_shops group by 1")
def _(t):
    return C.snapshot_calendar(t("v_shops"))


@query("cam_22_coverage_matrix", """with c as (select deepest_cat as cat, main_cat as parent from v_cats union select distinct main_cat, 'root' from v_cats), g as (select cat, label, cat || '_' || label as name from c cross join (select unnest(['a', 'b', 'c']) as label)), n as (select distinct deepest_cat || '_' || case l_linenumber % 3 when 0 then 'a' when 1 then 'b' else 'c' end as name from v_visits where clicks > 48),
  w as (select cat, max(case when label = 'a' and n.name is not null then 1 else 0 end) as has_a, max(case when label = 'b' and n.name is not null then 1 else 0 end) as has_b, max(case when label = 'c' and n.name is not null then 1 else 0 end) as has_c, count(n.name) as present from g left join n using (name) group by 1)
  select *, cat not in (select parent from c) as is_leaf, present = 3 as complete from w""")
def _(t):
    cats = t("v_cats").select(F.col("deepest_cat").alias("cat"), F.col("main_cat").alias("parent"))
    cats = cats.unionByName(cats.select(F.col("parent").alias("cat"), F.lit("root").alias("parent"))).distinct()
    n = F.col("l_linenumber") % 3
    made = t("v_visits").filter("clicks > 48").select(F.concat_ws("_", "deepest_cat", F.when(n == 0, "a").when(n == 1, "b").otherwise("c")).alias("name"))
    return C.coverage_matrix(cats, ["a", "b", "c"], made)


@query("cam_23_missing_themes", "select group_id, theme from (select distinct deepest_cat as group_id from v_visits) cross join (select unnest(['spring', 'sale', 'winter']) as theme) where (group_id, theme) not in (select deepest_cat, 'sale' from v_visits where noprod and clicks > 49) and (group_id, theme) not in (select deepest_cat, 'winter' from v_visits where l_linenumber = 1 and clicks > 49)")
def _(t):
    v = t("v_visits")
    groups = v.select(F.col("deepest_cat").alias("group_id"))
    done = v.filter("noprod and clicks > 49").select(F.col("deepest_cat").alias("group_id"), F.lit("sale").alias("theme"))
    made = v.filter("l_linenumber = 1 and clicks > 49").select(F.col("deepest_cat").alias("group_id"), F.lit("winter").alias("theme"))
    return C.missing_themes(groups, ["spring", "sale", "winter"], done, made)


@query("cam_24_account_rollup", "select country, count(*) as shops, count(*) filter (linkage = 1) as enabled, count(*) filter (linkage = 0) as paused, min(data_day) as first_day from (select *, case when is_nl = 1 then 'NL' when is_be = 1 then 'BE' else '-' end as country from v_shops) group by rollup (country)")
def _(t):
    return C.account_rollup(t("v_shops"))


@query("cam_25_first_seen", """with r as (select shop_id, data_day, 'NL' as country from v_shops where is_nl = 1 union all select shop_id, data_day, 'BE' from v_shops where is_be = 1), known as (select s_suppkey as shop_id, 'NL' as country, 0 as first_day from supplier where s_suppkey % 4 = 0)
  select * from known union all select shop_id, country, min(data_day) from r where (shop_id, country) not in (select shop_id, country from known) group by all""")
def _(t):
    known = t("supplier").filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("shop_id"), F.lit("NL").alias("country"), F.lit(0).alias("first_day"))
    return C.first_seen(t("v_shops"), known)
