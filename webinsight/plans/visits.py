"""Queries of the visit, priority and join operators."""

from pyspark.sql import functions as F

from webinsight.functions.norm import facet_pairs, leaf_slug
from webinsight.operators import priority as P
from webinsight.operators import visits as V

from .registry import query

_LIVE = "live as (select * from v_clicks where actual_ind = 1 and deleted_ind = 0 and label not in ('cpa_after_180_days', 'rejected_click'))"
_DAILY = f"""{_LIVE}, daily as (select coalesce(v.date_key, r.date_key) as date_key, coalesce(v.channel, r.channel) as channel, coalesce(visits, 0) as visits, coalesce(clicks, 0) as clicks, coalesce(noprod, 0) as noprod, coalesce(revenue, 0.0) as revenue
  from (select date_key, channel, count(*) as visits, cast(sum(clicks) as bigint) as clicks, count(*) filter (noprod) as noprod from v_visits group by all) v
  full join (select date_key, channel, cast(sum(revenue) as double) as revenue from live group by all) r on v.date_key = r.date_key and v.channel = r.channel)"""
_PCT = lambda a, b: f"case when {b} is not null and {b} <> 0 then ({a} - {b}) * 100.0::double / {b} end"
_LT = "case when contains(url, '/r/') then 'R-url' when contains(url, '/c/') then 'C-url' when contains(url, '/p/') then 'PLP' when contains(url, '/products/') then 'Browse' else 'Other' end"


@query("vis_01_device_class", "select ua_class, count(*) as n from (select case when lower(ua) like '%ipad%' or lower(ua) like '%tablet%' then 'tablet' when lower(ua) like '%mobi%' or lower(ua) like '%iphone%' or lower(ua) like '%android%' then 'mobile' when ua is null or ua = '' then 'unknown' else 'desktop' end as ua_class from (select case event_id % 4 when 0 then ua when 1 then 'X Android' when 2 then 'iPad' else null end as ua from v_hits)) group by all")
def _(t):
    n = F.col("event_id") % 4
    ua = F.when(n == 0, F.col("ua")).when(n == 1, "X Android").when(n == 2, "iPad")
    return t("v_hits").select(V.device_class(ua).alias("ua_class")).groupBy("ua_class").agg(F.count("*").alias("n"))


@query("vis_02_landing_type", f"select {_LT} as landing, count(*) as visits from v_visits group by all")
def _(t):
    return t("v_visits").groupBy(V.landing_type(F.col("url")).alias("landing")).agg(F.count("*").alias("visits"))


@query("vis_03_live_rows", f"with {_LIVE} select label, count(*) as n, cast(sum(revenue) as double) as revenue from live group by all")
def _(t):
    return V.live_rows(t("v_clicks")).groupBy("label").agg(F.count("*").alias("n"), V.money("revenue"))


@query("vis_04_facet_filters", "select url, count(*) as visits from v_visits where contains(url, '/c/') and (contains(url, 'red') or contains(url, 'blue')) and not contains(url, 'bulk') and not contains(url, '?') group by all")
def _(t):
    return t("v_visits").filter(V.url_terms(F.col("url"), ["/c/"], ["red", "blue"], ["bulk", "?"])).groupBy("url").agg(F.count("*").alias("visits"))


@query("joi_01_star", "select nation, channel, count(*) as visits from v_visits join (select s_suppkey, n_name as nation from supplier join nation on s_nationkey = n_nationkey) s on l_suppkey = s_suppkey group by all")
def _(t):
    dim = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("nation"))
    return V.with_channel(t("v_visits"), dim, ["l_suppkey"]).groupBy("nation", "channel").agg(F.count("*").alias("visits"))


@query("src_03_read_star", "select o_orderpriority, p_type, count(*) as n, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as price from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_shipdate >= timestamp '1998-01-01' and l_shipdate < timestamp '1999-01-01' group by all")
def _(t):
    fact = t("lineitem").filter("l_shipdate >= timestamp'1998-01-01' and l_shipdate < timestamp'1999-01-01'")
    rows = fact.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("o_orderpriority", "p_type").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("price"))


@query("vis_05_channel_daily", f"with {_DAILY} select * from daily")
def _(t):
    return V.channel_daily(t("v_visits"), t("v_clicks"))


@query("vis_06_rates", f"with {_DAILY} select *, case when visits > 0 then clicks * 100.0::double / visits end as ctr, case when visits > 0 then noprod * 100.0::double / visits end as bounce, case when visits > 0 then revenue / visits end as rpv from daily")
def _(t):
    return V.rates(V.channel_daily(t("v_visits"), t("v_clicks")))


@query("vis_07_two_point", f"""with {_DAILY}, s as (select channel, cast(coalesce(sum(visits) filter (date_key = 19980615), 0) as bigint) as visits, cast(coalesce(sum(visits) filter (date_key = 19980608), 0) as bigint) as visits_before,
  coalesce(sum(revenue) filter (date_key = 19980614), 0) as revenue, coalesce(sum(revenue) filter (date_key = 19980607), 0) as revenue_before from daily group by channel)
  select *, visits - visits_before as visits_delta, {_PCT('visits', 'visits_before')} as visits_pct, {_PCT('revenue', 'revenue_before')} as revenue_pct from s""")
def _(t):
    return V.two_point(V.channel_daily(t("v_visits"), t("v_clicks")), 19980615)


@query("vis_08_category_deltas", """with d as (select deepest_cat as category, count(*) filter (date_key between 19980101 and 19981231) as now, count(*) filter (date_key between 19970101 and 19971231) as before from v_visits where deepest_cat in (select deepest_cat from v_cats where is_lowest) group by 1), e as (select *, now - before as delta from d)
  select *, 'best' as side from (select * from e order by delta desc, category limit 100) union all select *, 'worst' from (select * from e order by delta, category limit 100)""")
def _(t):
    return V.category_deltas(t("v_visits"), "deepest_cat", (19980101, 19981231), (19970101, 19971231), 100, t("v_cats"))


@query("vis_09_distribution", f"""with s as (select {_LT} as landing, count(*) filter (date_key between 19980101 and 19981231) as value, count(*) filter (date_key between 19970101 and 19971231) as before from v_visits group by 1)
  select landing, value, round(100.0::double * value / sum(value) over (), 1) as share, {_PCT('value', 'before')} as wow, cast(coalesce(nullif(list_position(['R-url', 'C-url', 'PLP'], landing), 0), 4) as bigint) as place from s where value > 0""")
def _(t):
    rows = t("v_visits").withColumn("landing", V.landing_type(F.col("url")))
    return V.distribution(rows, "landing", ["R-url", "C-url", "PLP"], F.col("date_key").between(19980101, 19981231), F.col("date_key").between(19970101, 19971231))


@query("vis_10_standup", "select date_key, count(*) as visits, cast(sum(revenue) as double) as total, cast(sum(case when channel <> '5-LOW' then revenue else 0 end) as double) as total_direct, cast(sum(revenue) as double) / count(*) as opb, count(*) filter (noprod)::double / count(*) as bounce, sum(clicks)::double / count(*) as ctr from v_visits group by all")
def _(t):
    return V.standup_daily(t("v_visits"))


@query("vis_11_periods", "select *, p2 - p1 as delta from (select main_cat, channel, cast(coalesce(sum(revenue) filter (date_key between 19970101 and 19970630), 0) as double) as p1, cast(coalesce(sum(revenue) filter (date_key between 19980101 and 19980630), 0) as double) as p2 from v_visits group by all) where p1 > 0 or p2 > 0")
def _(t):
    return V.period_comparison(t("v_visits"), (19970101, 19970630), (19980101, 19980630))


@query("vis_12_trend", "select cast(date_key // 100 as bigint) as month, channel, count(*) as visits, cast(sum(revenue) as double) as revenue from v_visits where date_key // 100 <= 200012 group by all")
def _(t):
    return V.channel_trend(t("v_visits"), 200012)


@query("vis_13_weighted_position", "select p_type, channel, cast(sum(l_linenumber * clicks) as bigint)::double / nullif(sum(clicks), 0) as avg_position, cast(sum(clicks) as bigint) as impressions from v_visits join part on l_partkey = p_partkey group by all")
def _(t):
    rows = t("v_visits").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return V.weighted_position(rows, ["p_type", "channel"], "l_linenumber", "clicks")


@query("vis_14_search_finder", """with u as (select url, count(*) as visits from v_visits where contains(url, '/r/') group by url having count(*) > 1), w as (select 1 as row_id, ['red'] as terms union all select 2, ['brand_1', 'widget'] union all select 3, ['ring'])
  select row_id, url, visits, rn from (select *, row_number() over (partition by row_id order by visits desc, url) as rn from u join w on len(list_filter(terms, lambda x: not contains(url, x))) = 0) where rn <= 20""")
def _(t):
    return V.search_finder(t("v_visits"), [(1, ["red"]), (2, ["brand_1", "widget"]), (3, ["ring"])])


@query("vis_15_search_stats", "select count(distinct url) as urls, count(*) as visits from v_visits where contains(url, '/r/')")
def _(t):
    return V.search_stats(t("v_visits"))


@query("vis_16_trailing", f"""with {_DAILY} select channel, date_key, coalesce(visits, 0) as visits, coalesce(revenue, 0.0) as revenue from (select distinct channel from daily) c cross join
  (select cast(strftime(d, '%Y%m%d') as bigint) as date_key from generate_series(date '1998-06-02', date '1998-06-15', interval 1 day) s(d)) left join daily using (channel, date_key)""")
def _(t):
    return V.trailing_series(V.channel_daily(t("v_visits"), t("v_clicks")), 19980615)


@query("joi_06_two_facts", f"""with {_LIVE} select coalesce(vk, rk) as category, coalesce(visits, 0) as visits, coalesce(revenue, 0.0) as revenue from (select deepest_cat as vk, count(*) as visits from v_visits group by 1)
  full join (select deepest_cat as rk, cast(sum(revenue) as double) as revenue from live group by 1) on vk is not distinct from rk""")
def _(t):
    return V.category_measures(t("v_visits"), t("v_clicks"), "deepest_cat")


@query("dat_01_label_windows", """with g as (select channel, datediff('day', strptime(cast(date_key as varchar), '%Y%m%d'), timestamp '1998-12-31') as gap from v_visits)
  select 'level' as window, channel, count(*) as visits from g where gap between 0 and 89 group by all union all select 'recent', channel, count(*) from g where gap between 0 and 13 group by all union all select 'prior', channel, count(*) from g where gap between 14 and 27 group by all""")
def _(t):
    return V.label_windows(t("v_visits"), 19981231)


_URLS = "urls as (select main_cat, url, count(*) as visits, sum(revenue) as revenue from v_visits group by all)"
_PARSED = f"""{_URLS}, p0 as (select *, split_part(url, '?', 1) as path from urls), p1 as (select *, lower(list_filter(string_split(regexp_replace(split_part(path, '/c/', 1), '(?i)^https?://[^/]+', ''), '/'), lambda x: x <> '')[-1]) as cat_slug,
  list_filter(list_transform(string_split(split_part(path, '/c/', 2), '~~'), lambda x: struct_pack(slug := lower(split_part(trim(x, '/'), '~', 1)), value := split_part(split_part(trim(x, '/'), '~', 2), '/', 1))), lambda s: s.slug <> '' and s.value <> '') as facets from p0 where contains(path, '/c/')),
  parsed as (select * from p1 where len(facets) > 0)"""
_FACETS = f"{_PARSED}, facets as (select cat_slug, slug, cast(sum(visits) as bigint) as visits, cast(sum(revenue) as double) as revenue, count(*) as url_count, min(url) as example from (select cat_slug, url, visits, revenue, unnest(list_distinct(list_transform(facets, lambda s: s.slug))) as slug from parsed) group by all)"
_TOTALS = "totals as (select cat_slug, cast(sum(visits) as bigint) as cat_visits, cast(sum(revenue) as double) as cat_revenue, count(*) as cat_urls from parsed group by all)"
_SHARES = f"{_FACETS}, {_TOTALS}, shares as (select f.*, cat_visits, cat_revenue, cat_urls, case when cat_visits > 0 then visits / cat_visits * 100.0::double else 0 end as pct_visits, case when cat_revenue > 0 then revenue / cat_revenue * 100.0::double else 0 end as pct_revenue from facets f join totals using (cat_slug))"
PRIORITY_SQL = f"""{_SHARES}, decided as (select s.*, k.deepest_cat is not null as known_cat, t.slug is not null as linked, t.seo_prio,
    case when k.deepest_cat is null or t.slug is null then 'keep' when pct_visits >= 10 and pct_revenue >= 10 and visits >= 50 and not coalesce(t.seo_prio, false) then 'turn_on'
      when pct_visits < 2 and pct_revenue < 2 and coalesce(t.seo_prio, false) then 'turn_off' else 'keep' end as action
  from shares s left join (select distinct deepest_cat from v_cats) k on k.deepest_cat = s.cat_slug left join v_settings t on t.deepest_cat = s.cat_slug and t.slug = s.slug)
  , decisions as (select cat_slug, slug, visits, revenue, url_count, pct_visits, pct_revenue, action,
    case when not known_cat or not linked then 'unknown' when action = 'turn_on' then '1' when action = 'turn_off' then '0' when coalesce(seo_prio, false) then '1' when seo_prio is null then 'inherit' else '0' end as proposed,
    case when not known_cat then 'no category for slug ''' || cat_slug || '''' when not linked then 'facet ''' || slug || ''' is not linked to the category' when action = 'turn_on' then visits || ' visits across ' || url_count || ' URLs, now ' || case when seo_prio is null then 'inherit' else 'off' end
      when action = 'turn_off' then 'only ' || visits || ' visits, now on' else 'no flip' end as reason from decided)"""


@query("pri_01_parse_facets", f"with {_PARSED} select url, cat_slug, list_transform(facets, lambda s: s.slug || '=' || s.value) as facets from parsed")
def _(t):
    rows = P.parse_urls(P.url_totals(t("v_visits")))
    return rows.select("url", "cat_slug", F.transform("facets", lambda p: F.concat(p["slug"], F.lit("="), p["value"])).alias("facets"))


@query("pri_02_attribution", f"with {_FACETS} select * from facets")
def _(t):
    return P.attribute(P.parse_urls(P.url_totals(t("v_visits"))))


@query("pri_03_denominators", f"with {_PARSED}, {_TOTALS} select * from totals")
def _(t):
    return P.denominators(P.parse_urls(P.url_totals(t("v_visits"))))


@query("pri_04_shares", f"with {_SHARES} select cat_slug, slug, pct_visits, pct_revenue from shares")
def _(t):
    parsed = P.parse_urls(P.url_totals(t("v_visits")))
    return P.shares(P.attribute(parsed), P.denominators(parsed)).select("cat_slug", "slug", "pct_visits", "pct_revenue")


@query("pri_05_run_summary", f"with {PRIORITY_SQL} select action, count(*) as n from decisions group by all")
def _(t):
    return P.run_summary(P.priority_run(t("v_visits"), t("v_cats"), t("v_settings")))


@query("pri_06_decide_priority", f"with {PRIORITY_SQL} select * from decisions")
def decide_priority(t):
    return P.priority_run(t("v_visits"), t("v_cats"), t("v_settings"))
