"""Queries of the coverage operators."""

from pyspark.sql import functions as F

from webinsight.functions.norm import npath
from webinsight.operators import coverage as C
from webinsight.operators.visits import landing_type

from .registry import query

_NP = "rtrim(split_part(split_part(lower(regexp_replace(url, '^https?://[^/]+', '', 'i')), '?', 1), '#', 1), '/')"
_LT = "case when contains(url, '/r/') then 'R-url' when contains(url, '/c/') then 'C-url' when contains(url, '/p/') then 'PLP' when contains(url, '/products/') then 'Browse' else 'Other' end"
_VN = f"vn as (select *, {_NP} as npath from v_visits)"
_U = f"{_VN}, u as (select npath, deepest_cat, main_cat, count(*) as visits, cast(sum(revenue) as double) as revenue from vn group by all)"
_LIVE = "live as (select distinct npath from u where visits >= 4 or contains(npath, 'size'))"
_K = """r as (select *, row_number() over w as rn, sum(visits) over (w rows unbounded preceding) as run, sum(visits) over (partition by deepest_cat) as total from u window w as (partition by deepest_cat order by visits desc, npath)),
  knees as (select deepest_cat, min(rn) filter (run * 100 >= total * 80) as knee80, min(rn) filter (run * 100 >= total * 90) as knee90, min(rn) filter (run * 100 >= total * 95) as knee95, cast(sum(visits) as bigint) as yearly, count(*) as urls from r group by 1)"""
_SCORE = lambda key, frm: f"select *, cast(0.889 as double) * percent_rank() over (partition by {key} order by visits) + cast(0.111 as double) * percent_rank() over (partition by {key} order by greatest(revenue, 0)) as score from {frm}"
_MONTHS = "months as (select deepest_cat, cast(date_key // 100 as bigint) as month, count(*) as visits from v_visits group by all)"
_FEAT = f"""feat as (select npath, count(*) as visits, cast(sum(revenue) as double) as revenue, sum(clicks)::double / count(*) as ctr, count(*) filter (noprod)::double / count(*) as bounce_rate,
  count(*) filter (date_key between 19980701 and 19981231) as visits_recent, count(*) filter (date_key between 19980101 and 19980630) as visits_prior from vn group by 1)"""


def urls(t):
    return C.url_visits(t("v_visits"))


def live(t):
    return urls(t).filter((F.col("visits") >= 4) | F.col("npath").contains("size")).select("npath")


@query("cov_01_features", f"with {_VN}, {_FEAT} select npath, visits, revenue, ctr, bounce_rate, visits_recent, visits_prior from feat")
def _(t):
    return C.features(t("v_visits"), (19980701, 19981231), (19980101, 19980630)).drop("momentum")


@query("cov_01_momentum", f"with {_VN}, {_FEAT} select npath, round(ln((visits_recent + 1) / (visits_prior + 1)), 6) as momentum from feat")
def _(t):
    return C.features(t("v_visits"), (19980701, 19981231), (19980101, 19980630)).select("npath", F.round("momentum", 6).alias("momentum"))


_COVER = f"""flagged as (select v.*, l.npath is not null as in_set, {_LT} as type from vn v left join live l using (npath)),
  cov as (select coalesce(type, '__ALL__') as type, count(*) as visits, count(*) filter (in_set) as visits_in, cast(sum(revenue) as double) as revenue, cast(coalesce(sum(revenue) filter (in_set), 0) as double) as revenue_in from flagged group by rollup (type))"""


@query("cov_02_coverage_table", f"with {_U}, {_LIVE}, {_COVER} select *, 100.0::double * visits_in / visits as coverage_pct from cov")
def _(t):
    return C.coverage_table(C.flag_members(t("v_visits"), live(t)), landing_type(F.col("url")))


@query("joi_04_membership_coverage", f"with {_U}, {_LIVE} select deepest_cat, l.npath is not null as in_set, count(*) as visits from vn v left join live l using (npath) group by all")
def _(t):
    return C.flag_members(t("v_visits"), live(t)).groupBy("deepest_cat", "in_set").agg(F.count("*").alias("visits"))


@query("cov_03_weighted_coverage", f"with {_U}, {_LIVE}, {_COVER} select sum(visits_in) * 100.0::double / sum(visits) as coverage_pct, count(*) as runs from cov where type <> '__ALL__'")
def _(t):
    rows = C.coverage_table(C.flag_members(t("v_visits"), live(t)), landing_type(F.col("url")))
    return C.weighted_coverage(rows.filter("type <> '__ALL__'"))


@query("cov_04_category_months", "select deepest_cat, cast(date_key // 100 as bigint) as month, count(*) as visits, cast(sum(revenue) as double) as revenue from v_visits group by all")
def _(t):
    return C.category_months(t("v_visits"))


@query("cov_05_selection_overlap", f"with {_U}, {_LIVE}, b as (select distinct npath from u where revenue > 50000) select (select count(*) from live) as n_a, (select count(*) from b) as n_b, (select count(*) from live semi join b using (npath)) as n_both, (select count(*) from (select npath from live union select npath from b)) as n_union")
def _(t):
    return C.selection_overlap(live(t), urls(t).filter("revenue > 50000"))


@query("cov_06_snapshot_composition", f"with {_U} select {_LT.replace('(url', '(npath')} as type, main_cat, count(*) as urls from u group by all")
def _(t):
    return urls(t).groupBy(landing_type(F.col("npath")).alias("type"), "main_cat").agg(F.count("*").alias("urls"))


@query("cov_07_knee", f"with {_U}, {_K} select * from knees")
def _(t):
    return C.knees(urls(t))


@query("cov_08_blend_score", f"with {_U} select npath, deepest_cat, score from ({_SCORE('deepest_cat', 'u')})")
def _(t):
    return C.blend_score(urls(t)).select("npath", "deepest_cat", "score")


@query("cov_09_select_top", f"with {_U}, s as ({_SCORE('deepest_cat', 'u')}) select npath, deepest_cat, visits, rank from (select *, row_number() over (partition by deepest_cat order by score desc, visits desc, npath) as rank from s) where rank <= 20")
def _(t):
    return C.select_top(C.blend_score(urls(t)), default=20).select("npath", "deepest_cat", "visits", "rank")


@query("cov_10_main_cat_rollup", f"with {_U}, m as (select u.* exclude (main_cat), c.main_cat from u join (select distinct deepest_cat, main_cat from v_cats) c using (deepest_cat)), s as ({_SCORE('main_cat', 'm')}) select npath, main_cat, rank from (select *, row_number() over (partition by main_cat order by score desc, visits desc, npath) as rank from s) where rank <= 30")
def _(t):
    return C.main_cat_selection(urls(t), t("v_cats"), 30).select("npath", "main_cat", "rank")


@query("cov_11_rank_pct", f"with {_U} select npath, deepest_cat, (rank() over (partition by deepest_cat order by visits) + (count(*) over (partition by deepest_cat, visits) - 1) / 2) / count(*) over (partition by deepest_cat) as visits_pct from u")
def _(t):
    return C.rank_pct(urls(t), "deepest_cat", "visits").select("npath", "deepest_cat", "visits_pct")


@query("cov_12_seasonal_caps", f"""with {_U}, {_K}, {_MONTHS}, clim as (select deepest_cat, month % 100 as m, avg(visits) as mean from months group by all), base as (select deepest_cat, avg(mean) as level from clim group by 1),
  idx as (select deepest_cat, m, case when level > 0 then mean / level else 1 end as idx from clim join base using (deepest_cat)), g as (select k.*, m from knees k cross join (select unnest(range(1, 13)) as m))
  select g.deepest_cat, cast(g.m as bigint) as month, cast(greatest(5, least(400, knee90)) as bigint) as base, yearly,
    cast(greatest(5, least(400, round_even(round(greatest(5, least(400, knee90)) * greatest(0.4::double, least(2.5::double, greatest(coalesce(a.idx, 1), coalesce(b.idx, 1)))), 9), 0))) as bigint) as cap
  from g left join idx a on a.deepest_cat = g.deepest_cat and a.m = g.m left join idx b on b.deepest_cat = g.deepest_cat and b.m = g.m % 12 + 1""")
def _(t):
    return C.seasonal_caps(C.knees(urls(t)), C.category_months(t("v_visits")))


@query("cov_13_size_caps", f"with {_U}, {_LIVE}, n as (select deepest_cat, count(distinct npath) as live from u semi join live using (npath) group by 1) select deepest_cat, live, cast(greatest(10, least(100, ceil(live * 1.5::double))) as bigint) as cap from n")
def _(t):
    rows = urls(t).join(live(t), "npath", "left_semi")
    return C.size_caps(rows, "deepest_cat", 1.5, 10, 100)


@query("cov_14_new_values", "select value, min(day) as first, max(day) as last from (select s_name as value, data_day as day from v_shops join supplier on s_suppkey = shop_id where data_day >= 4 + s_suppkey % 6) group by 1 having min(day) > 10 - 3 and max(day) > 10 - 3")
def _(t):
    loads = t("v_shops").filter(F.col("data_day") >= 4 + F.col("shop_id") % 6).select(F.col("shop_name").alias("value"), F.col("data_day").alias("day"))
    return C.new_values(loads, 10, 3)


@query("cov_15_shadow_compare", f"""with {_VN}, past as (select npath, deepest_cat, main_cat, count(*) as visits, cast(sum(revenue) as double) as revenue from vn where date_key < 19990101 group by all), s as ({_SCORE('deepest_cat', 'past')}),
  picked as (select distinct npath from (select *, row_number() over (partition by deepest_cat order by score desc, visits desc, npath) as rank from s) where rank <= 50), u as (select npath, count(*) as visits from vn group by npath, deepest_cat, main_cat), {_LIVE},
  f as (select p.npath is not null as nw, l.npath is not null as od from vn left join picked p using (npath) left join live l using (npath) where date_key >= 19990101)
  select count(*) as visits, count(*) filter (nw) * 100.0::double / count(*) as new_pct, count(*) filter (od) * 100.0::double / count(*) as old_pct, count(*) filter (nw and not od) as add_visits, count(*) filter (od and not nw) as drop_visits from f""")
def _(t):
    return C.shadow_compare(t("v_visits"), live(t), 19990101)


def _frame(t):
    past = t("v_visits").filter("date_key < 19990101")
    keys = past.select(npath(F.col("url")).alias("npath"), "main_cat").groupBy("npath").agg(F.min("main_cat").alias("main_cat"))
    frame = C.features(past, (19980701, 19981231), (19980101, 19980630)).join(keys, "npath")
    target = t("v_visits").filter("date_key >= 19990101").groupBy(npath(F.col("url")).alias("npath")).agg(F.count("*").alias("visits"), F.sum("revenue").cast("double").alias("revenue"))
    return frame, target


@query("cov_16_backtest_weights")
def _(t):
    frame, target = _frame(t)
    weights, best = C.backtest(frame, target, "main_cat", cap=300, rounds=4)
    return t.spark.createDataFrame([(k, float(v), float(best)) for k, v in sorted(weights.items())], "feature string, weight double, objective double")


@query("cov_16_coverage_curve")
def _(t):
    frame, target = _frame(t)
    return C.coverage_curve(C.blend_score(frame, "main_cat"), target, "main_cat", [10, 20, 40, 80])


@query("cov_17_knee_guard", f"with {_U}, {_K}, half as (select greatest(1, knee90 - 3) as knee90 from knees) select (select quantile_cont(knee90::double, 0.5) from knees) as old, (select quantile_cont(knee90::double, 0.5) from half) as new, (select quantile_cont(knee90::double, 0.5) from half) * 2 >= (select quantile_cont(knee90::double, 0.5) from knees) as ok")
def _(t):
    old = C.knees(urls(t))
    return C.knee_guard(old, old.select(F.greatest(F.lit(1), F.col("knee90") - 3).alias("knee90")))


_HEAD = "heads as (select npath, case when hash_n % 5 = 0 then null when hash_n % 7 = 0 then repeat('x', 130) else 'Heading ' || npath end as heading from (select npath, length(npath) as hash_n from u group by npath))"


def _headings(t):
    n = F.length("npath")
    return urls(t).select("npath").distinct().select("npath", F.when(n % 5 == 0, None).when(n % 7 == 0, F.repeat(F.lit("x"), 130)).otherwise(F.concat(F.lit("Heading "), "npath")).alias("heading"))


@query("cov_18_payload", f"""with {_U}, {_HEAD}, s as ({_SCORE('deepest_cat', 'u')}), sel as (select npath, deepest_cat, case when rank <= 20 then rank end as rank from (select *, row_number() over (partition by deepest_cat order by score desc, visits desc, npath) as rank from s) where rank <= 25)
  select case when contains(npath, '/p/') then 'product_page' when heading is null or heading = '' then 'no_heading' when rank is null then 'no_rank' when length(heading) > 120 then 'too_long' end as skip, count(*) as n from sel left join heads using (npath) group by all""")
def _(t):
    sel = C.select_top(C.blend_score(urls(t)), default=25).select("npath", "deepest_cat", F.when(F.col("rank") <= 20, F.col("rank")).alias("rank"))
    return C.payload(sel, _headings(t)).groupBy("skip").agg(F.count("*").alias("n"))


@query("cov_18_preserved", f"""with {_U}, s as ({_SCORE('deepest_cat', 'u')}), rk as (select npath, deepest_cat, row_number() over (partition by deepest_cat order by score desc, visits desc, npath) as rank from s), nw as (select * from rk where rank <= 10), od as (select * from rk where rank <= 20 and rank % 2 = 0)
  select deepest_cat, npath, rank from nw union all select deepest_cat, npath, (select max(rank) from nw n where n.deepest_cat = o.deepest_cat) + row_number() over (partition by deepest_cat order by rank, npath) from od o where (deepest_cat, npath) not in (select deepest_cat, npath from nw)""")
def _(t):
    rows = C.select_top(C.blend_score(urls(t)), default=20)
    return C.append_preserved(rows.filter("rank <= 10"), rows.filter("rank % 2 = 0"))


@query("cov_19_payload_issues", f"""with {_U}, {_HEAD}, rows as (select npath, heading, count(*) over (partition by npath) as n from u left join heads using (npath))
  select npath, code from (select npath, unnest([case when coalesce(npath, '') = '' then 'empty_path' end, case when coalesce(heading, '') = '' then 'empty_heading' end, case when n > 1 then 'duplicate' end, case when contains(npath, '/p/') then 'product_page' end, case when length(heading) > 120 then 'too_long' end]) as code from rows) where code is not null""")
def _(t):
    return C.payload_issues(urls(t).select("npath").join(_headings(t), "npath", "left"))


@query("cov_20_demand_spikes", "select deepest_cat, count(*) filter (date_key between 19980601 and 19980630) as recent, count(*) filter (date_key between 19980101 and 19980131) as prior from v_visits group by 1 having count(*) filter (date_key between 19980601 and 19980630) >= 5 and count(*) filter (date_key between 19980601 and 19980630) >= 1.5 * count(*) filter (date_key between 19980101 and 19980131)")
def _(t):
    return C.demand_spikes(t("v_visits"), (19980601, 19980630), (19980101, 19980131), 1.5, 5)


@query("cov_21_feature_ablation")
def _(t):
    frame, target = _frame(t)
    volume = t("v_keywords")
    frame = frame.withColumn("keyword", F.regexp_extract("npath", "color_([a-z]+)", 1))
    by_word = volume.select(F.split_part("keyword", F.lit(" "), F.lit(1)).alias("keyword"), "volume").groupBy("keyword").agg(F.max("volume").alias("volume"))
    frame = frame.join(by_word, "keyword", "left")
    _, with_volume = C.backtest(frame, target, "main_cat", cap=300, rounds=4, names=(*C.FEATURES, "volume"))
    _, without = C.backtest(frame, target, "main_cat", cap=300, rounds=4)
    return t.spark.createDataFrame([("with_volume", with_volume), ("without", without)], "variant string, objective double")


@query("joi_05_three_way", f"""with {_U}, a as (select distinct npath from u where visits >= 3), b as (select distinct npath from u where revenue > 30000), tr as (select npath, cast(sum(visits) as bigint) as visits from u group by 1)
  select case when a.npath is not null and b.npath is not null then 'kept' when b.npath is not null then 'added' when a.npath is not null then 'dropped' else 'neither' end as outcome, count(*) as urls, cast(coalesce(sum(visits), 0) as bigint) as visits from tr left join a using (npath) left join b using (npath) group by 1""")
def _(t):
    u = urls(t)
    return C.three_way(u.filter("visits >= 3"), u.filter("revenue > 30000"), u)


@query("joi_12_scalar_row", f"with {_U}, {_LIVE} select (select count(*) from live) as live, (select count(*) from u) as urls")
def _(t):
    from webinsight.operators.sets import scalar_row

    return scalar_row(live(t).distinct().agg(F.count("*").alias("live")), urls(t).agg(F.count("*").alias("urls")))
