"""Queries of the crawler-log operators."""

from pyspark.sql import functions as F

from webinsight.functions.agents import FAMILIES, NAMES, classify_agents
from webinsight.functions.norm import log_stem
from webinsight.operators import logs as L
from webinsight.operators.common import stage

from .registry import query

_q = lambda s: s.replace("'", "''")
_FAMILY = "case " + " ".join(f"when regexp_matches(ua, '(?i){_q(p)}') then '{_q(n)}'" for n, _, p in FAMILIES) + " end"
_CLASS = "case fam " + " ".join(f"when '{_q(n)}' then '{c}'" for n, c, _ in FAMILIES) + " end"
_NAME = "case lower(regexp_extract(ua, '(?i)(" + "|".join(sorted(NAMES, key=len, reverse=True)) + ")', 1)) " + " ".join(f"when '{n.lower()}' then '{n}'" for n in NAMES) + " else fam end"
_TYPE = """case when contains(p, '/r/') then 'search' when p like '/p/%' then 'product' when p like '/products/%' and contains(p, '/c/') then 'category_facet' when p like '/products/%' then 'category'
  when p like '/categories/%' then 'category_legacy' when p like '/sitemap%' then 'sitemap' when p = '/' then 'home' when p like '/robots.txt%' then 'robots' when p like '/info/%' or p like '/service%' then 'info'
  when p like '/l/%' then 'list' when regexp_matches(p, '^/[a-z0-9_-]+/d[0-9]{6,}/') then 'product_legacy' else 'other' end"""
_BUCKET = "case url_type " + " ".join(f"when '{raw}' then '{name}'" for name, raws in L.BUCKETS for raw in raws) + " else 'Other' end"
_DEPTH = "case when contains(p, '/c/') and trim(substr(p, instr(p, '/c/') + 3), '/') <> '' then cast(len(string_split(trim(substr(p, instr(p, '/c/') + 3), '/'), '~~')) as int) else 0 end"
_STATUS = "case when regexp_matches(status, '^[0-9]') then status[1] || 'xx' else '?' end"
_PARSED = f"""parsed as (
  select event_id, log_date, host, fam as bot_family, {_CLASS} as bot_class, p as path, {_TYPE} as url_type, {_DEPTH} as facet_depth, status, {_STATUS} as status_class, edge_result,
    coalesce(try_cast(bytes as bigint), 0) as bytes, coalesce(cast(trunc(try_cast(time_taken as decimal(18,6)) * 1000) as bigint), 0) as time_ms, ip
  from (select *, {_FAMILY} as fam, case when rtrim(path, '/') = '' then '/' else rtrim(path, '/') end as p from
    (select * replace (case when lower(host) like 'www.%' then substr(lower(host), 5) else lower(host) end as host) from v_hits) h where host = 'shop.example' or host like '%.shop.example') x where fam is not null)"""
_KNOWN = "knownu as (select max(url_id) as url_id, case when rtrim(url, '/') = '' then '/' else rtrim(url, '/') end as url from v_known group by 2)"
_OP = "case bot_family when 'Googlebot' then 'google' when 'OpenAI' then 'openai' when 'Bing' then 'bing' end"
_DOT = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_H4 = lambda x: f"array_to_string(list_transform(string_split({x}, '.'), lambda o: lpad(lower(hex(cast(o as integer))), 2, '0')), '')"
_HALF = lambda x: f"list_transform(list_filter(string_split({x}, ':'), lambda g: g <> ''), lambda g: lpad(lower(g), 4, '0'))"
_DIGIT = "instr('0123456789abcdef', substr(key, p // 4 + 2, 1)) - 1"
_NETS = f"""addr as (select x, case when regexp_full_match(x, '{_DOT}') then '4' || {_H4('x')} when contains(x, ':') then '6' || array_to_string(list_concat(a, list_resize(cast([] as varchar[]), 8 - len(a) - len(b), '0000'), b), '') end as key
    from (select x, {_HALF("split_part(y, '::', 1)")} as a, {_HALF("split_part(y, '::', 2)")} as b from (select x, case when t = '' then x else left(x, length(x) - length(t)) || substr({_H4('t')}, 1, 4) || ':' || substr({_H4('t')}, 5, 4) end as y
      from (select x, case when contains(x, ':') then regexp_extract(x, '{_DOT}$') else '' end as t from (select ip as x from parsed union select split_part(cidr, '/', 1) from v_ranges))))),
  nets as (select operator, rpad(left(key, p // 4 + 1) || case when p // 4 + 1 < length(key) then lower(hex(({_DIGIT}) // (16 >> (p % 4)) * (16 >> (p % 4)))) else '' end, cast(length(key) as integer), '0') as lo,
      rpad(left(key, p // 4 + 1) || case when p // 4 + 1 < length(key) then lower(hex(({_DIGIT}) // (16 >> (p % 4)) * (16 >> (p % 4)) + (16 >> (p % 4)) - 1)) else '' end, cast(length(key) as integer), 'f') as hi, key
    from (select operator, key, case when contains(m, '.') then cast(list_sum(list_transform(string_split(m, '.'), lambda o: bit_count(cast(o as integer)))) as integer) else cast(m as integer) end as p
      from (select operator, split_part(cidr, '/', 1) as x, split_part(cidr, '/', 2) as m from v_ranges) join addr using (x)))"""
_FULL = f"""{_PARSED}, {_KNOWN}, {_NETS}, full_hits as (
  select p.*, k.url_id, k.url_id is not null as is_known_url,
    case when {_OP} is null then 'unverifiable' when {_OP} not in (select operator from v_ranges) or a.key is null then 'unchecked'
      when exists (select 1 from nets r where r.operator = {_OP} and r.lo = r.key and a.key between r.lo and r.hi) then 'verified' else 'failed' end as verify_state
  from parsed p left join addr a on a.x = p.ip left join knownu k on k.url = p.path)"""
_CUBE = f"""{_FULL}, cube as (select log_date, host, bot_family, url_type, facet_depth, is_known_url, status_class, edge_result, verify_state, count(*) as hits,
  cast(sum(bytes) as bigint) as bytes, cast(sum(time_ms) as bigint) as sum_time_ms from full_hits group by all)"""
_DAILY = f"""{_FULL}, url_daily as (select log_date, url_id, host, bot_family, count(*) as hits, cast(sum(bytes) as bigint) as bytes, count(*) filter (status_class = '2xx') as n_2xx, count(*) filter (status_class = '3xx') as n_3xx,
  count(*) filter (status_class = '4xx') as n_4xx, count(*) filter (status_class = '5xx') as n_5xx from full_hits where is_known_url and bot_class in ('ai', 'search') group by all)"""
_UNKNOWN = """unknown_top as (select log_date, host, bot_family, path, hits from (select *, row_number() over (partition by log_date, bot_family order by hits desc, host desc, path desc) as rn from
  (select log_date, host, bot_family, path, count(*) as hits from full_hits where not is_known_url and bot_class in ('ai', 'search') and url_type not in ('product', 'product_legacy') group by all)) where rn <= 500)"""


def full(t):
    """Log rows are written first, as a log folder would hold them: what reads them has a small plan, however often it does."""
    return L.verify_ips(L.with_membership(L.parse_hits(stage(t("v_hits"), "hits")), stage(t("v_known"), "known")), t("v_ranges"))


def cube(t):
    return L.build_cube(full(t))


@query("log_01_classify_agent", f"select event_id, fam as bot_family, {_CLASS} as bot_class, case when fam is not null then {_NAME} end as bot_name from (select *, {_FAMILY} as fam from v_hits)")
def _(t):
    return classify_agents(t("v_hits")).select("event_id", "bot_family", "bot_class", "bot_name")


@query("log_02_url_type", f"select event_id, {_TYPE} as url_type from (select event_id, case when rtrim(path, '/') = '' then '/' else rtrim(path, '/') end as p from v_hits)")
def _(t):
    return t("v_hits").select("event_id", L.url_type(log_stem(F.col("path"))).alias("url_type"))


@query("log_03_url_type_bucket", f"select bucket, cast(list_position([{', '.join(repr(n) for n, _ in L.BUCKETS)}], bucket) as bigint) as place, count(*) as hits from (select {_BUCKET} as bucket from (select {_TYPE} as url_type from (select case when rtrim(path, '/') = '' then '/' else rtrim(path, '/') end as p from v_hits))) group by all")
def _(t):
    rows = t("v_hits").select(L.url_type_bucket(L.url_type(log_stem(F.col("path")))).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("hits")).withColumn("place", L.bucket_order(F.col("bucket")))


@query("log_04_facet_depth", f"select event_id, {_DEPTH} as facet_depth from (select event_id, path as p from v_hits)")
def _(t):
    return t("v_hits").select("event_id", L.facet_depth(F.col("path")).alias("facet_depth"))


@query("log_05_norm_host", "select host, keep, count(*) as n from (select case when host like 'www.%' then substr(host, 5) else host end as host, host = 'www.shop.example' or host like '%.shop.example' as keep from v_hits) group by all")
def _(t):
    rows = t("v_hits").select(L.norm_host(F.col("host")).alias("host"))
    return rows.withColumn("keep", L.keep_host(F.col("host"), ("shop.example",))).groupBy("host", "keep").agg(F.count("*").alias("n"))


@query("log_06_status_class", f"select {_STATUS} as status_class, count(*) as n from v_hits group by all")
def _(t):
    return t("v_hits").groupBy(L.status_class(F.col("status")).alias("status_class")).agg(F.count("*").alias("n"))


@query("log_07_lenient_numbers", "select event_id, coalesce(try_cast(bytes as bigint), 0) as bytes, coalesce(cast(trunc(try_cast(time_taken as decimal(18,6)) * 1000) as bigint), 0) as ms from v_hits")
def _(t):
    return t("v_hits").select("event_id", L.lenient_bytes(F.col("bytes")).alias("bytes"), L.lenient_ms(F.col("time_taken")).alias("ms"))


@query("log_08_filters", f"with {_CUBE} select bot_family, cast(sum(hits) as bigint) as hits from cube where host in ('shop.example', 'm.shop.example') and url_type in ('category_facet', 'category', 'category_legacy') and is_known_url group by all")
def _(t):
    return cube(t).filter(L.filters(host="shop.example, m.shop.example", kind="C-url,Cat-url", known="known")).groupBy("bot_family").agg(F.sum("hits").alias("hits"))


@query("log_09_search_terms", "select event_id, path from v_hits where contains(lower(path), 'products') and contains(lower(path), 'c1')")
def _(t):
    return t("v_hits").filter(L.search_terms(F.col("path"), "Products C1")).select("event_id", "path")


@query("log_10_cube", f"with {_CUBE} select * from cube")
def _(t):
    return cube(t)


@query("log_11_url_daily", f"with {_DAILY} select * from url_daily")
def _(t):
    return L.build_url_daily(full(t))


@query("log_12_unknown_top", f"with {_FULL}, {_UNKNOWN} select * from unknown_top")
def _(t):
    return L.build_unknown_top(full(t))


@query("log_13_daily_series", f"with {_CUBE} select log_date, {_BUCKET} as series, cast(sum(hits) as bigint) as hits from cube group by all")
def _(t):
    return L.daily_series(cube(t), "url_type")


@query("log_14_family_summary", f"""with {_CUBE} select bot_family, cast(sum(hits) as bigint) as hits, cast(sum(bytes) as bigint) as bytes, cast(sum(hits) filter (is_known_url) as bigint) as hits_known,
  {', '.join(f"cast(sum(hits) filter (status_class = '{n}xx') as bigint) as hits_{n}xx" for n in (2, 3, 4, 5))}, cast(sum(hits) filter (edge_result ilike 'hit%') as bigint) as cache_hits, count(distinct log_date) as days from cube group by all""")
def _(t):
    return L.family_summary(cube(t))


@query("log_15_crawl_waste", f"""with {_CUBE} select cast(coalesce(sum(hits) filter (c), 0) as bigint) as catalog_hits, cast(coalesce(sum(hits) filter (c and is_known_url), 0) as bigint) as catalog_known,
  round((1 - coalesce(sum(hits) filter (c and is_known_url), 0) / sum(hits) filter (c)) * 100, 1) as waste_pct from (select *, url_type in ('category_facet', 'category', 'category_legacy') as c from cube)""")
def _(t):
    return L.crawl_waste(cube(t))


@query("log_16_depth_split", f"with {_CUBE} select facet_depth, cast(sum(hits) as bigint) as hits, cast(sum(hits) filter (is_known_url) as bigint) as hits_known from cube where url_type in ('category_facet', 'category', 'category_legacy') group by all")
def _(t):
    return L.split_by(cube(t), "facet_depth")


@query("log_17_top_urls", f"""with {_DAILY}, {_UNKNOWN} select url, hits, is_known from (
  select k.url, cast(sum(d.hits) as bigint) as hits, true as is_known from url_daily d join knownu k using (url_id) group by k.url
  union all select path, cast(sum(hits) as bigint), false from unknown_top group by path) order by hits desc, url, is_known limit 50""")
def _(t):
    rows = full(t)
    return L.top_urls(L.build_url_daily(rows), L.build_unknown_top(rows), t("v_known"))


@query("log_18_url_detail", f"""with {_DAILY} select bot_family, log_date, cast(sum(hits) as bigint) as hits, cast(sum(n_2xx) as bigint) as n_2xx, cast(sum(hits - n_2xx - n_3xx - n_4xx - n_5xx) as bigint) as n_other,
  count(distinct log_date) as days_seen, cast(grouping_id(bot_family, log_date) as bigint) as level from url_daily where url_id in (select url_id from v_known where contains(url, '/c/')) group by grouping sets ((bot_family), (log_date), ())""")
def _(t):
    return L.url_detail(L.build_url_daily(full(t)), t("v_known").filter(F.col("url").contains("/c/")))


@query("log_19_coverage", f"""with {_CUBE} select (select min(log_date) from cube) as first_day, (select max(log_date) from cube) as last_day, count(*) as days,
  count(*) filter (not (hours_present = 24 and failed_files = 0 and files >= expected_files)) as partial_days, cast(sum(raw_lines) as bigint) as raw_lines, cast(sum(bot_lines) as bigint) as bot_lines from v_ledger""")
def _(t):
    return L.coverage(cube(t), t("v_ledger"))


@query("joi_02_membership", f"with {_PARSED}, {_KNOWN} select event_id, url_id, url_id is not null as is_known_url from parsed left join knownu on url = path")
def _(t):
    return L.with_membership(L.parse_hits(t("v_hits")), t("v_known")).select("event_id", "url_id", "is_known_url")


@query("joi_03_verify_ip", f"with {_FULL} select event_id, verify_state from full_hits")
def _(t):
    return full(t).select("event_id", "verify_state")


@query("joi_08_preselect", f"with {_DAILY} select bot_family, cast(sum(hits) as bigint) as hits from url_daily where url_id in (select url_id from v_known where contains(url, 'products')) group by all")
def _(t):
    ids = t("v_known").filter(F.col("url").contains("products")).select("url_id")
    return L.build_url_daily(full(t)).join(ids, "url_id", "left_semi").groupBy("bot_family").agg(F.sum("hits").alias("hits"))
