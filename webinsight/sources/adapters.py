"""Adapters: pure projections that shape the star-schema tables into the inputs of the operators.

The text of an adapter is valid in Spark SQL and in DuckDB alike, so a query and its oracle start from the same rows.
{name} stands for a base table or another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")

ADAPTERS = {
    "v_visits": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey,
          cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) as bigint) as date_key,
          replace(lower(p_brand), '#', '_') as main_cat,
          replace(lower(p_brand), '#', '_') || '_' || lower(p_type) as deepest_cat,
          o_orderpriority as channel,
          cast(cast(l_extendedprice as decimal(12,2)) * cast(1 - l_discount as decimal(4,2)) as decimal(16,4)) as revenue,
          cast(l_quantity as bigint) as clicks,
          l_returnflag = 'R' as noprod,
          'https://www.shop.example/products/' || replace(lower(p_brand), '#', '_') || '/' || replace(lower(p_brand), '#', '_') || '_' || lower(p_type) ||
            case when p_size % 7 = 0 then '/r/' || replace(p_name, ' ', '_') || '/'
                 when p_size % 5 = 0 then '/'
                 else '/c/line~' || l_linestatus || '~~color_' || split_part(p_name, ' ', 1) || '~' || cast(p_size as string)
                   || case when p_size % 3 = 0 then '~~size~' || cast(p_size as string) else '' end
                   || case when l_quantity >= 49 then '~~bulk~1' else '' end
                   || case when l_linenumber = 7 and l_quantity < 6 then '~~rare~1' else '' end end
            || case when l_linenumber = 3 then '?utm_source=x' else '' end as url
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey""",
    "v_clicks": """
        select l_orderkey, l_linenumber,
          cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as bigint) as date_key,
          o_orderpriority as channel,
          cast(cast(l_extendedprice as decimal(12,2)) * cast(1 - l_discount as decimal(4,2)) as decimal(16,4)) as revenue,
          case when l_linestatus = 'F' then 1 else 0 end as actual_ind,
          case when l_tax > 0.07 then 1 else 0 end as deleted_ind,
          case l_returnflag when 'R' then 'rejected_click' when 'A' then 'cpa' else 'ww' end as label,
          replace(lower(p_brand), '#', '_') as main_cat, replace(lower(p_brand), '#', '_') || '_' || lower(p_type) as deepest_cat
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey""",
    "v_cats": """
        select distinct replace(lower(p_brand), '#', '_') || '_' || lower(p_type) as deepest_cat, replace(lower(p_brand), '#', '_') as main_cat, true as is_lowest
        from {part}""",
    "v_settings": """
        select deepest_cat, slug,
          case (length(deepest_cat) + length(slug)) % 3 when 0 then true when 1 then false else cast(null as boolean) end as seo_prio
        from {v_cats} cross join (
          select 'line' as slug union all select 'size' union all select 'bulk' union all select 'rare'
          union all select distinct 'color_' || split_part(p_name, ' ', 1) from {part}) s""",
    "v_hits": """
        select event_id, user_id, ts, cast(ts as date) as log_date, k,
          case event_type when 'view' then 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://bot.test)' when 'click' then 'Mozilla/5.0 GPTBot/1.2'
            when 'purchase' then 'Mozilla/5.0 (compatible; claudebot/1.0)' when 'signup' then 'Mozilla/5.0 (compatible; bingbot/2.0)'
            else 'Mozilla/5.0 (X11; Linux x86_64) Firefox/120.0' end as ua,
          case user_id % 3 when 0 then 'www.shop.example' when 1 then 'm.shop.example' else 'other.test' end as host,
          case when k % 10 = 0 then '/' when k % 10 = 1 then '/p/' || cast(k as string) || '/' when k % 10 = 2 then '/products/c' || cast(user_id % 10 as string) || '/r/term_' || cast(k as string) || '/'
            when k % 10 = 3 then '/products/c' || cast(user_id % 10 as string) || '/' when k % 10 = 4 then '/robots.txt' when k % 10 = 5 then '/info/help'
            else '/products/c' || cast(user_id % 10 as string) || '/c/k~' || cast(k as string) || case when k % 4 = 0 then '~~size~' || cast(user_id % 7 as string) else '' end end as path,
          case cast(floor(value) as bigint) % 5 when 0 then '200' when 1 then '301' when 2 then '404' when 3 then '503' else '-' end as status,
          case k % 3 when 0 then 'Hit' when 1 then 'Miss' else 'RefreshHit' end as edge_result,
          case when k % 17 = 0 then '-' else cast(cast(floor(value * 100) as bigint) as string) end as bytes,
          case when k % 19 = 0 then 'bad' else cast(cast(value as decimal(12,2)) as string) end as time_taken,
          case when k % 23 = 0 then '-' when k % 3 = 0 then '2001:db8:' || lower(hex(user_id % 16)) || '::' || lower(hex(k))
            when k % 6 = 1 then '2001:DB8:' || hex(user_id % 16) || ':0:0:0:66.0.0.' || cast(k as string)
            else '66.' || cast(cast(floor(user_id / 100.0) as bigint) % 256 as string) || '.' || cast(user_id % 100 as string) || '.' || cast(k as string) end as ip
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from {events}) e""",
    "v_known": """
        select min(event_id) as url_id, case when path = '/' then '/' else regexp_replace(path, '/+$', '') end as url from {v_hits} where k % 7 = 0 group by 2""",
    "v_ranges": """
        select case n_regionkey when 0 then 'google' when 1 then 'openai' else 'other' end as operator,
          case n_nationkey % 5 when 0 then '66.' || cast(cast(floor(n_nationkey / 10.0) as bigint) as string) || '.' || cast(n_nationkey * 4 as string) || '.0/22'
            when 1 then '2001:db8:' || lower(hex(n_nationkey % 16)) || '::/48' when 2 then '2001:DB8:' || hex(n_nationkey % 16) || '::/122'
            when 3 then '66.0.' || cast(n_nationkey * 4 as string) || '.1/22' else '66.0.' || cast(n_nationkey * 3 as string) || '.0/255.255.255.0' end as cidr
        from {nation}""",
    "v_ledger": """
        select log_date, count(distinct hour(ts)) as hours_present, count(*) as raw_lines, count(distinct user_id % 5) as files, 5 as expected_files,
          cast(sum(case when ua like '%Firefox%' then 0 else 1 end) as bigint) as bot_lines, 0 as failed_files
        from {v_hits} group by log_date""",
    "v_shops": """
        select s_suppkey as shop_id, s_name as shop_name, day as data_day,
          case when (s_suppkey + day) % 4 = 0 then 1 else 0 end as linkage, case when (s_suppkey + day) % 3 = 0 then 1 else 0 end as is_nl,
          case when (s_suppkey * 3 + day) % 5 = 0 then 1 else 0 end as is_be, case when s_acctbal < 0 then 'cpc' else 'cpa' end as model
        from {supplier} cross join (select 1 as day union all select 2 union all select 3 union all select 4 union all select 5 union all select 6
          union all select 7 union all select 8 union all select 9 union all select 10) d""",
    "v_actions": """
        select event_id, user_id as shop_id, case user_id % 2 when 0 then 'NL' else 'BE' end as country, case event_type when 'signup' then 'Paused' else 'Enabled' end as action, ts as created_at
        from {events} where event_type in ('signup', 'error')""",
    "v_items": """
        select cast(p_partkey as string) as item_id, 'acc_' || cast(s_nationkey % 5 as string) as account, 'shop_' || cast(s_suppkey as string) as shop,
          'label_' || l_returnflag as label, 'camp_' || lower(p_brand) as campaign, cast(l_quantity as bigint) as clicks,
          cast(l_extendedprice as decimal(12,2)) as value, cast(l_extendedprice * l_discount as decimal(14,4)) as cost, l_suppkey as shop_id, l_linenumber
        from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey""",
    "v_content": """
        select doc_id as url_id, '/products/' || source || '/' || source || '_' || lang || '/c/id~' || cast(doc_id as string) as url, text as content, lang <> 'en' as has_faq, md5(text) as content_md5,
          case when doc_id % 3 = 0 then cast(null as string) when doc_id % 5 = 0 then md5('stale' || cast(doc_id as string)) else md5(text) end as pushed_md5,
          case doc_id % 6 when 0 then 'pending' when 1 then 'failed' when 2 then cast(null as string) else 'done' end as status, source, lang, n_chars
        from {documents}""",
    "v_redirects": """
        select '/p/' || cast(c_custkey as string) || '/' as from_url,
          case when c_custkey % 97 = 0 then '/p/' || cast(c_custkey + 1 as string) || '/' when c_custkey % 97 = 1 and c_custkey > 1 then '/p/' || cast(c_custkey - 1 as string) || '/'
            else '/p/' || cast(cast(floor(c_custkey / 2.0) as bigint) as string) || '/' end as to_url, c_custkey as seq
        from {customer} where c_custkey % 3 <> 2""",
    "v_keywords": """
        select lower(p_name) as keyword, cast(max(p_size) * 100 as bigint) as volume from {part} group by lower(p_name)""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", ADAPTERS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or an adapter over base tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(ADAPTERS[name], **{n: table(spark, sf_dir, n) for n in _needs(name)})


def oracle(sql: str) -> str:
    """sql with the adapters that it names as common table expressions in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _needs(name):
            if n in ADAPTERS:
                add(n)
        if name not in order:
            order.append(name)

    for name in ADAPTERS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    ctes = [f"{n} as ({re.sub(r'[{}]', '', ADAPTERS[n])})" for n in order]
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(ctes) + ", " + body[len("with recursive") :]
    if body.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return "with " + ", ".join(ctes) + " " + body
