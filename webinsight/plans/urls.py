"""Queries of the URL, redirect and validation operators."""

from pyspark.sql import functions as F

from webinsight.functions import norm
from webinsight.operators import redirects as R

from .registry import query

_PATH = "split_part(regexp_replace(url, '^https?://[^/]+', '', 'i'), '?', 1)"
_CANON = f"case when {_PATH} like '/%' then case when contains({_PATH}, '/c/') then rtrim({_PATH}, '/') when {_PATH} like '%/' then {_PATH} else {_PATH} || '/' end end"
_RAW = "split_part(url, '?', 1)"
_SORTED = lambda u: f"case when contains({u}, '/c/') then split_part({u}, '/c/', 1) || '/c/' || array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(lower(rtrim(split_part({u}, '/c/', 2), '/')), '~~'), lambda x: x <> ''), lambda x, i: struct_pack(name := split_part(x, '~', 1), i := i, x := x))), lambda s: s.x), '~~') else {u} end"
_URLS = "u as (select distinct url from v_visits)"


def urls(t):
    return t("v_visits").select("url").distinct()


@query("url_01_normal_forms", f"with {_URLS} select url, rtrim(split_part(split_part(lower(regexp_replace(url, '^https?://[^/]+', '', 'i')), '?', 1), '#', 1), '/') as npath, {_CANON} as canonical, replace(replace(url, '_', ' '), '+', ' ') as equiv, cast(len(list_distinct([url, replace(url, '_', ' '), replace(replace(url, '_', ' '), ' ', '_'), replace(replace(url, '_', ' '), ' ', '+'), replace(replace(url, '_', ' '), ' ', '%20')])) as int) as n_variants from u")
def _(t):
    u = F.col("url")
    return urls(t).select("url", norm.npath(u).alias("npath"), norm.canonical_url(u, None).alias("canonical"), norm.equiv_key(u).alias("equiv"), F.size(norm.url_variants(u)).alias("n_variants"))


@query("url_01_collisions", f"with {_URLS} select {_CANON} as canonical, count(*) as n_raw, min(url) as example from u group by 1")
def _(t):
    return R.normalize_report(t("v_visits"))


@query("url_02_facet_order", f"with u as (select distinct {_RAW} as url from v_visits), s as (select url as u, {_SORTED('url')} as sorted from u) select * from s where u <> sorted")
def _(t):
    return R.facet_order_audit(t("v_visits"))


_STRIP = "case when left(url, 4) = 'http' then split_part(regexp_replace(url, '^https?://[^/]*', ''), '?', 1) else url end"


@query("url_03_strip_domain", f"with x as (select url_id, case url_id % 3 when 0 then 'https://www.shop.example' || url || '?a=1' when 1 then url else '/' end as url, case url_id % 4 when 0 then 'NL+BE' when 1 then 'be' when 2 then 'nl' else null end as c from v_content) select url_id, {_STRIP} as path, {_STRIP} = '/' as home, case url_id % 4 when 0 then 'nl, be' when 1 then 'be' else 'nl' end as country from x")
def _(t):
    n = F.col("url_id")
    x = t("v_content").select("url_id", F.when(n % 3 == 0, F.concat(F.lit("https://www.shop.example"), "url", F.lit("?a=1"))).when(n % 3 == 1, F.col("url")).otherwise("/").alias("url"), F.when(n % 4 == 0, "NL+BE").when(n % 4 == 1, "be").when(n % 4 == 2, "nl").alias("c"))
    return x.select("url_id", R.strip_domain(F.col("url")).alias("path"), R.is_homepage(F.col("url")).alias("home"), R.country(F.col("c")).alias("country"))


@query("url_04_parse_search", """with u as (select distinct split_part(regexp_replace(url, '^https?://[^/]+', ''), '?', 1) as p, url from v_visits) select url, case when regexp_matches(p, '^/products/[^/]+/[^/]+/r/[^/]+/?$') then 'sub' else 'invalid' end as kind, nullif(regexp_extract(p, '^/products/([^/]+)/([^/]+)/r/([^/]+)/?$', 1), '') as main,
  nullif(regexp_extract(p, '^/products/([^/]+)/([^/]+)/r/([^/]+)/?$', 2), '') as sub, lower(replace(nullif(regexp_extract(p, '^/products/([^/]+)/([^/]+)/r/([^/]+)/?$', 3), ''), '_', ' ')) as keyword from u""")
def _(t):
    return R.parse_search(urls(t)).drop("facets")


@query("url_05_category_parts", f"with {_URLS}, p as (select url, list_filter(string_split(split_part({_PATH}, '/c/', 1), '/'), lambda x: x <> '') as parts from u) select url, parts[2] as main, parts[3] as sub, list_filter(string_split(parts[3], '_'), lambda x: regexp_matches(x, '^[0-9]+$'))[-1] as sub_id from p")
def _(t):
    return urls(t).select("url", *(c.alias(k) for k, c in R.category_parts(F.col("url")).items()))


@query("url_06_keeps_facets", f"with u as (select distinct {_RAW} as url from v_visits where contains(url, '/c/')) select url, list_contains(string_split(split_part(url, '/c/', 2), '~~'), 'line~O') and list_contains(string_split(split_part(url, '/c/', 2), '~~'), 'bulk~1') as keeps from u")
def _(t):
    u = t("v_visits").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url")).filter(F.col("url").contains("/c/")).distinct()
    return u.select("url", R.keeps_facets(F.array(F.lit("line~O"), F.lit("bulk~1")), F.split(F.split_part("url", F.lit("/c/"), F.lit(2)), "~~")).alias("keeps"))


_LINKS = "links as (select page_id, rtrim(split_part(split_part(regexp_replace(raw, '^https?://[^/]+', '', 'i'), '?', 1), '#', 1), ',') as href from (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) as raw from pages))"


@query("url_07_link_graph", f"with {_LINKS} select href, count(*) as in_links, count(distinct page_id) as pages from links group by 1")
def _(t):
    return R.link_graph(t("pages")).groupBy("href").agg(F.count("*").alias("in_links"), F.count_distinct("page_id").alias("pages"))


@query("url_08_canonical_tags", "select page_id, cast(null as varchar) as canonical, regexp_extract(html, '<title>(.*?)</title>', 1) as title from pages")
def _(t):
    return R.canonical_tags(t("pages"))


_RULES = [
    {"kind": "cat_cat", "old": "brand_1", "new": "brand_one"},
    {"kind": "facet_facet", "old": "line~F", "new": "line~final"},
    {"kind": "cat_facet", "cat": "brand_2", "old": "bulk~1", "new": "bulk~yes"},
    {"kind": "remove_bucket"},
]


@query("url_10_canonical_rules", f"""with a as (select distinct url, {_RAW} as raw from v_visits), b as (select url, raw, case when contains(raw, '/brand_1/') then replace(raw, '/brand_1/', '/brand_one/') else raw end as x from a),
  c as (select url, raw, case when contains(raw, 'line~F') then replace(x, 'line~F', 'line~final') else x end as x from b), d as (select url, raw, case when contains(raw, '/brand_2/') and contains(raw, 'bulk~1') then replace(x, 'bulk~1', 'bulk~yes') else x end as x from c),
  e as (select url, raw, lower(case when contains(raw, '/r/') then regexp_replace(x, '/r/[^/]+', '') else x end) as x from d) select url, {_SORTED('x')} as new_url, {_SORTED('x')} <> raw as changed from e""")
def _(t):
    return R.apply_rules(urls(t), _RULES)


#: A rule for every colour and size that parts have, two of every brand, and one that takes search buckets away.
_RULE_ROWS = """select 'cat_cat' as kind, cast(null as varchar) as cat, main_cat as old, main_cat || '_new' as new from (select distinct main_cat from v_cats)
  union all select 'facet_facet', null, 'color_' || c || '~' || s, 'tint_' || c || '~' || s from (select distinct split_part(p_name, ' ', 1) as c, p_size as s from part where p_size % 2 = 0)
  union all select 'cat_facet', main_cat, 'bulk~1', 'amount_' || main_cat || '~1' from (select distinct main_cat from v_cats)
  union all select 'cat_facet_remove', main_cat, 'rare', null from (select distinct main_cat from v_cats where main_cat > 'brand_3') union all select 'remove_bucket', null, null, null"""


@query("url_10_rule_table", f"""with u as (select distinct url, {_RAW} as raw from v_visits), r as (select *, list_position(['cat_cat', 'facet_facet', 'cat_facet', 'cat_facet_remove', 'bucket_bucket', 'remove_bucket'], kind) as family from ({_RULE_ROWS})),
  seg as (select url, raw, unnest(list_distinct(string_split(raw, '/'))) as piece from u), tok as (select url, raw, unnest(list_distinct(string_split(split_part(raw, '/c/', 2), '~~'))) as piece from u),
  m as (select url, raw, r.* from seg join r on (kind = 'cat_cat' and old = piece) union all select url, raw, r.* from seg join r on kind in ('cat_facet', 'cat_facet_remove') and cat = piece and contains(raw, old)
    union all select url, raw, r.* from u join r on kind = 'remove_bucket' and contains(raw, '/r/')
    union all select url, raw, r.* from tok join r on kind = 'facet_facet' and starts_with(piece, old)),
  l as (select url, any_value(raw) as raw, list({{kind: kind, old: old, new: new}} order by family, coalesce(cat, '') || '|' || coalesce(old, '')) as rules from m group by 1),
  f as (select url, raw, rules, 0 as k, raw as x from l union all select url, raw, rules, k + 1, case rules[k + 1].kind when 'cat_cat' then replace(x, '/' || rules[k + 1].old || '/', '/' || rules[k + 1].new || '/') when 'remove_bucket' then regexp_replace(x, '/r/[^/]+', '', 'g')
    when 'cat_facet_remove' then regexp_replace(x, rules[k + 1].old || '[^~/]*(~[^~/]+)?(~~)?', '', 'g') else replace(x, rules[k + 1].old, rules[k + 1].new) end from f where k < len(rules)),
  d as (select u.url, u.raw, regexp_replace(regexp_replace(lower(coalesce(x, u.raw)), '([^:])//+', '\\1/', 'g'), '(~~)+$|/c/?$', '', 'g') as y from u left join (select * from f where k = len(rules)) g using (url))
  select url, {_SORTED('y')} as new_url, {_SORTED('y')} <> raw as changed from d""".replace("with u as", "with recursive u as", 1))
def _(t):
    rules = t.spark.sql(_RULE_ROWS.replace("varchar", "string").replace("from part", "from {part}").replace("from v_cats", "from {v_cats}"), part=t("part"), v_cats=t("v_cats"))
    return R.apply_rule_table(urls(t), rules.withColumn("seq", F.concat_ws("|", F.coalesce("cat", F.lit("")), F.coalesce("old", F.lit("")))))


@query("url_11_rewrite", f"""with a as (select distinct url, {_RAW} as raw from v_visits), b as (select url, raw, replace(raw, '/brand_3/', '/brand_three/') as x from a), c as (select url, raw, case when contains(x, '/c/') then split_part(x, '/c/', 1) || '/c/' || array_to_string(list_transform(string_split(split_part(x, '/c/', 2), '~~'), lambda y: case when y = 'bulk~1' then 'amount~9' else y end), '~~') else x end as x from b)
  select url, {_SORTED('x')} as new_url, {_SORTED('x')} <> raw as changed from c""")
def _(t):
    return R.rewrite(urls(t), {"brand_3": "brand_three"}, {"bulk~1": "amount~9"})


_CHAIN = """with recursive e as (select from_url, max_by(to_url, seq) as to_url from v_redirects group by 1), walk as (select c_custkey as pos, '/p/' || c_custkey || '/' as new, '/p/' || c_custkey || '/' as final, ['/p/' || c_custkey || '/'] as seen, 0 as n from customer
  union all select pos, new, to_url, list_append(seen, to_url), n + 1 from walk join e on from_url = final where n < 6 and not list_contains(seen, to_url)),
  done as (select pos, new, arg_max(final, n) as final, max(n) as n_hops from walk group by all)"""


@query("url_12_resolve_redirects", f"{_CHAIN} select pos, new, final, cast(n_hops as bigint) as n_hops, case when n_hops > 0 then new end as flatten_from from done")
def _(t):
    rows = t("customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("/p/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("new"))
    return R.resolve(rows, t("v_redirects"))


@query("url_13_preflight", f"""{_CHAIN}, b as (select pos, case pos % 11 when 0 then '' when 1 then '/' when 2 then '/products/a/c/k~1+2' when 3 then '/p/' || pos || '/' when 4 then new when 5 then '/old/same/' else '/old/' || pos || '/' end as old, new, final, n_hops from done),
  c as (select b.*, e.to_url as existing, row_number() over (partition by replace(replace(old, '_', ' '), '+', ' ') order by pos) as dup from b left join e on e.from_url = old),
  d as (select *, case when old = '' then 'missing URL' when old = '/' then 'homepage (blocked)' when contains(old, '+') then 'multi-value facet (no-index)' when existing is not null and existing = final then 'already redirected' when existing is not null then 'source has existing rule'
    when old = final then 'self redirect' when dup > 1 then 'duplicate in batch' end as r from c)
  select pos, old, final, 'nl' as country, 301 as status, case when n_hops > 0 then new end as flatten_from, case when r is null and final in (select old from d where r is null) then 'target is batch source' else r end as skip_reason from d""")
def _(t):
    n, p = F.col("c_custkey"), F.concat(F.lit("/p/"), F.col("c_custkey").cast("string"), F.lit("/"))
    old = F.when(n % 11 == 0, "").when(n % 11 == 1, "/").when(n % 11 == 2, "/products/a/c/k~1+2").when((n % 11 == 3) | (n % 11 == 4), p).when(n % 11 == 5, "/old/same/").otherwise(F.concat(F.lit("/old/"), n.cast("string"), F.lit("/")))
    rows = t("customer").select(n.alias("pos"), old.alias("old"), p.alias("new"), F.lit("NL").alias("country"), F.lit("301").alias("status"))
    return R.preflight(rows, t("v_redirects"))


_BAD = """bad as (select distinct case clicks % 9 when 0 then replace(url, '/products/', '/products/products/') || '#x' when 1 then upper(url) when 2 then replace(url, '/brand_1/', '/brand_9/') when 3 then replace(url, '/products/brand_1', '/products/shoes') when 4 then replace(url, '/brand_2_', '/lost_2_') else url end as url from v_visits)"""


def _bad(t):
    n = F.col("clicks") % 9
    to = lambda a, b: F.replace("url", F.lit(a), F.lit(b))
    url = F.when(n == 0, F.concat(to("/products/", "/products/products/"), F.lit("#x"))).when(n == 1, F.upper("url")).when(n == 2, to("/brand_1/", "/brand_9/")).when(n == 3, to("/products/brand_1", "/products/shoes")).when(n == 4, to("/brand_2_", "/lost_2_")).otherwise(F.col("url"))
    return t("v_visits").select(url.alias("url"))


def _taxonomy(t):
    """Categories, linked facets and facet values, with their flags."""
    cats = t("v_cats").withColumn("enabled", F.length("deepest_cat") % 7 != 0)
    settings = t("v_settings").filter("slug <> 'rare'").withColumns({"enabled": F.col("seo_prio").isNull() | F.col("seo_prio"), "noindex": F.length("slug") % 5 == 0})
    values = t("part").select(F.explode(F.array(F.lit("size"), F.concat(F.lit("color_"), F.split_part("p_name", F.lit(" "), F.lit(1))))).alias("slug"), F.col("p_size").cast("long").alias("value_id")).filter("value_id % 10 <> 0").distinct()
    return cats, settings, values.withColumn("seo", F.col("value_id") % 4 != 0)


def _checked(t):
    return R.validate(_bad(t), *_taxonomy(t))


@query("url_14_validate")
def _(t):
    return _checked(t)


@query("url_14_taxonomy", f"""with {_BAD}, p as (select url, string_split(regexp_replace(split_part(url, '?', 1), '^[hH][tT][tT][pP][sS]?://[^/]+', ''), '/c/') as halves from bad),
  q as (select url, list_filter(string_split(halves[1], '/'), lambda x: x <> '') as parts, contains(split_part(url, '?', 1), '/c/') as has, split_part(url, '?', 1) as u from p),
  r as (select url, lower(parts[2]) as main, lower(parts[3]) as sub, case when has then list_filter(list_transform(string_split(split_part(u, '/c/', 2), '~~'), lambda x: {{'slug': lower(split_part(trim(x, '/'), '~', 1)), 'value': split_part(split_part(trim(x, '/'), '~', 2), '/', 1)}}), lambda y: y.slug <> '' and y.value <> '') else [] end as pairs from q),
  k as (select r.*, c.main_cat as true_main, length(c.deepest_cat) % 7 <> 0 as cat_on, case when main is null then 'NO_MAINCAT' when main not in (select main_cat from v_cats) then 'MAINCAT_NOT_FOUND' when sub is not null and c.main_cat is null then 'CATEGORY_NOT_FOUND' end as stop
    from r left join v_cats c on c.deepest_cat = sub),
  f as (select url, coalesce(sub, main) as level, unnest(pairs) as p, unnest(range(len(pairs))) as pos from k where stop is null),
  vals as (select distinct slug, p_size as value_id from (select p_size, unnest(['size', 'color_' || split_part(p_name, ' ', 1)]) as slug from part) where p_size % 10 <> 0),
  g as (select url, pos, s.slug is not null as linked, s.seo_prio is not null and not s.seo_prio as off, length(f.p.slug) % 5 = 0 as hide, case when try_cast(f.p.value as bigint) is null then 'INVALID_VALUE_ID' when v.value_id is null then 'VALUE_NOT_FOUND' end as bad, v.value_id % 4 = 0 as low
    from f left join (select * from v_settings where slug <> 'rare') s on s.deepest_cat = f.level and s.slug = f.p.slug left join vals v on v.slug = f.p.slug and v.value_id = try_cast(f.p.value as bigint)),
  e as (select url, flatten(list(case when not linked then ['FACET_NOT_LINKED'] else list_filter([case when off then 'FACET_DISABLED' end, case when hide then 'FACET_NOINDEX' end, bad, case when bad is null and low then 'VALUE_LOW_SEO_PRIORITY' end], lambda x: x is not null) end order by pos)) as codes, count(*) filter (linked and bad is null) as valid from g group by url)
  select url, main, sub, true_main, list_concat(list_filter([stop, case when stop is null and true_main <> main then 'HIERARCHY_MISMATCH' end, case when stop is null and not cat_on then 'CATEGORY_DISABLED' end], lambda x: x is not null), coalesce(codes, [])) as tax,
    cast(coalesce(valid, 0) as bigint) as facets_valid, cast(len(pairs) as bigint) as facets_total from k left join e using (url)""")
def _(t):
    return R.taxonomy_issues(_bad(t), *_taxonomy(t))


@query("url_14_structural", "select url, list_filter([case when contains(url, '?utm_') then 'TRACKING_PARAMS' end, case when list_has_any(string_split(split_part(split_part(url, '?', 1), '/c/', 2), '~~'), ['x~']) then 'EMPTY_FACET_VALUE' end, case when regexp_matches(url, '/c/line~[A-Z]') then 'UPPERCASE_IN_PATH' end, case when contains(url, '/r/') then 'HAS_BUCKET' end], lambda x: x is not null) as issues from (select distinct url from v_visits)")
def _(t):
    return urls(t).select("url", R.structural_issues(F.col("url")).alias("issues"))


@query("url_15_suggest")
def _(t):
    return R.suggest(_checked(t))


@query("url_16_check_links", """with p as (select s_nationkey as category, s_suppkey as product_id, case s_suppkey % 4 when 0 then 'moved' when 1 then 'gone' else 'live' end as state, case when s_suppkey % 8 = 0 then s_suppkey + 1 end as new_id from supplier),
  l as (select distinct l_orderkey as content_id, s_nationkey as category, l_suppkey + l_linenumber % 2 * 3 as product_id from lineitem join supplier on l_suppkey = s_suppkey), r as (select content_id, case when state is null then 'unknown' when state = 'moved' and new_id is not null then 'replaced' when state = 'live' then 'valid' else 'gone' end as res from l left join p using (category, product_id))
  select content_id, count(*) filter (res = 'valid') as valid, count(*) filter (res = 'replaced') as replaced, count(*) filter (res = 'gone') as gone, count(*) filter (res = 'unknown') as unknown from r group by 1""")
def _(t):
    k = F.col("s_suppkey")
    products = t("supplier").select(F.col("s_nationkey").alias("category"), k.alias("product_id"), F.when(k % 4 == 0, "moved").when(k % 4 == 1, "gone").otherwise("live").alias("state"), F.when(k % 8 == 0, k + 1).alias("new_id"))
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == k).select(F.col("l_orderkey").alias("content_id"), F.col("s_nationkey").alias("category"), (F.col("l_suppkey") + F.col("l_linenumber") % 2 * 3).alias("product_id"))
    content = rows.groupBy("content_id", "category").agg(F.collect_list("product_id").alias("ids"))
    return R.check_links(content, products)


@query("url_16_rewrite_links", "select s_suppkey as content_id, 'see [' || case when s_suppkey % 8 = 0 then s_suppkey + 1 else s_suppkey end || '] and [7]' as text from supplier")
def _(t):
    k = F.col("s_suppkey")
    products = t("supplier").select(F.col("s_nationkey").alias("category"), k.alias("product_id"), F.when(k % 4 == 0, "moved").otherwise("live").alias("state"), F.when(k % 8 == 0, k + 1).alias("new_id"))
    content = t("supplier").select(k.alias("content_id"), F.col("s_nationkey").alias("category"), F.concat(F.lit("see ["), k.cast("string"), F.lit("] and [7]")).alias("text"), F.array(k, F.lit(7).cast("long")).alias("ids"))
    return R.rewrite_links(content, products)
