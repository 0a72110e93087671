"""SQL functions for queries in text: temporary SQL UDFs, which Catalyst inlines."""

from pyspark.sql import SparkSession

FUNCTIONS = {
    "npath": ("url string", "string", "rtrim('/', split_part(split_part(lower(regexp_replace(url, '(?i)^https?://[^/]+', '')), '?', 1), '#', 1))"),
    "facet_depth": ("path string", "int", "case when instr(path, '/c/') > 0 and trim('/' from substring(path, instr(path, '/c/') + 3)) <> '' then size(split(trim('/' from substring(path, instr(path, '/c/') + 3)), '~~')) else 0 end"),
    "canon_key": ("k string", "string", "array_join(array_sort(filter(split(lower(k), '~'), x -> x <> '')), '~')"),
    "keyword_norm": ("k string", "string", "lower(trim(regexp_replace(regexp_replace(regexp_replace(k, '[-_]', ' '), '[^a-zA-Z0-9 ]', ''), ' +', ' ')))"),
    "url_type": ("p string", "string", "case when contains(p, '/r/') then 'search' when startswith(p, '/p/') then 'product' when startswith(p, '/products/') and contains(p, '/c/') then 'category_facet' when startswith(p, '/products/') then 'category' when startswith(p, '/categories/') then 'category_legacy' when startswith(p, '/sitemap') then 'sitemap' when p = '/' then 'home' when startswith(p, '/robots.txt') then 'robots' when startswith(p, '/info/') or startswith(p, '/service') then 'info' when startswith(p, '/l/') then 'list' when p rlike '^/[a-z0-9_-]+/d[0-9]{6,}/' then 'product_legacy' else 'other' end"),
    "canonical_url": ("url string", "string", "case when split_part(regexp_replace(url, '(?i)^https?://[^/]+', ''), '?', 1) like '/%' then case when contains(url, '/c/') then rtrim('/', split_part(regexp_replace(url, '(?i)^https?://[^/]+', ''), '?', 1)) else concat(rtrim('/', split_part(regexp_replace(url, '(?i)^https?://[^/]+', ''), '?', 1)), '/') end end"),
}


def register_sql(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    return list(FUNCTIONS)
