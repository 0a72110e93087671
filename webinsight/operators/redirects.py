"""URL rules, validation, redirect resolution, link checks: jobs over tables of URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webinsight.functions import norm
from webinsight.operators.common import look_up, stage

#: Fixed values.
HOME = ("", "/", "/index", "/index.html")
STATUS_CODES = (200, 301, 302, 303, 307, 308)
HOPS = 6


def strip_domain(url: Column) -> Column:
    s = F.split_part(F.split_part(F.trim(url), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    rest = F.regexp_replace(s, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    bare = s.rlike(r"^[^/]*\.[^/]*/")
    return (
        F.when(s == "", "")
        .when(s.startswith("/"), s)
        .when(s.contains("://"), F.when(rest == "", "/").otherwise(rest))
        .when(bare, F.regexp_replace(s, "^[^/]*", ""))
        .otherwise(F.concat(F.lit("/"), s))
    )


def is_homepage(url: Column) -> Column:
    p = norm.percent_decode(F.trim(strip_domain(url)))
    return p.isin(*HOME) | (norm.strip_trailing(p) == "")


def has_multi_value(url: Column) -> Column:
    """A plus behind /c/."""
    p = norm.percent_decode(strip_domain(url))
    at = F.instr(p, "/c/")
    return (at > 0) & F.contains(F.substring(p, at + 3, F.length(p)), F.lit("+"))


def country(raw: Column) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    nl, be = low.rlike(r"\bnl\b"), low.rlike(r"\bbe\b")
    return F.when(nl & be, "nl, be").when(be, "be").otherwise("nl")


def category_parts(url: Column) -> dict[str, Column]:
    """main category, sub-category, and the last numeric id of the sub-category."""
    path = F.split_part(F.regexp_replace(url, "(?i)^https?://[^/]+", ""), F.lit("?"), F.lit(1))
    parts = F.filter(F.split(F.split_part(path, F.lit("/c/"), F.lit(1)), "/"), lambda x: x != "")
    sub = F.get(parts, F.lit(2))
    ids = F.filter(F.split(sub, "_"), lambda x: x.rlike("^[0-9]+$"))
    return {"main": F.get(parts, F.lit(1)), "sub": sub, "sub_id": F.when(F.size(ids) > 0, F.element_at(ids, -1))}


def keeps_facets(want: Column, have: Column) -> Column:
    """All wanted facet pieces are present."""
    return F.size(F.array_except(want, have)) == 0


def parse_search(urls: DataFrame, url: str = "url") -> DataFrame:
    """Search URLs: main category, sub-category, keyword, kept facets; the form without a category is invalid."""
    path = F.regexp_replace(F.split_part(F.col(url), F.lit("?"), F.lit(1)), "(?i)^https?://[^/]+", "")
    deep, flat = "^/products/([^/]+)/([^/]+)/r/([^/]+)/?(?:c/(.*))?$", "^/products/([^/]+)/r/([^/]+)/?(?:c/(.*))?$"
    pick = lambda p, i: F.nullif(F.regexp_extract(path, p, i), F.lit(""))
    kind = F.when(path.rlike(deep), "sub").when(path.rlike(flat), "main").otherwise("invalid")
    word = F.when(kind == "sub", pick(deep, 3)).when(kind == "main", pick(flat, 2))
    return urls.select(url, kind.alias("kind"), F.coalesce(F.when(kind == "sub", pick(deep, 1)), F.when(kind == "main", pick(flat, 1))).alias("main"), F.when(kind == "sub", pick(deep, 2)).alias("sub"), norm.keyword_norm(norm.percent_decode(F.replace(word, F.lit("+"), F.lit(" ")))).alias("keyword"), F.coalesce(F.when(kind == "sub", pick(deep, 4)), F.when(kind == "main", pick(flat, 3))).alias("facets"))


def normalize_report(urls: DataFrame, url: str = "url") -> DataFrame:
    """Collision groups: canonical URLs that several raw ones share, with counts."""
    rows = urls.select(F.col(url).alias("raw")).distinct().withColumn("canonical", norm.canonical_url(F.col("raw"), None))
    return rows.groupBy("canonical").agg(F.count("*").alias("n_raw"), F.min("raw").alias("example"))


def facet_order_audit(urls: DataFrame, url: str = "url") -> DataFrame:
    rows = urls.select(F.split_part(url, F.lit("?"), F.lit(1)).alias("u")).distinct().withColumn("sorted", norm.sort_facets(F.col("u")))
    return rows.filter(F.col("u") != F.col("sorted"))


def link_graph(pages: DataFrame) -> DataFrame:
    """page_id, url, href, kind: the links of pages, relative ones as paths."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)))
    rows = pages.select("page_id", "url", href.alias("raw"))
    path = norm.strip_trailing(F.split_part(F.split_part(F.regexp_replace("raw", "(?i)^https?://[^/]+", ""), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), ",")
    kind = F.when(F.col("raw").rlike("(?i)[0-9a-f]{8}-[0-9a-f]{4}-"), "uuid").when(F.col("raw").rlike("/[0-9]{6,}"), "numeric").otherwise("other")
    return rows.select("page_id", "url", path.alias("href"), kind.alias("kind"))


def canonical_tags(pages: DataFrame) -> DataFrame:
    """The canonical link of a page, attributes in either order, and its title."""
    a = F.regexp_extract("html", r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)
    b = F.regexp_extract("html", r'(?i)<link[^>]*href="([^"]*)"[^>]*rel="canonical"', 1)
    found = F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    host = F.regexp_extract("url", "(?i)^(https?://[^/]+)", 1)
    return pages.select("page_id", F.when(found.startswith("/"), F.concat(host, found)).otherwise(found).alias("canonical"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


def apply_rules(urls: DataFrame, rules: list[dict], url: str = "url") -> DataFrame:
    """Canonical rules by family in fixed order, each applied where the *original* URL qualifies; then cleaned up.

    Rules are a short list of configuration: they are folded into one Column expression.
    """
    raw = F.split_part(F.col(url), F.lit("?"), F.lit(1))
    out = raw
    for r in sorted(rules, key=lambda r: FAMILIES.index(r["kind"])):
        kind = r["kind"]
        if kind == "cat_cat":
            hit, new = raw.contains(f"/{r['old']}/"), F.replace(out, F.lit(f"/{r['old']}/"), F.lit(f"/{r['new']}/"))
        elif kind == "facet_facet":
            hit, new = raw.contains(r["old"]), F.replace(out, F.lit(r["old"]), F.lit(r["new"]))
        elif kind == "cat_facet":
            hit, new = raw.contains(f"/{r['cat']}/") & raw.contains(r["old"]), F.replace(out, F.lit(r["old"]), F.lit(r["new"]))
        elif kind == "cat_facet_remove":
            hit, new = raw.contains(f"/{r['cat']}/") & raw.contains(r["old"]), F.regexp_replace(out, r["old"] + "[^~/]*(~[^~/]+)?(~~)?", "")
        elif kind == "bucket_bucket":
            hit, new = raw.contains(f"/r/{r['old']}"), F.replace(out, F.lit(f"/r/{r['old']}"), F.lit(f"/r/{r['new']}"))
        else:
            hit, new = raw.contains("/r/"), F.regexp_replace(out, "/r/[^/]+", "")
        out = F.when(hit, new).otherwise(out)
    tidy = _tidy(out)
    return urls.select(url, tidy.alias("new_url"), (tidy != raw).alias("changed"))


#: Families of canonical rules, in the order they are applied.
FAMILIES = ("cat_cat", "facet_facet", "cat_facet", "cat_facet_remove", "bucket_bucket", "remove_bucket")
_REACH = 3


def _rule_anchor(rule: dict[str, Column]) -> Column:
    """A piece of text that every URL to which the rule applies has at a place of the same kind; long enough to be rare."""
    old, kind = rule["old"], rule["kind"]
    at = F.instr(old, "~")
    left, right = F.least(at - 1, F.lit(_REACH)), F.least(F.length(old) - at, F.lit(_REACH))
    tilde = F.concat_ws(":", F.lit("f"), left, right, F.substring(old, at - left, left + 1 + right))
    gram = lambda tag: F.concat_ws(":", F.lit(tag), F.least(F.length(old), F.lit(_REACH)), F.substring(old, 1, _REACH))
    return F.when(kind == "cat_cat", F.concat(F.lit("c:"), F.split_part(old, F.lit("/"), F.lit(1)))).when(kind == "bucket_bucket", gram("b")).when(kind == "remove_bucket", "r").when(at > 0, tilde).otherwise(gram("g"))


def _url_anchors(raw: Column, kinds: set[str]) -> Column:
    """The anchors of a URL, of the kinds that rules use (`f:left:right`, `g:length`, `b:length`)."""
    n = F.length(raw)
    each = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    out = [F.transform(F.split(raw, "/"), lambda x: F.concat(F.lit("c:"), x)), F.when(raw.contains("/r/"), F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))]
    for k in sorted(kinds):
        tag, *sizes = k.split(":")
        a = int(sizes[0])
        if tag == "f":
            b = int(sizes[1])
            out.append(_cut(F.filter(each, lambda i: F.substring(raw, i, F.lit(1)) == "~"), raw, k, a, a + 1 + b))
        elif tag == "b":
            out.append(_cut(F.filter(each, lambda i: F.substring(raw, i, F.lit(3)) == "/r/"), raw, k, -3, a))
        else:
            out.append(_cut(each, raw, k, 0, a))
    return F.array_distinct(F.flatten(F.array(*out)))


def _cut(places: Column, raw: Column, kind: str, back: int, size: int) -> Column:
    inside = F.filter(places, lambda i: i - back >= 1)
    return F.transform(inside, lambda i: F.concat(F.lit(f"{kind}:"), F.substring(raw, i - back, F.lit(size))))


def apply_rule_table(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """As apply_rules, for any number of rules (seq, kind, cat, old, new): by family, then by seq.

    Different URLs meet the rules in an equi-join on anchors (a path segment, the letters around a ~, those behind /r/), so a URL's row
    has the few rules that may apply; these are tested on the original URL and applied one after the other. No expression grows
    with the rules.
    """
    order = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("kind"))
    named = rules.select(F.struct(order.alias("family"), "seq", "kind", "cat", "old", "new").alias("rule"), _rule_anchor({"kind": F.col("kind"), "old": F.coalesce("old", F.lit(""))}).alias("anchor"))
    index = stage(named.groupBy("anchor").agg(F.collect_set("rule").alias("rules")), "rule-index")
    used = {r[0] for r in index.select(F.regexp_extract("anchor", "^(f:[0-9]:[0-9]|[gb]:[0-9]):", 1)).distinct().collect()} - {""}
    one = stage(urls.select(F.col(url).alias("u")).distinct().withColumn("raw", F.split_part("u", F.lit("?"), F.lit(1))), "rule-urls")
    each = one.select("u", F.explode(_url_anchors(F.col("raw"), used)).alias("anchor"))
    met = look_up(each, index, "anchor").filter(F.col("rules").isNotNull()).groupBy("u").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))
    raw = F.col("raw")
    slashed = lambda x: F.concat(F.lit("/"), x, F.lit("/"))
    bucket = lambda x: F.concat(F.lit("/r/"), x)

    def hit(x: Column) -> Column:
        facet = F.contains(raw, x["old"])
        return F.when(x["kind"] == "cat_cat", F.contains(raw, slashed(x["old"]))).when(x["kind"] == "facet_facet", facet).when(x["kind"].startswith("cat_facet"), F.contains(raw, slashed(x["cat"])) & facet).when(x["kind"] == "bucket_bucket", F.contains(raw, bucket(x["old"]))).otherwise(raw.contains("/r/"))

    def done(acc: Column, x: Column) -> Column:
        gone = F.regexp_replace(acc, F.concat(x["old"], F.lit("[^~/]*(~[^~/]+)?(~~)?")), F.lit(""))
        return (
            F.when(x["kind"] == "cat_cat", F.replace(acc, slashed(x["old"]), slashed(x["new"])))
            .when(x["kind"].isin("facet_facet", "cat_facet"), F.replace(acc, x["old"], x["new"]))
            .when(x["kind"] == "cat_facet_remove", gone)
            .when(x["kind"] == "bucket_bucket", F.replace(acc, bucket(x["old"]), bucket(x["new"])))
            .otherwise(F.regexp_replace(acc, "/r/[^/]+", ""))
        )

    new = F.when(F.col("rules").isNull(), raw).otherwise(F.aggregate("rules", raw, lambda acc, x: F.when(hit(x), done(acc, x)).otherwise(acc)))
    out = stage(one.join(met, "u", "left").select("u", "raw", new.alias("new")), "rule-results")
    out = out.select(F.col("u").alias(url), _tidy(F.col("new")).alias("new_url"), "raw").select(url, "new_url", (F.col("new_url") != F.col("raw")).alias("changed"))
    return look_up(urls.select(url), out, url)


def _tidy(url: Column) -> Column:
    return norm.sort_facets(F.regexp_replace(F.regexp_replace(F.lower(url), "(?<!:)//+", "/"), "(~~)+$|/c/?$", ""))


def resolve(rows: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """rows (old, new): `new` followed along the redirects until a dead end or a cycle, `hops` at most.

    Edges are unique by key, the last one wins. Distinct targets are followed, and joined back. A round is one join; keys seen
    travel along, so cycles end.
    """
    last = edges.withColumn("k", norm.equiv_key(F.col("from_url"))).groupBy("k").agg(F.max_by("to_url", "seq").alias("hop"))
    last = last.filter(F.col("hop") != "").withColumn("hop_key", norm.equiv_key(F.col("hop")))
    out = rows.select("new").distinct().withColumn("k", norm.equiv_key(F.col("new"))).select("new", F.col("new").alias("final"), "k", F.array("k").alias("seen"))
    for _ in range(hops):
        # A dead end has no key any more.
        out = out.join(last, "k", "left").withColumn("go", F.col("hop_key").isNotNull() & ~F.coalesce(F.array_contains("seen", F.col("hop_key")), F.lit(False)))
        step = lambda a, b: F.when(F.col("go"), a).otherwise(b)
        out = out.select("new", step(F.col("hop"), F.col("final")).alias("final"), F.when(F.col("go"), F.col("hop_key")).alias("k"), step(F.array_append("seen", F.col("hop_key")), F.col("seen")).alias("seen"))
    found = out.select(F.col("new").alias("__new"), "final", (F.size("seen") - 1).cast("long").alias("n_hops"))
    rows = rows.join(found, F.col("new").eqNullSafe(F.col("__new")), "left").drop("__new")
    return rows.withColumn("flatten_from", F.when(F.col("n_hops") > 0, F.col("new")))


def preflight(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (pos, old, new, country, status): final target and the first reason to skip, in order."""
    code = F.coalesce(F.col("status").try_cast("int"), F.lit(301))
    df = rows.withColumns({"old": strip_domain(F.coalesce("old", F.lit(""))), "new": strip_domain(F.coalesce("new", F.lit(""))), "country": country(F.col("country")), "status": F.when(code.isin(*STATUS_CODES), code).otherwise(301)})
    df = resolve(df, edges)
    df = df.withColumns({"ok": norm.equiv_key(F.col("old")), "fk": norm.equiv_key(F.col("final")), "blocked": is_homepage(F.col("old")), "multi": has_multi_value(F.col("old")) | has_multi_value(F.col("new"))})
    # Written once here: what follows reads plain columns, and its code stays small.
    df = stage(df, "resolved")
    rule = edges.withColumn("ok", norm.equiv_key(F.col("from_url"))).groupBy("ok").agg(F.max_by("to_url", "seq").alias("existing"))
    df = df.join(rule.withColumn("existing_key", norm.equiv_key(F.col("existing"))), "ok", "left")
    first = F.row_number().over(Window.partitionBy("ok", "country").orderBy("pos"))
    reason = (
        F.when((F.col("old") == "") | (F.col("new") == ""), "missing URL")
        .when(F.col("blocked"), "homepage (blocked)")
        .when(F.col("multi"), "multi-value facet (no-index)")
        .when(F.col("existing_key") == F.col("fk"), "already redirected")
        .when(F.col("existing").isNotNull(), "source has existing rule")
        .when(F.col("ok") == F.col("fk"), "self redirect")
        .when(F.col("dup") > 1, "duplicate in batch")
    )
    df = df.withColumn("dup", first).withColumn("skip_reason", reason)
    sources = df.filter("skip_reason is null").select(F.col("ok").alias("fk")).distinct().withColumn("__src", F.lit(True))
    df = df.join(sources, "fk", "left")
    return df.select("pos", "old", "final", "country", "status", "flatten_from", F.when(F.col("skip_reason").isNull() & F.col("__src"), "target is batch source").otherwise(F.col("skip_reason")).alias("skip_reason"))


def rewrite(urls: DataFrame, categories: dict[str, str], facets: dict[str, str], url: str = "url") -> DataFrame:
    """Category rules, then facet rules (exact slug~value), then facets sorted; whether anything changed."""
    raw = F.split_part(F.col(url), F.lit("?"), F.lit(1))
    out = reduce(lambda c, kv: F.replace(c, F.lit(f"/{kv[0]}/"), F.lit(f"/{kv[1]}/")), categories.items(), raw)
    base, tail = F.split_part(out, F.lit("/c/"), F.lit(1)), F.split_part(out, F.lit("/c/"), F.lit(2))
    table = F.create_map(*(F.lit(x) for kv in facets.items() for x in kv)) if facets else None
    parts = F.transform(F.split(tail, "~~"), lambda x: F.coalesce(table[x], x) if facets else x)
    out = norm.sort_facets(F.when(out.contains("/c/"), F.concat(base, F.lit("/c/"), F.array_join(parts, "~~"))).otherwise(out))
    return urls.select(url, out.alias("new_url"), (out != raw).alias("changed"))


def structural_issues(url: Column) -> Column:
    """Array of issue codes, in order. The codes."""
    low = F.lower(url)
    path = norm.percent_decode(F.split_part(F.split_part(F.regexp_replace(url, "(?i)^https?://[^/]+", ""), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)))
    query = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    params = F.filter(F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: x != "")
    tracked = lambda x: x.rlike("^(utm_|gclid|fbclid|gad_source)")
    parts = F.filter(F.split(F.split_part(path, F.lit("/c/"), F.lit(1)), "/"), lambda x: x != "")
    chunks = F.when(path.contains("/c/"), F.filter(F.split(F.trim(F.split_part(path, F.lit("/c/"), F.lit(2)), F.lit("/")), "~~"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    names = F.filter(F.transform(chunks, lambda x: F.split_part(x, F.lit("~"), F.lit(1))), lambda x: x != "")
    tests = [
        ("DOUBLE_PRODUCTS", low.contains("/products/products/")),
        ("DOUBLE_MAINCAT", (F.size(parts) >= 3) & (F.lower(F.get(parts, F.lit(1))) == F.lower(F.get(parts, F.lit(2))))),
        ("MISSING_PRODUCTS_PREFIX", ~path.startswith("/products/") & ~F.contains(F.lower(F.substring(path, 1, 20)), F.lit("products"))),
        ("TRACKING_PARAMS", F.exists(params, tracked)),
        ("QUERY_PARAMS", F.exists(params, lambda x: ~tracked(x))),
        ("FRAGMENT_PRESENT", F.split_part(url, F.lit("#"), F.lit(2)) != ""),
        ("EMPTY_FACET_SLUG", F.exists(chunks, lambda x: x.startswith("~"))),
        ("EMPTY_FACET_VALUE", F.exists(chunks, lambda x: F.split_part(x, F.lit("~"), F.lit(2)) == "")),
        ("DUPLICATE_FACET", F.size(F.array_distinct(names)) < F.size(names)),
        ("INVALID_CHARS", path.contains(" ") | path.contains("+")),
        ("UPPERCASE_IN_PATH", path != F.lower(path)),
        ("HAS_BUCKET", path.contains("/r/")),
        ("PAGINATION", low.contains("page_")),
        ("UNWANTED_PARAM", low.contains("sortby") | low.contains("device") | low.contains("shop_id")),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in tests)))


def taxonomy_issues(urls: DataFrame, cats: DataFrame, settings: DataFrame, values: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Per distinct URL: main, sub, true_main, tax (codes in order), facets_valid, facets_total.

    cats (deepest_cat, main_cat, and enabled where it is known), settings (deepest_cat, slug, and enabled, noindex), values (slug,
    value_id, and seo). An unknown main category or category ends the checks; a facet that isn't linked, or whose value is no
    number or unknown, ends its own. Each facet gives its codes, in the order of the URL.
    """
    flag = lambda df, name, default: F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    rows = urls.select(url).distinct()
    parts = category_parts(F.col(url))
    rows = rows.withColumns({"main": F.lower(parts["main"]), "sub": F.lower(parts["sub"]), "pairs": F.coalesce(norm.facet_pairs(F.col(url)), F.array().cast("array<struct<slug:string,value:string>>"))})
    mains = cats.select(F.col("main_cat").alias("main"), F.lit(True).alias("known_main")).distinct()
    known = cats.groupBy(F.col("deepest_cat").alias("sub")).agg(F.min("main_cat").alias("true_main"), F.bool_or(flag(cats, "enabled", True)).alias("on"))
    rows = rows.join(mains, "main", "left").join(known, "sub", "left")
    stop = F.when(F.col("main").isNull(), "NO_MAINCAT").when(F.col("known_main").isNull(), "MAINCAT_NOT_FOUND").when(F.col("sub").isNotNull() & F.col("true_main").isNull(), "CATEGORY_NOT_FOUND")
    rows = rows.withColumn("stop", stop)
    facets = rows.filter("stop is null").select(url, F.coalesce("sub", "main").alias("level"), F.posexplode("pairs").alias("at", "p")).select(url, "level", "at", "p.slug", "p.value")
    linked = settings.select(F.col("deepest_cat").alias("level"), "slug", flag(settings, "enabled", True).alias("use"), flag(settings, "noindex", False).alias("hide"), F.lit(True).alias("linked"))
    facets = facets.join(linked, ["level", "slug"], "left").withColumn("value_id", F.col("value").try_cast("long"))
    if values is not None:
        listed = values.select("slug", "value_id", flag(values, "seo", True).alias("seo"), F.lit(True).alias("listed"))
        facets = facets.join(listed, ["slug", "value_id"], "left")
    else:
        facets = facets.withColumns({"seo": F.lit(True), "listed": F.lit(True)})
    bad = F.when(F.col("value_id").isNull(), "INVALID_VALUE_ID").when(F.col("listed").isNull(), "VALUE_NOT_FOUND")
    codes = F.array_compact(F.array(F.when(~F.col("use"), "FACET_DISABLED"), F.when(F.col("hide"), "FACET_NOINDEX"), bad, F.when(bad.isNull() & ~F.col("seo"), "VALUE_LOW_SEO_PRIORITY")))
    codes = F.when(F.col("linked").isNull(), F.array(F.lit("FACET_NOT_LINKED"))).otherwise(codes)
    valid = F.col("linked").isNotNull() & bad.isNull()
    facets = facets.groupBy(url).agg(F.array_sort(F.collect_list(F.struct("at", codes.alias("codes")))).alias("each"), F.count_if(valid).alias("facets_valid"))
    rows = rows.join(facets, url, "left")
    here = F.array_compact(F.array("stop", F.when(F.col("stop").isNull() & (F.col("true_main") != F.col("main")), "HIERARCHY_MISMATCH"), F.when(F.col("stop").isNull() & ~F.col("on"), "CATEGORY_DISABLED")))
    tax = F.concat(here, F.coalesce(F.flatten(F.transform("each", lambda x: x["codes"])), F.array().cast("array<string>")))
    return rows.select(url, "main", "sub", "true_main", tax.alias("tax"), F.coalesce("facets_valid", F.lit(0)).cast("long").alias("facets_valid"), F.size("pairs").cast("long").alias("facets_total"))


def validate(urls: DataFrame, cats: DataFrame, settings: DataFrame, values: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Structural codes, then taxonomy codes."""
    rows = taxonomy_issues(urls, cats, settings, values, url)
    return rows.select(url, "main", "sub", "true_main", F.concat(structural_issues(F.col(url)), "tax").alias("issues"), "facets_valid", "facets_total")


#: Codes that leave too little to rebuild a URL from, and those that rebuilding mends.
BLOCKERS = (
    "MAINCAT_NOT_FOUND", "NO_MAINCAT", "CATEGORY_NOT_FOUND", "CATEGORY_DISABLED", "FACET_NOT_LINKED", "INVALID_VALUE_ID", "VALUE_NOT_FOUND", "INVALID_CHARS", "EMPTY_FACET_SLUG",
    "EMPTY_FACET_VALUE", "MISSING_PRODUCTS_PREFIX", "DOUBLE_MAINCAT",
)
FIXABLE = ("HIERARCHY_MISMATCH", "DOUBLE_PRODUCTS", "UPPERCASE_IN_PATH", "FRAGMENT_PRESENT", "TRACKING_PARAMS", "UNWANTED_PARAM", "QUERY_PARAMS", "DUPLICATE_FACET", "HAS_BUCKET")


def suggest(checked: DataFrame, url: str = "url") -> DataFrame:
    """A rebuilt URL where something can be mended and nothing stands in the way, else null: the right main category, the search
    term kept, the first facet of each name, lower case, scheme and host kept; null if that is the URL itself."""
    mend = F.arrays_overlap("issues", F.array(*map(F.lit, FIXABLE))) & ~F.arrays_overlap("issues", F.array(*map(F.lit, BLOCKERS)))
    main = F.coalesce(F.when(F.array_contains("issues", "HIERARCHY_MISMATCH"), F.col("true_main")), F.col("main"))
    host = F.lower(F.regexp_extract(F.trim(url), "(?i)^(https?://[^/]+)", 1))
    term = F.regexp_extract(url, "(?i)/r/([^/?#]+)", 1)
    pairs = norm.facet_pairs(F.split_part(F.col(url), F.lit("#"), F.lit(1)))
    names = F.transform(pairs, lambda p: p["slug"])
    once = F.filter(pairs, lambda p, i: F.array_position(names, p["slug"]) == i + 1)
    path = F.concat(F.lit("/products"), F.coalesce(F.concat(F.lit("/"), main), F.lit("")), F.coalesce(F.concat(F.lit("/"), "sub"), F.lit("")), F.when(term != "", F.concat(F.lit("/r/"), term)).otherwise(""))
    path = F.concat(path, F.when(F.size(once) > 0, F.concat(F.lit("/c/"), F.array_join(F.transform(once, lambda p: F.concat(p["slug"], F.lit("~"), p["value"])), "~~"))).otherwise("/"))
    out = F.concat(host, F.lower(path))
    return checked.select(url, F.when(mend & (out != F.trim(url)), out).alias("suggestion"))


def check_links(content: DataFrame, products: DataFrame) -> DataFrame:
    """content (content_id, category, ids); products (category, product_id, state, new_id): totals per content. The key is
    (category, id), so equal ids of two categories stay apart."""
    links = content.select("content_id", "category", F.explode(F.array_distinct("ids")).alias("product_id"))
    state = F.when(F.col("state").isNull(), "unknown").when((F.col("state") == "moved") & F.col("new_id").isNotNull(), "replaced").when(F.col("state") == "live", "valid").otherwise("gone")
    rows = links.join(products, ["category", "product_id"], "left").withColumn("result", state)
    return rows.groupBy("content_id").agg(*(F.count_if(F.col("result") == s).alias(s) for s in ("valid", "replaced", "gone", "unknown")))


def rewrite_links(content: DataFrame, products: DataFrame) -> DataFrame:
    """content (content_id, category, text, ids): the ids of replaced products in the text become the new ids, [id] by [id]."""
    links = content.select("content_id", "category", F.explode(F.array_distinct("ids")).alias("product_id"))
    moved = links.join(products.filter((F.col("state") == "moved") & F.col("new_id").isNotNull()), ["category", "product_id"])
    pairs = moved.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("product_id", "new_id"))).alias("pairs"))
    tag = lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))
    done = F.aggregate("pairs", F.col("text"), lambda acc, x: F.replace(acc, tag(x["product_id"]), tag(x["new_id"])))
    return content.join(pairs, "content_id", "left").select("content_id", F.coalesce(done, "text").alias("text"))
