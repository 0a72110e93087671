"""Content state and quality: shares, status, deltas, titles, combinations, drift, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webinsight.functions.norm import canon_key, canonical_url, facet_pairs, fold
from webinsight.operators.common import stage


def failure_tags(url: Column) -> Column:
    tests = [
        ("empty_start_facet", url.contains("/c/~~")),
        ("triple_tilde", url.contains("~~~")),
        ("trailing_tilde", url.endswith("~~")),
        ("facet_without_c_prefix", url.startswith("/products/") & ~url.contains("/c/") & url.contains("~")),
        ("brand_url", url.startswith("/brand/")),
        ("filter_url", url.startswith("/filters/")),
        ("non_product_url", ~url.startswith("/products/") & ~url.startswith("/brand/") & ~url.startswith("/filters/")),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.lit(tag)) for tag, cond in tests)))


def content_share(visits: DataFrame, texts: DataFrame, faqs: DataFrame, key: str) -> DataFrame:
    """Percent of visits and revenue that land on keys with a text, an FAQ, either."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(1))
    rows = visits.groupBy(key).agg(F.count("*").alias("v"), F.sum("revenue").alias("r")).join(flag(texts, "t"), key, "left").join(flag(faqs, "f"), key, "left")
    t, f = F.col("t").isNotNull(), F.col("f").isNotNull()
    pct = lambda cond, c: (F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("double") * 100.0 / F.sum(c).cast("double"))
    return rows.agg(pct(t, "v").alias("text_visits"), pct(f, "v").alias("faq_visits"), pct(t | f, "v").alias("any_visits"), pct(t, "r").alias("text_revenue"))


def status_breakdown(urls: DataFrame, jobs: DataFrame, key: str = "url_id") -> DataFrame:
    rows = urls.select(key).join(jobs.select(key, "status", F.lit(True).alias("__job")), key, "left")
    return rows.groupBy(F.when(F.col("__job").isNull(), "(not in jobs)").otherwise(F.coalesce("status", F.lit("(none)"))).alias("status")).agg(F.count("*").alias("n"))


def risky_paths(jobs: DataFrame, least: int = 5, rate: float = 0.15) -> DataFrame:
    path = F.regexp_extract("url", "^(/products/[^/]+/[^/]+/)", 1)
    rows = jobs.groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    return rows.filter((F.col("path") != "") & (F.col("failed") >= least) & (F.col("failed") >= rate * F.col("n"))).withColumn("fail_rate", F.col("failed") / F.col("n"))


def distinct_urls(*tables: DataFrame) -> DataFrame:
    """One count over the union in place of joins between the tables."""
    out = tables[0].select("url")
    for t in tables[1:]:
        out = out.unionByName(t.select("url"))
    return out.agg(F.count_distinct("url").alias("urls"))


def unruled_facets(urls: DataFrame, rules: DataFrame) -> DataFrame:
    rows = urls.select("url", F.explode(F.array_distinct(F.transform(facet_pairs(F.col("url")), lambda p: p["slug"]))).alias("slug"))
    return rows.join(rules.select("slug"), "slug", "left_anti").groupBy("slug").agg(F.count_distinct("url").alias("urls"))


def bucket_totals(visits: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (slug): visits and revenue of the URLs that hold the facet."""
    hits = visits.select("revenue", F.explode(F.array_distinct(F.transform(facet_pairs(F.col("url")), lambda p: p["slug"]))).alias("slug"))
    sums = hits.groupBy("slug").agg(F.count("*").alias("visits"), F.sum("revenue").cast("double").alias("revenue"))
    return rows.join(sums, "slug", "left").na.fill(0, ["visits", "revenue"])


def publish_delta(content: DataFrame, pushed: DataFrame) -> DataFrame:
    """new / changed / unchanged by md5, and stale: pushed but no longer publishable."""
    a = content.select("url_id", F.md5(F.col("content").cast("binary")).alias("now"))
    b = pushed.select("url_id", F.col("pushed_md5").alias("was"))
    state = F.when(F.col("now").isNull(), "stale").when(F.col("was").isNull(), "new").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return a.join(b, "url_id", "full").select("url_id", state.alias("state"))


def publish_set(content: DataFrame) -> DataFrame:
    """Rows with content; of URLs with the same lower-cased canonical form the first."""
    rows = content.withColumn("canonical", F.lower(canonical_url(F.col("url"), None))).filter(F.col("canonical").isNotNull() & (F.trim("content") != ""))
    w = Window.partitionBy("canonical").orderBy("url", "url_id")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def facet_keys(visits: DataFrame) -> DataFrame:
    """(cat, key, visits, revenue, urls, sample): traffic by category and facet key in URL order; revenue where visits have it.

    The sums by URL are written first. Else the facets, which a URL alone decides, would be parsed below the sums, for every visit.
    """
    url, money = F.col("url"), "revenue" in visits.columns
    sums = visits.filter(F.contains(url, F.lit("/c/"))).groupBy(F.col("deepest_cat").alias("cat"), "url")
    sums = stage(sums.agg(F.count("*").alias("visits"), *([F.sum("revenue").alias("revenue")] if money else [])), "facet-urls")
    rows = sums.withColumn("key", F.array_join(F.transform(facet_pairs(url), lambda p: p["slug"]), "~")).filter("key <> ''")
    revenue = [F.sum("revenue").cast("double").alias("revenue")] if money else []
    return rows.groupBy("cat", "key").agg(F.sum("visits").alias("visits"), *revenue, F.count("*").alias("urls"), F.min("url").alias("sample"))


def gap_combos(traffic: DataFrame, covered: DataFrame) -> DataFrame:
    """Trafficked facet sets without a title: the same set in another order counts as covered."""
    rows = traffic.withColumn("ck", canon_key(F.col("key"))).groupBy("cat", "ck").agg(F.sum("visits").alias("visits"), F.sum("urls").alias("urls"), F.min("sample").alias("sample"))
    return rows.join(covered.select("cat", canon_key(F.col("key")).alias("ck")).distinct(), ["cat", "ck"], "left_anti")


def coverage_grade(traffic: DataFrame, covered: DataFrame) -> DataFrame:
    """exact / canon-only / none."""
    raw = covered.select("cat", "key").distinct().withColumn("__raw", F.lit(True))
    canon = covered.select("cat", canon_key(F.col("key")).alias("ck")).distinct().withColumn("__canon", F.lit(True))
    rows = traffic.withColumn("ck", canon_key(F.col("key"))).join(raw, ["cat", "key"], "left").join(canon, ["cat", "ck"], "left")
    return rows.withColumn("grade", F.when(F.col("__raw"), "exact").when(F.col("__canon"), "canon-only").otherwise("none")).drop("__raw", "__canon")


def gap_bands(graded: DataFrame) -> DataFrame:
    band = F.when(F.col("visits") >= 6, "6+").when(F.col("visits") >= 3, "3-5").when(F.col("visits") >= 1, "1-2").otherwise("0")
    return graded.groupBy(band.alias("band"), "grade").agg(F.count("*").alias("combos"), F.sum("visits").alias("visits"), F.sum("revenue").cast("decimal(20,4)").cast("double").alias("revenue"))


def title_blueprint(rows: DataFrame, rules: DataFrame, limit: int = 200) -> DataFrame:
    """rows (id, noun, slugs) with rules (slug, word, place, pin): facet words by place, pinned ones last, after the noun;
    words are dropped from the end until the title fits."""
    each = rows.select("id", "noun", F.explode("slugs").alias("slug")).join(rules, "slug")
    each = each.groupBy("id", "noun").agg(F.array_sort(F.collect_list(F.struct("place", "slug", "word", "pin"))).alias("w"))
    before = F.transform(F.filter("w", lambda x: ~x["pin"]), lambda x: x["word"])
    after = F.transform(F.filter("w", lambda x: x["pin"]), lambda x: x["word"])
    words = F.concat(before, F.array("noun"), after)
    size = lambda i: F.aggregate(F.slice(F.col("words"), 1, i + 1), F.lit(-1), lambda a, x: a + F.length(x) + 1)
    out = each.withColumn("words", words)
    return out.select("id", F.array_join(F.filter("words", lambda x, i: size(i) <= limit), " ").alias("title"))


def subset_combos(top: DataFrame, existing: DataFrame) -> DataFrame:
    """top (cat, slugs: sorted array of a few): every non-empty subset, and whether it exists."""
    n = F.size("slugs")
    masks = F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 1).cast("int")))
    rows = top.withColumn("mask", masks)
    key = F.array_join(F.filter("slugs", lambda x, i: (F.floor(F.col("mask") / F.pow(F.lit(2), i)) % 2) == 1), "~")
    rows = rows.select("cat", key.alias("key"))
    return rows.join(existing.select("cat", "key").distinct().withColumn("there", F.lit(True)), ["cat", "key"], "left").na.fill(False, ["there"])


def impossible_combos(combos: DataFrame, needs: DataFrame) -> DataFrame:
    """combos (cat, key) with a facet whose acceptable parents (needs: child, parent) are all absent."""
    rows = combos.withColumn("slugs", F.split("key", "~"))
    each = rows.select("cat", "key", "slugs", F.explode("slugs").alias("child")).join(needs, "child")
    each = each.groupBy("cat", "key", "child").agg(F.max(F.array_contains("slugs", F.col("parent")).cast("int")).alias("ok"))
    return each.groupBy("cat", "key").agg(F.count_if(F.col("ok") == 0).alias("unmet")).filter("unmet > 0")


def build_queue(gaps: DataFrame, covered: DataFrame, impossible: DataFrame) -> DataFrame:
    """Gap combos with the first reason not to build; null: build."""
    a = covered.select("cat", canon_key(F.col("key")).alias("ck")).distinct().withColumn("__c", F.lit(True))
    b = impossible.select("cat", F.col("key").alias("ck")).distinct().withColumn("__i", F.lit(True))
    rows = gaps.join(a, ["cat", "ck"], "left").join(b, ["cat", "ck"], "left")
    return rows.withColumn("skip", F.when(F.col("ck") == "", "empty").when(F.col("__c"), "covered").when(F.col("__i"), "impossible")).drop("__c", "__i")


def _plain(c: Column) -> Column:
    """Lower case, without marks, hyphens and blanks."""
    return F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def topic_drift(docs: DataFrame, least: int = 6, head: int = 3) -> DataFrame:
    """docs (id, title, text): words of a text that share the tail of the title's last word but have another head.

    A tail has `least` letters or more, leaves `head` or more of the title's word, and is some title's last word itself. Words that
    the title holds, or whose head it holds, are no drift. The longest tail with such words wins: id, tail, words, and
    in_opening, whether one of them is in the first sentence.
    """
    rows = docs.select("id", _plain(F.regexp_extract(F.trim(F.coalesce("title", F.lit(""))), r"(\S+)$", 1)).alias("last"), _plain(F.col("title")).alias("full"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]+>", " ")).alias("text"))
    vocabulary = rows.select(F.col("last").alias("tail")).distinct()
    size = F.length("last")
    tails = rows.filter(size >= least + head).select("id", "last", "full", F.explode(F.transform(F.sequence(F.lit(least), size - head), lambda k: F.right(F.col("last"), k))).alias("tail"))
    tails = tails.join(vocabulary, "tail", "left_semi")
    words = rows.select("id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), _plain))).alias("word"))
    rest = F.expr("left(word, length(word) - length(tail))")
    other = F.endswith("word", F.col("tail")) & (F.col("word") != F.col("last")) & ~F.contains("full", F.col("word")) & (F.length(rest) >= head) & ~((F.length(rest) >= 4) & F.contains("full", rest))
    hits = words.join(tails, "id").filter(other)
    found = hits.groupBy("id", "tail").agg(F.array_sort(F.collect_set("word")).alias("words"))
    best = found.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("tail"))))).filter("rn = 1").drop("rn")
    opening = rows.select("id", _plain(F.get(F.split("text", r"(?<=[.!?])\s", 2), F.lit(0))).alias("opening"))
    return best.join(opening, "id").select("id", "tail", "words", F.exists("words", lambda w: F.contains(F.col("opening"), w)).alias("in_opening"))


def sister_scan(docs: DataFrame, cats: DataFrame) -> DataFrame:
    """docs (id, cat, text), cats (cat, parent, name): the own name is absent and a sibling's is present."""
    own = docs.join(cats, "cat").filter(~F.contains(F.lower("text"), F.col("name")))
    sibs = cats.select(F.col("cat").alias("sister"), "parent", F.col("name").alias("sister_name"))
    rows = own.join(sibs, "parent").filter((F.col("sister") != F.col("cat")) & F.contains(F.lower("text"), F.col("sister_name")))
    return rows.groupBy("id", "cat").agg(F.min("sister").alias("sister"))


def reverse_template(titles: DataFrame, labels: DataFrame) -> DataFrame:
    """titles (id, title), labels (id, slug, label): labels replaced by {slug}, longest first."""
    table = labels.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.length("label")).alias("n"), "label", "slug"))).alias("l"))
    out = F.aggregate("l", F.col("title"), lambda acc, x: F.replace(acc, x["label"], F.concat(F.lit("{"), x["slug"], F.lit("}"))))
    return titles.join(table, "id").select("id", out.alias("template"))


def stale_blueprints(stored: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rows whose stored title differs from the newly rendered one (null-safe)."""
    rows = stored.join(rendered.withColumnRenamed("title", "new_title"), "id")
    return rows.filter(~F.col("title").eqNullSafe(F.col("new_title")))


def junk_facets(keys: DataFrame, known: DataFrame, retired: DataFrame) -> DataFrame:
    """unknown (a slug that the taxonomy lacks) before retired (ruled, but out of use)."""
    each = keys.select("cat", "key", F.explode(F.split("key", "~")).alias("slug"))
    each = each.join(known.select("slug").distinct().withColumn("k", F.lit(True)), "slug", "left").join(retired.select("slug").distinct().withColumn("r", F.lit(True)), "slug", "left")
    rows = each.groupBy("cat", "key").agg(F.bool_or(F.col("k").isNull()).alias("unknown"), F.bool_or(F.col("r").isNotNull()).alias("retired"))
    return rows.filter("unknown or retired").select("cat", "key", F.when(F.col("unknown"), "unknown").otherwise("retired").alias("junk"))


def scored_listing(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.col("score").asc_nulls_last(), "url")


def explode_faq(content: DataFrame) -> DataFrame:
    """content (url_id, faq: JSON array of {q, a}): a row for each item with its place."""
    items = F.from_json("faq", "array<struct<q: string, a: string>>")
    return content.select("url_id", F.posexplode(items).alias("place", "item")).select("url_id", "place", "item.q", "item.a")


def json_targets(rows: DataFrame, column: str) -> DataFrame:
    """rows with n_targets: the length of a JSON array, 0 for null and malformed text."""
    return rows.withColumn("n_targets", F.coalesce(F.json_array_length(column), F.lit(0)))
