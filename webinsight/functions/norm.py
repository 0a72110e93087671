"""Normal forms of URLs, facets, keywords and dates as Column functions (no UDFs: Catalyst sees and inlines all of them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cut(c: Column) -> Column:
    return F.split_part(F.split_part(c, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def strip_trailing(c: Column, mark: str = "/") -> Column:
    return F.rtrim(c, F.lit(mark))


def npath(url: Column) -> Column:
    """Lower-cased path without host, query, fragment and trailing slashes; the root becomes ''."""
    return strip_trailing(_cut(F.lower(F.regexp_replace(url, "(?i)^https?://[^/]+", ""))))


def canonical_url(url: Column, own_hosts: tuple[str, ...] | None = ("www.shop.example", "shop.example")) -> Column:
    """Rooted path: no slash at the end below /c/, one elsewhere; null for other hosts, 'undefined' and unrooted input.

    own_hosts None: any host is stripped (an emptied path is then null).
    """
    low = F.lower(url)
    full = low.rlike("^https?://")
    if own_hosts is None:
        rest = F.when(full, F.regexp_replace(url, "(?i)^https?://[^/]+", "")).otherwise(url)
    else:
        hosts = "|".join(h.replace(".", "\\.") for h in own_hosts)
        own = low.rlike(f"^https?://({hosts})")
        rest = F.when(full & ~own, F.lit(None)).when(full, F.regexp_replace(url, f"(?i)^https?://({hosts})", "")).otherwise(url)
        rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    rest = F.when(rest.startswith("./"), F.substring(rest, 2, 1 << 30)).otherwise(rest)
    path = _cut(rest)
    shaped = F.when(path.contains("/c/"), strip_trailing(path)).when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.when((url != "") & (url != "undefined") & rest.startswith("/"), shaped)


def percent_decode(c: Column) -> Column:
    """Percent escapes only: a plus stays, and a text with a malformed escape is left as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def log_stem(c: Column) -> Column:
    stem = strip_trailing(percent_decode(c))
    return F.when(stem == "", F.lit("/")).otherwise(stem)


def equiv_key(url: Column) -> Column:
    return F.translate(percent_decode(url), "_+", "  ")


def url_variants(url: Column) -> Column:
    """The URL with its blanks written in each way, distinct, in order."""
    space = equiv_key(url)
    return F.array_distinct(F.array(url, space, F.replace(space, F.lit(" "), F.lit("_")), F.replace(space, F.lit(" "), F.lit("+")), F.replace(space, F.lit(" "), F.lit("%20"))))


def canon_key(c: Column) -> Column:
    """Facet slugs joined by ~, as a set: lower-cased, sorted, without empties."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(c), "~"), lambda x: x != "")), "~")


def keyword_norm(c: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(c, "[-_]", " "), r"[^a-zA-Z0-9\s]", "")
    return F.lower(F.trim(F.regexp_replace(kept, r"\s+", " ")))


#: Letters with marks and the letters below them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşţťũūŭůűųŵŷźż"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyszaaaccccdeeeeegggghiiiijklllnnnooorrrsssttuuuuuuwyzz"


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), MARKED, PLAIN)


def date_key(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.day(d)).cast("long")


def month_of(key: Column) -> Column:
    return F.floor(key / 100).cast("long")


def key_to_date(key: Column) -> Column:
    return F.to_date(key.cast("string"), "yyyyMMdd")


def facet_pairs(url: Column) -> Column:
    """Array of (slug, value) of the facets behind the first /c/, malformed ones left out."""
    path = F.split_part(url, F.lit("?"), F.lit(1))
    tail = F.substring_index(path, "/c/", -1)
    chunks = F.transform(F.split(tail, "~~"), lambda x: F.trim(x, F.lit("/")))
    pairs = F.transform(chunks, lambda x: F.struct(F.lower(F.split_part(x, F.lit("~"), F.lit(1))).alias("slug"), F.split_part(F.split_part(x, F.lit("~"), F.lit(2)), F.lit("/"), F.lit(1)).alias("value")))
    return F.when(path.contains("/c/"), F.filter(pairs, lambda p: (p["slug"] != "") & (p["value"] != "")))


def leaf_slug(url: Column) -> Column:
    """The third or deeper part of the path before /c/; null when there are fewer than three."""
    path = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "(?i)^https?://[^/]+", "")
    parts = F.filter(F.split(F.substring_index(path, "/c/", 1), "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 3, F.lower(F.trim(F.element_at(parts, -1))))


def sort_facets(url: Column) -> Column:
    """Facets lower-cased and stably sorted by their names; no slash at the end. Other URLs stay."""
    base, tail = F.split_part(url, F.lit("/c/"), F.lit(1)), strip_trailing(F.split_part(url, F.lit("/c/"), F.lit(2)))
    parts = F.filter(F.split(F.lower(tail), "~~"), lambda x: x != "")
    tagged = F.transform(parts, lambda x, i: F.struct(F.split_part(x, F.lit("~"), F.lit(1)).alias("name"), i.alias("i"), x.alias("x")))
    done = F.array_join(F.transform(F.array_sort(tagged), lambda s: s["x"]), "~~")
    return F.when(url.contains("/c/"), F.concat(base, F.lit("/c/"), done)).otherwise(url)
