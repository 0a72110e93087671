"""Text jobs as Column functions: repair, hygiene, tokens, sizes, stems, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webinsight.operators.common import let

#: Letter sizes and their spellings.
LETTER_SIZES = {
    "XXS": ["xxs", "2xs"],
    "XS": ["xs", "extra small", "extra klein"],
    "S": ["s", "small"],
    "M": ["m", "medium"],
    "L": ["l", "large"],
    "XL": ["xl", "extra large", "extra groot", "x-large", "x large"],
    "XXL": ["xxl", "2xl", "xx-large", "xx large"],
    "XXXL": ["xxxl", "3xl"],
    "XXXXL": ["xxxxl", "4xl"],
}
#: Words that make a bare letter or number a size, and the letters that need one.
SIZE_CUES = ["maat", "maten", "size", "sizes", "mt"]
CUE_GATED = ["s", "m", "l", "xs", "xxs"]

#: UTF-8 read as Latin-1: each letter of the Latin-1 and Latin Extended-A ranges and what it turns into.
MOJIBAKE = sorted(((chr(c).encode().decode("latin-1"), chr(c)) for c in range(0xC0, 0x180)), key=lambda kv: -len(kv[0]))


def repair_mojibake(c: Column) -> Column:
    """Text that shows no lead byte of a misread letter stays untouched."""
    out = c
    for bad, good in MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.when(c.rlike("[ÃÄÅ][\u0080-¿]"), out).otherwise(c)


def clean_upload(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "^﻿", "")
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def quarantine_reason(row_id: Column, text: Column, parts: Column, wanted: int) -> Column:
    """Why an upload row is set aside; null when it is good."""
    return (
        F.when(parts != wanted, "wrong_columns")
        .when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(F.regexp_replace(text, r"<[^>]*>|\s", "").rlike("^[0-9]+$"), "numeric_only")
        .when(row_id.isNull(), "no_id")
    )


def unescape(c: Column) -> Column:
    out = c
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_quotes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def clean_facet_value(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<!--.*?-->", ""), r"\s+", " "))


def comment_form(c: Column, name: str) -> Column:
    """The text of a comment like <!-- SIC: x -->, or null."""
    return F.nullif(F.regexp_extract(c, rf"<!--\s*{name}:\s*(.*?)\s*-->", 1), F.lit(""))


def title_hygiene(c: Column) -> Column:
    """Adjacent singular / plural and prefix repeats are merged into the longer word; `a x b` dimensions are closed up."""
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    kept = let(words, lambda w: F.filter(w, lambda x, i: F.coalesce(~_covered(F.lower(x), F.lower(F.get(w, i + 1))), F.lit(True))))
    kept = let(kept, lambda w: F.filter(w, lambda x, i: F.coalesce(~((i > 0) & _covered(F.lower(x), F.lower(F.get(w, i - 1)))), F.lit(True))))
    joined = F.array_join(kept, " ")
    return F.regexp_replace(joined, r"(\d)\s*[xX]\s*(?=\d)", "$1x")


def _covered(a: Column, b: Column) -> Column:
    """a is b without a plural ending, or a longer word's beginning."""
    return (a != b) & b.startswith(a) & (F.length(a) >= 4) & (F.length(b) - F.length(a) <= 3)


def plain_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def size_tokens(c: Column) -> Column:
    """Sizes of a query: canonical letters, and number groups as sorted digits joined by /."""
    low = F.lower(F.coalesce(c, F.lit("")))
    plain = plain_tokens(low)
    padded = F.concat(F.lit(" "), F.array_join(plain, " "), F.lit(" "))
    cue = F.arrays_overlap(plain, F.array(*map(F.lit, SIZE_CUES)))
    many = sorted(((" ".join(sp.replace("-", " ").split()), canon) for canon, sps in LETTER_SIZES.items() for sp in sps if " " in sp or "-" in sp), key=lambda kv: -len(kv[0].split()))
    rest, found = padded, []
    for words, canon in many:
        found.append(F.when(rest.contains(f" {words} "), F.lit(canon)))
        rest = F.replace(rest, F.lit(f" {words} "), F.lit(" | "))
    spelled = F.create_map(*(F.lit(x) for canon, sps in LETTER_SIZES.items() for sp in sps if " " not in sp and "-" not in sp for x in (sp, canon)))
    left = F.filter(F.split(F.trim(rest), " "), lambda x: spelled[x].isNotNull() & (cue | ~x.isin(*CUE_GATED)))
    letters = F.array_distinct(F.concat(F.array_compact(F.array(*found)), F.transform(left, lambda x: spelled[x])))
    raw = F.regexp_extract_all(low, F.lit("[a-z0-9]+(?:[/-][0-9]+)?"), F.lit(0))
    numbers = F.filter(raw, lambda x: x.rlike("^[0-9]{1,3}[/-][0-9]{1,3}$") | (x.rlike("^[0-9]{1,3}$") & cue))
    return F.concat(letters, F.array_distinct(F.transform(numbers, digit_set)))


def digit_set(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]{1,3}"), F.lit(0)))), "/")


def value_size(name: Column) -> Column:
    """The canonical size of a facet value: a letter size, else its digits."""
    spelled = F.create_map(*(F.lit(x) for canon, sps in LETTER_SIZES.items() for sp in sps for x in (sp, canon)))
    return F.coalesce(spelled[F.lower(F.trim(name))], F.nullif(digit_set(name), F.lit("")))


def numeric_signature(c: Column) -> Column:
    """All numbers, sorted, so that 10x20 and 20x10 agree."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit("[0-9]+"), F.lit(0))), "x")


def stem(c: Column) -> Column:
    """Plural endings off, final v and z unvoiced, double vowels single."""
    s = F.lower(c)
    s = F.when(F.length(s) > 4, F.regexp_replace(s, "(en|s|es|'s)$", "")).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, "v$", "f"), "z$", "s")
    return F.regexp_replace(s, r"([aeou])\1+", "$1")


#: Formats of dates in uploads, in the order they are tried.
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyyMMdd", "yyyy/MM/dd", "ddMMyyyy")


def coerce_date(c: Column) -> Column:
    return F.coalesce(*(F.try_to_date(F.trim(c), f) for f in DATE_FORMATS))


def campaign_tag(name: Column, tag: str) -> Column:
    return F.nullif(F.regexp_extract(name, rf"\[{tag}:([^\]]*)\]", 1), F.lit(""))


def campaign_family(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.startswith("gsd"), "gsd").when(low.startswith("dma"), "dma").when(low.contains("theme"), "theme").otherwise("other")
