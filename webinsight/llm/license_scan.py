"""License scans (native: DataFrame functions only): an exact set-similarity join of text blocks with license templates.

A text's words are read in blocks of BLOCK words, half a block apart, so that any stretch of half a block lies whole in one. A
block is the set of its words that some template has; a template is found in it when it holds CONTAINMENT of the template's
words or more, that is `need` of them. Three filters find every such pair without comparing all of them:

- prefix: words are ordered by how many blocks of the corpus have them, rarest first. A block that holds `need` of a template's
  n words has one of the template's first n - need + 1, among its own first m - least + 1 (least: the smallest `need` of all);
- length: a block of fewer than `need` words can't match;
- position: words after the shared one, on either side, must be enough to make up `need`.

Blocks are joined to the templates' prefixes on the word; templates are a parameter (MAX_TEMPLATES at most), so that table is
broadcast. What is left is checked exactly. A template whose words are all words of another one found in the same block says no
more than that one, and is left out. Phrases are searched beside it, word by word.

Word counts of blocks cover the whole corpus. Blocks stay in their text's row until the join; no block meets another one.

Defined results: a null text counts as empty: no words, no labels, score 0. A null id is passed through; repeated rows are
scanned each on its own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A word is a run of letters, digits and whatever isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 64
CONTAINMENT = 0.9
MAX_TEMPLATES = 1000
#: The score of a text with a phrase and no template.
PHRASE_SCORE = 0.5
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Wording of public licenses. Variants that differ in a word or two are short, so that all their words are needed.
TEMPLATES = (
    ("mit-notice", "mit", "Released under the MIT License"),
    ("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice-kept", "mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-notice", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache-compliance", "apache", "you may not use this file except in compliance with the License"),
    ("apache-as-is", "apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"),
    ("gpl", "gpl", "under the GNU General Public License"),
    ("lgpl", "lgpl", "under the GNU Lesser General Public License"),
    ("agpl", "agpl", "under the GNU Affero General Public License"),
    ("bsd-conditions", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "mpl", "subject to the terms of the Mozilla Public License"),
    ("isc-grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "cc0", "dedicated to the public domain under CC0"),
)
#: Its lower case is an ASCII letter; only A-Z are folded here.
KELVIN = "K"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("�"))), F.lit(WORD), F.lit(0))


def word_set(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))))


def need(n: int, containment: float = CONTAINMENT) -> int:
    """Words that a block must hold of a template's n."""
    return max(1, math.ceil(n * containment - 1e-9))


def phrase_places(w: Column, phrases=PHRASES) -> Column:
    """Of a text's words: (start, label) of every place where a phrase stands."""
    def places(p: list[str], label: str) -> Column:
        ends = F.filter(F.transform(w, lambda x, i: F.when(x == p[-1], i - (len(p) - 1))), lambda i: i >= 0)
        whole = F.filter(ends, lambda i: reduce(and_, (F.get(w, i + k) == x for k, x in enumerate(p[:-1])), F.lit(True)))
        return F.transform(whole, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*(places(phrase.split(), label) for phrase, label in phrases))


def blocks(w: Column, vocabulary: list[str], least: int, size: int = BLOCK) -> Column:
    """(start, words) of each block with `least` words of the vocabulary or more."""
    listed, step = F.array(*map(F.lit, vocabulary)), size // 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - step) / step).cast("int") - 1, F.lit(0)))
    each = F.transform(starts, lambda k: F.struct((k * step).cast("long").alias("start"), F.array_intersect(F.slice(w, k * step + 1, size), listed).alias("words")))
    return F.filter(each, lambda b: F.size(b["words"]) >= least)


def _read(docs: DataFrame, templates, phrases, containment: float, size: int, text: str, key: str) -> DataFrame:
    """Per row of docs, written once: uid, key, n_words, places of phrases, blocks."""
    sets = [word_set(t) for _, _, t in templates]
    vocabulary, least = sorted({x for s in sets for x in s}), min((need(len(s), containment) for s in sets), default=1)
    last = [p.split()[-1] for p, _ in phrases]
    one = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key), words(F.col(text)).alias("w"))
    # Most texts lack a phrase's last word: only the others are walked.
    any_last = F.arrays_overlap("w", F.array(*map(F.lit, last)))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    one = one.select("uid", key, F.size("w").cast("long").alias("n_words"), F.when(any_last, phrase_places(F.col("w"), phrases)).otherwise(none).alias("places"), blocks(F.col("w"), vocabulary, least, size).alias("blocks"))
    return common.stage(one, "license-words")


def _matches(read: DataFrame, templates, containment: float) -> DataFrame:
    """uid, start, template, label, overlap, containment of every block that holds enough of a template."""
    spark = read.sparkSession
    sets = {name: word_set(t) for name, _, t in templates}
    if len(templates) > MAX_TEMPLATES or len(sets) < len(templates):
        raise ValueError(f"{MAX_TEMPLATES} templates of different names at most")
    wide = read.select("uid", F.explode("blocks").alias("b")).select("uid", "b.start", F.col("b.words").alias("words"))
    # As many rows as the templates have words.
    seen = {r["word"]: r["count"] for r in wide.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    order = sorted({x for s in sets.values() for x in s}, key=lambda x: (seen.get(x, 0), x))
    rank = {x: i for i, x in enumerate(order)}
    least = min((need(len(s), containment) for s in sets.values()), default=1)
    rows, above = [], {name: [o for o, s in sets.items() if set(s) > set(mine)] for name, mine in sets.items()}
    for name, label, _ in templates:
        s = sorted(sets[name], key=rank.__getitem__)
        rows += [(s[i], name, label, i, len(s), need(len(s), containment), s, above[name]) for i in range(len(s) - need(len(s), containment) + 1)]
    index = spark.createDataFrame(rows, "word string, template string, label string, at int, n int, need int, all array<string>, above array<string>")
    by_rank = F.array(*map(F.lit, order))
    ordered = wide.withColumn("words", F.array_intersect(by_rank, F.col("words")))
    first = ordered.withColumn("m", F.size("words")).select("*", F.posexplode(F.slice("words", 1, F.col("m") - (least - 1))).alias("pos", "word"))
    room = F.least(F.col("m") - F.col("pos"), F.col("n") - F.col("at"))  # the shared word and those after it
    close = first.join(F.broadcast(index), "word").filter((F.col("m") >= F.col("need")) & (room >= F.col("need")))
    overlap = F.size(F.array_intersect("all", "words"))
    # A pair that shares several prefix words is kept at the first of them.
    shared = F.array_position("words", F.element_at(F.array_intersect("words", F.slice("all", 1, F.col("n") - F.col("need") + 1)), 1)) - 1
    found = close.filter(F.col("pos") == shared).withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))
    found = found.groupBy("uid", "start").agg(F.collect_list(F.struct("template", "label", "overlap", "n", "above")).alias("found"))
    names = F.transform("found", lambda x: x["template"])
    kept = F.filter("found", lambda x: ~F.arrays_overlap(x["above"], names))
    found = found.select("uid", "start", F.explode(kept).alias("x"))
    return found.select("uid", "start", "x.template", "x.label", F.col("x.overlap").cast("long").alias("overlap"), (F.col("x.overlap") / F.col("x.n")).alias("containment"))


def license_blocks(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, size: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every block that a template is found in: key, start (its first word), template, label, overlap, containment."""
    read = _read(docs, templates, PHRASES, containment, size, text, key)
    return read.select("uid", key).join(_matches(read, templates, containment), "uid").drop("uid")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT, size: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks (with a template)."""
    read = _read(docs, templates, phrases, containment, size, text, key)
    by_text = _matches(read, templates, containment).groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.count_distinct("start").alias("n_blocks"))
    out = read.drop("blocks").join(by_text, "uid", "left")
    starts, base = F.col("places.start"), F.array_distinct("places.label")
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    none = F.array().cast("array<string>")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0))
    return out.select(
        key,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.array_union(base, F.coalesce("more", none))).alias("labels"),
        score.alias("score"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )
