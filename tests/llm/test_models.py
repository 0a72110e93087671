"""Language model, classifiers, extraction and piece sampling: brute force, held-out accuracy, exact round trips."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webinsight.llm import brown_lm, gbdt, html_extraction, piece_sampling, quality_classifier, toxicity
from webinsight.llm.common import documents

from ..conftest import SF
from .test_exact_and_rules import ODD, SCHEMA

SF1 = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n1 = int(y.sum())
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_base_scores_brute_force(spark):
    docs = documents(spark, SF)
    rows = docs.select("doc_id", "text").collect()
    c = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            c.update((r["text"] or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in brown_lm.score_documents(docs).collect()}
    for r in rows:
        w = (r["text"] or "").encode().lower().split() + [None]
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    held = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


@pytest.mark.parametrize("known", [200_000, 300, 0])
def test_class_scores_brute_force(spark, monkeypatch, known):
    """The model's probabilities from its classes alone, recounted; with fewer listed words, more are looked up by join."""
    monkeypatch.setattr(brown_lm, "KNOWN", known)
    monkeypatch.setattr(brown_lm.listed_words, "__defaults__", (known, brown_lm.MIN_COUNT))
    docs = documents(spark, SF)
    train = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    model, counts = brown_lm.train_model(train)
    assert len(model.symbols.ids) <= known
    split = lambda t: (t or "").encode().lower().split()
    end = len(model.symbols) - 1
    classed = lambda ws: [int(model.classes[i]) for i in (end, *model.symbols.of(ws), end)]
    c, into, pairs, outof = Counter(), Counter(), Counter(), Counter()
    for r in train.collect():
        ws = split(r["text"])
        c.update(ws)
        k = classed(ws)
        pairs.update(zip(k, k[1:]))
        outof.update(k[:-1])
        into.update(k[1:])
    kinds, tokens = Counter(), Counter()
    for w, n in c.items():
        (k,) = classed([w])[1:-1]
        kinds[k] += 1
        tokens[k] += n
    size, every = brown_lm.CLASSES + brown_lm.TAIL + 1, sum(into.values())
    share = lambda k: (into[k] + 0.5) / (every + 0.5 * size)
    step = lambda a, b: (pairs[a, b] + brown_lm.ALPHA * share(b)) / (outof[a] + brown_lm.ALPHA)
    emit = lambda w, k: (c[w] + 0.5) / (tokens[k] + 0.5 * (kinds[k] + 1))
    got = {r["doc_id"]: r["score"] for r in brown_lm.score(docs, model, counts).collect()}
    for r in docs.collect():
        ws = split(r["text"])
        k = classed(ws)
        want = sum(math.log10(step(a, b)) for a, b in zip(k, k[1:])) + sum(math.log10(emit(w, q)) for w, q in zip(ws, k[1:]))
        assert got[r["doc_id"]] == pytest.approx(want, rel=1e-9)


def test_rarer_words_are_placed_by_exchange(spark, monkeypatch):
    """Words too rare for the rounds end in the classes of their own language's frequent words."""
    monkeypatch.setattr(brown_lm, "EXCHANGE", 60)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        mark = "ab"[i % 2]
        rows.append((i, " ".join(f"{mark}{k}" if k < 6 else f"{mark}rare{k}{mark}" for k in rng.choice(40, 60, p=[0.13] * 6 + [0.22 / 34] * 34)), "x", "s", 1))
    model, _ = brown_lm.train_model(spark.createDataFrame(rows, SCHEMA))
    often = {c: w[:1] for w, i in model.symbols.ids.items() if len(w) == 2 for c in [int(model.classes[i])]}
    others = [(w[:1], int(model.classes[i])) for w, i in model.symbols.ids.items() if b"rare" in w]
    assert len(others) == 68 and all(often[c] == mark for mark, c in others)


def test_exchange_separates_two_languages(spark):
    """Words of two languages that never meet end in classes of one language each."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 12, 60)), "x", "s", 1) for i in range(300)]
    train = spark.createDataFrame(rows, SCHEMA)
    model, _ = brown_lm.train_model(train)
    seen = defaultdict(set)
    for w, i in model.symbols.ids.items():
        seen[int(model.classes[i])].add(w[:1])
    assert all(len(s) == 1 for s in seen.values())


def test_model_probabilities_sum_to_one(spark):
    model, _ = brown_lm.train_model(documents(spark, SF))
    assert np.allclose((10**model.step).sum(axis=1), 1)


def test_lm_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"word": F.lit(1), "n": F.lit(1), "rare": F.lit("x")})
    rows = brown_lm.score_documents(docs).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert brown_lm.score_documents(docs.limit(0)).count() == 0


def test_forest_learns_and_flattens():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = gbdt.fit(x, y)
    assert auc(f.predict(x), y) > 0.98

    def walk(row):
        z = f.base
        for root in f.roots:
            node = root
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.line[node] else f.right[node]
            z += f.value[node]
        return 1 / (1 + math.exp(-z))

    assert np.allclose(f.predict(x[:50]), [walk(r) for r in x[:50]])
    assert gbdt.fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]


@pytest.mark.parametrize(("run", "label", "least"), [(quality_classifier.classify, "quality", 0.95), (toxicity.classify, "toxic", 0.9)])
def test_held_out_accuracy(spark, run, label, least):
    docs, labels = documents(spark, SF1), spark.read.parquet(f"{SF1}/labels.parquet")
    rows = run(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert auc(np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])) > least


@pytest.mark.parametrize(("run", "label"), [(quality_classifier.classify, "quality"), (toxicity.classify, "toxic")])
def test_classifiers_on_odd_rows(spark, run, label):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"y": F.lit(1), "score": F.lit(0.1), "fold": F.lit(2)})
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)] + [(None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    rows = run(docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert run(docs, labels.limit(0)).count() == len(ODD)
    assert run(docs.limit(0), labels).count() == 0


def test_planted_insults(spark):
    rng = np.random.default_rng(5)
    text = lambda bad: " ".join("vile" if bad and k % 25 == 0 else f"w{rng.integers(0, 60)}" for k in range(80))
    docs = spark.createDataFrame([(i, text(i % 5 == 0), "en", "s", 1) for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    for r in toxicity.classify(docs, labels).collect():
        assert r["predicted"] == int(r["doc_id"] % 5 == 0)


def test_many_insults_in_few_texts_each(spark):
    """400 made-up insults without a common stem, each in about five labelled texts."""
    rng = np.random.default_rng(8)
    made = lambda n, size: ["".join(chr(97 + c) for c in rng.integers(0, 26, size)) for _ in range(n)]
    insults, common_words = made(400, 8), made(3000, 6)
    share = 1 / np.arange(1, len(common_words) + 1)
    rows, labels = [], []
    for i in range(5000):
        words = list(rng.choice(common_words, 60, p=share / share.sum()))
        if bad := i % 5 == 0:
            for at in rng.integers(0, 60, 3):
                words[at] = insults[rng.integers(0, len(insults))]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = [r for r in toxicity.classify(docs, labels).collect() if r["held_out"]]
    clean = sorted(r["score"] for r in got if r["doc_id"] % 5)
    toxic = [r["score"] for r in got if r["doc_id"] % 5 == 0]
    assert np.mean(np.array(toxic) > clean[int(0.9 * len(clean))]) >= 0.8


@pytest.mark.parametrize("bad", [False, True])
def test_one_very_long_text_leaves_others_alone(spark, bad):
    rng = np.random.default_rng(5)
    text = lambda vile: " ".join("vile" if vile and k % 25 == 0 else f"w{rng.integers(0, 60)}" for k in range(80))
    rows = [(i, text(i % 5 == 0), "en", "s", 1) for i in range(400)]
    trained = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2 and (i % 5 == 0) == bad]
    at = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in trained], "i bigint").select("i", F.xxhash64("i").alias("h")).collect()}
    first = min(trained, key=at.get)
    rows[first] = (first, "so it goes " * 333_334, "en", "s", 1)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    for r in toxicity.classify(spark.createDataFrame(rows, SCHEMA), labels).collect():
        if r["doc_id"] != first:
            assert r["predicted"] == int(r["doc_id"] % 5 == 0)


def test_class_models_brute_force(spark):
    """Kneser-Ney probabilities of both classes, computed from their definition."""
    rng = np.random.default_rng(4)
    texts = [(" ".join(rng.choice(["abcde", "abcdefgh", "abcdxyz", "ab", "moron", "morons", "the", "cat", "cathedral"], 12, p=[0.1, 0.1, 0.1, 0.1, 0.05 + 0.1 * y, 0.15 - 0.1 * y, 0.2, 0.1, 0.1])).encode(), y) for y in (0, 1) for _ in range(40)]
    sample = spark.createDataFrame([(bytearray(t), y, i % 4) for i, (t, y) in enumerate(texts)], "text binary, y int, fold int")
    model = toxicity.models(toxicity.text_pairs(sample).cache(), "n")
    pairs = [Counter(), Counter()]
    for t, y in texts:
        w = t.split()
        pairs[y].update(set(zip([b"", *w], w)))

    def steps(w):
        cut = [w[:n] for n in toxicity.PREFIXES if len(w) > n]
        return list(zip([*cut, w + b" "], [b"", *cut], [*range(len(cut)), 3]))

    nodes, parent, level = [Counter(), Counter()], {}, {}
    for y in (0, 1):
        for h, w in pairs[y]:
            for node, up, at in steps(w):
                nodes[y][node] += 1
                parent[node], level[node] = up, at
    coc = lambda values: toxicity.discounts(*(sum(v == k for v in values) for k in (1, 2, 3, 4)))
    d = {(y, at): coc([c for n, c in nodes[y].items() if level[n] == at]) for y in (0, 1) for at in range(4)}
    top = [coc(pairs[y].values()) for y in (0, 1)]
    less = lambda c, d: max(c - (0, *d)[min(c, 3)], 0)

    def low(y, w):
        p = 1.0
        for node, up, at in steps(w):
            mine = lambda k, up=up: [n for n in nodes[k] if parent[n] == up]
            total = [sum(nodes[k][n] for n in mine(k)) for k in (0, 1)]
            shared = (nodes[0][node] + nodes[1][node]) / sum(total)
            left = sum(nodes[y][n] - less(nodes[y][n], d[y, level[n]]) for n in mine(y)) / total[y] if total[y] else 1
            p *= (less(nodes[y][node], d[y, at]) / total[y] if total[y] else 0) + left * shared
        return p

    def high(y, h, w):
        own = {k: c for k, c in pairs[y].items() if k[0] == h}
        total = sum(own.values())
        left = sum(c - less(c, top[y]) for c in own.values()) / total if total else 1
        return (less(own.get((h, w), 0), top[y]) / total if total else 0) + left * low(y, w)

    checked = 0
    for h, w in pairs[0].keys() | pairs[1].keys():
        if max(pairs[0][h, w], pairs[1][h, w]) > 1:
            a = model.symbols.words[h] if h else len(model.symbols) - 1
            got = model.log_ratios(np.array([a]), np.array([model.symbols.words[w]]))[0]
            assert got == pytest.approx(math.log(high(1, h, w) / high(0, h, w)), rel=1e-9, abs=1e-12)
            checked += 1
    assert checked > 40


@pytest.mark.parametrize("run", [quality_classifier.classify, toxicity.classify])
def test_classifiers_keep_text_ids(spark, run):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    named = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    got = run(docs.withColumn("doc_id", named), labels.withColumn("doc_id", named)).collect()
    assert {r["doc_id"] for r in got} == {f"d{r['doc_id']}" for r in docs.select("doc_id").collect()}


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


@pytest.fixture(scope="module")
def forest(spark):
    return html_extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"), 100)


def test_extraction_finds_the_article(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    truth = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(b|br|a)[^>]*>", lambda m: " " if m[1] == "br" else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        truth[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages, 100).collect()}
    assert got == truth


def words_of(text):
    return text.split()


def bare(html):
    """The page without telling tags and attributes."""
    import re

    html = re.sub(r"<(/?)(?:article|main|nav|menu|aside|footer|header|form)\b", r"<\1div", html)
    return re.sub(r"<(div|p|ul|li|section|span|h[1-6]|a)\s[^>]*>", r"<\1>", html)


def test_pages_without_landmarks_and_known_names(spark):
    """Words found and words wrong on pages whose tags and attributes tell nothing, and on ones with unknown names."""
    from collections import Counter

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: Counter(words_of(r["text"])) for r in html_extraction.extract(pages, 100).collect()}
    forest = html_extraction.fit(pages, 100)
    hit = found = every = 0
    for r in pages.collect():
        got = Counter(words_of(html_extraction.main_text(bare(r["html"]), forest)))
        hit, found, every = hit + (got & want[r["page_id"]]).total(), found + got.total(), every + want[r["page_id"]].total()
    assert hit / every > 0.9 and hit / max(found, 1) > 0.8


@pytest.mark.parametrize(("body", "text"), [("un<wbr>believable", "unbelievable"), ("x<img src=a>y", "xy"), ("a<br>b", "a b"), ("a &amp; <b>b</b>\n c", "a & b c")])
def test_what_is_white_space(body, text):
    page_ = html_extraction.Page(page(f"<p>{body}</p>"))
    assert html_extraction._SPACE.sub(" ", "".join(x for _, _, x in page_.text)).strip() == text


@pytest.mark.parametrize("body", ["<div>" * 30000 + "</p>" * 30000, "<ul><li>" + "<div>" * 20000 + "<li></li>" * 20000, "<i><div>" + "<b>" * 20000 + "</i>" * 20000, "<td>" * 20000 + "<tr>" * 20000])
def test_parsing_is_linear(body):
    import time

    began = time.process_time()
    html_extraction.features(html_extraction.Page(page(body)).nodes)
    assert time.process_time() - began < 20


def test_pages_that_are_not_utf8(spark, forest):
    pages = spark.createDataFrame([(1, "u", bytearray(b"<article><p>caf\xe9 is open all day</p></article>"))], "page_id int, url string, raw binary").select("page_id", "url", F.expr("cast(raw as string)").alias("html"))
    (got,) = html_extraction.extract(pages).collect()
    assert got["n_chars"] == len(got["text"])


def test_hierarchical_decoding_is_consistent():
    nodes = [html_extraction.Node("html", -1, 0)] + [html_extraction.Node("div", max(0, i // 2), 1, own=10 * i) for i in range(30)]
    rng = np.random.default_rng(2)
    for _ in range(50):
        keep = html_extraction.decode(nodes, rng.uniform(size=len(nodes)))
        assert all(keep[x.parent] for i, x in enumerate(nodes) if keep[i] and x.parent >= 0)


def test_extraction_of_odd_pages(spark, forest):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "no tags at all"), (4, "u", page("<p>open <b>bold<p>next")), (5, "u", "<<<>>><a<b"), (1, "u", None), (None, None, page("<div>" * 300 + "deep"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extraction.extract(pages).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html_extraction.extract(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return piece_sampling.Vocabulary.load()


def test_sampling_without_replacement_has_the_right_distribution(vocabulary):
    """First and second draws of a small lattice against its exact probabilities."""
    v, text, n = vocabulary, "the cat", 6000
    ids = {p: i for i, p in enumerate(v.pieces) if p}

    def every(c):
        return [((), 0.0)] if not c else [((ids[c[:k]], *a), w + v.weight[ids[c[:k]]]) for k in range(1, len(c) + 1) if c[:k] in ids for a, w in every(c[k:])]

    z = math.log(sum(math.exp(w) for _, w in every(" " + text)))
    p = {a: math.exp(w - z) for a, w in every(" " + text)}
    drawn = defaultdict(list)
    for row, _, log_p, inclusion, got in piece_sampling.sample([text] * n, [piece_sampling.row_key(i, "t") for i in range(n)], v, 2, 1.0):
        key = tuple(got.tolist())
        assert math.exp(log_p) == pytest.approx(p[key]) and inclusion <= 0
        drawn[row].append(key)
    assert all(len(set(d)) == 2 for d in drawn.values())
    first, pairs = Counter(d[0] for d in drawn.values()), Counter(map(tuple, drawn.values()))
    for a in p:
        assert first[a] / n == pytest.approx(p[a], abs=5 * math.sqrt(0.25 / n))
        for b in p:
            if a != b:
                assert pairs[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=5 * math.sqrt(0.25 / n))


def test_all_segmentations_of_a_tiny_text(vocabulary):
    got = list(piece_sampling.sample(["a"], [1], vocabulary, 5, 1.0))
    assert len(got) == 2 and sum(math.exp(g[2]) for g in got) == pytest.approx(1) and all(g[3] == 0 for g in got)


def test_round_trip_and_determinism(spark, vocabulary):
    docs = spark.createDataFrame([*ODD, (20, "tab\there\r\nß🙂▁  x ", "x", "s", 1), (21, "日本語 テキスト", "x", "s", 1)], SCHEMA).filter("doc_id is not null").dropDuplicates(["doc_id"])
    out = piece_sampling.encode(docs, k=3)
    back = {(r["doc_id"], r["sample"]): r["text"] for r in piece_sampling.decode(out).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {i for i, _ in back} == set(texts)
    assert all(t == texts[i] for (i, _), t in back.items())
    key = lambda df: sorted((r["doc_id"], r["sample"], r["ids"], round(r["log_inclusion"], 9)) for r in df.collect())
    assert key(out) == key(piece_sampling.encode(docs.repartition(5), k=3))


def test_sampling_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"sample": F.lit(1), "ids": F.lit("x")})
    rows = piece_sampling.encode(docs, k=2, digest=True).collect()
    assert all(r["decodes"] for r in rows) and all(r["log_inclusion"] <= 0 for r in rows)
    assert [r["n_pieces"] for r in rows if r["doc_id"] in (3, 4)] == [0, 0]
    assert piece_sampling.encode(docs.limit(0)).count() == 0


def test_pieces_of_bytes_that_are_not_utf8(spark):
    raw = [b"\xff\x41\xfe\x20\xc3", b"", None, b"ok \xed\xa0\x80 then", "é".encode()[:1]]
    docs = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(raw)], "doc_id bigint, b binary").select("doc_id", F.expr("cast(b as string)").alias("text"))
    out = piece_sampling.encode(docs, k=2, check=True)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == set(range(len(raw))) and all(r["decodes"] for r in rows)
    back = piece_sampling.decode(out).select("doc_id", F.col("text").cast("binary").alias("b")).collect()
    assert all(bytes(r["b"]) == (raw[r["doc_id"]] or b"") for r in back)


def test_words_are_solved_once_and_alike(vocabulary, monkeypatch):
    """Later batches solve only words that no earlier one had, and samples don't depend on what was solved before or is let go."""
    solve, solved = piece_sampling.lattices, []
    monkeypatch.setattr(piece_sampling, "lattices", lambda codes, *more: solved.append(len(codes)) or solve(codes, *more))
    texts = ["the cat sat\n on the mat", "the cat sat", "", "\nthe  cat ", " ", "\n\nthe\n", "a \nb", "sat 🙂 \udcc3", "\udca9 the mat"] * 3
    keys = [piece_sampling.row_key(i, "t") for i in range(len(texts))]
    once = list(piece_sampling.sample(texts, keys, vocabulary, 3, 1.0))
    every = {(r, s): (p, i.tolist()) for r, s, p, _, i in once}
    assert all(vocabulary.decode(i) == texts[r].encode(errors="surrogateescape") for r, _, _, _, i in once)
    for held in (0, 9, 1000):
        store, got = piece_sampling.Solved(vocabulary, 1.0, held), {}
        solved.clear()
        for at in range(0, len(texts), 9):
            got |= {(at + r, s): (p, i.tolist()) for r, s, p, _, i in piece_sampling.sample(texts[at : at + 9], keys[at : at + 9], vocabulary, 3, 1.0, store)}
            assert sum(piece_sampling._chunk_codes(store.keys)[1]) <= held
        assert got.keys() == every.keys() and all(got[x][1] == every[x][1] and got[x][0] == pytest.approx(every[x][0]) for x in every)
        assert solved[1:] == [0, 0] if held == 1000 else all(solved[1:])
    # Sums at a node are the same to the last bit beside any other chunks.
    alone, beside = (solve(*piece_sampling._codes(c), vocabulary, 1.0) for c in ([" the"], [f" w{i}" for i in range(20000)] + [" the"]))
    assert (alone.upto == beside.upto[-len(alone.upto) :]).all() and (alone.log_p == beside.log_p[-len(alone.log_p) :]).all()


@pytest.mark.parametrize(("run", "label"), [(quality_classifier.fit, "quality"), (toxicity.fit, "toxic")])
def test_one_row_of_an_id_is_learnt_from(spark, run, label):
    """An id with very many rows doesn't make the sample grow."""
    rows = [(i % 9, f"text number {i}", "en", "s", 1) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = run(docs, labels), run(docs.repartition(7), labels)
    score = lambda m: m.predict(np.ones((1, quality_classifier.N_FEATURES))) if label == "quality" else m.score(np.ones((1, 4)))
    assert np.allclose(score(a), score(b))


def test_pieces_in_stage_of_pipeline_take_bytes(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, bytearray(b"\xffA \xc3"), "en", "s", 1)], "doc_id bigint, b binary, lang string, source string, n_chars bigint")
    docs = docs.select("doc_id", F.expr("cast(b as string)").alias("text"), "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() >= 1 and docs.filter("not decodes").count() == 0


def test_features_in_slices_and_equal_seed_pages(spark, monkeypatch):
    """Slices change nothing; a page that is there many times is learnt from once."""
    html = "<html><body><div class='menu'><a href='/'>x</a></div><article>" + "".join(f"<p>Some text {i}, of words.</p>" for i in range(40)) + "</article></body></html>"
    nodes = html_extraction.Page(html).nodes
    f = html_extraction.features(nodes)
    monkeypatch.setattr(html_extraction, "SLICE", 7)
    parts = list(f.slices())
    assert len(parts) > 5 and all(len(p) <= 7 for p in parts) and np.array_equal(np.concatenate(parts), f.rows(np.arange(len(nodes))))
    pages = spark.createDataFrame([(i, "u", html) for i in range(50)] + [(50, "v", html.replace("Some", "Other"))], "page_id bigint, url string, html string")
    assert {r["text"] for r in html_extraction.extract(pages, 2).collect()} == {"\n\n".join(f"{w} text {i}, of words." for i in range(40)) for w in ("Some", "Other")}
