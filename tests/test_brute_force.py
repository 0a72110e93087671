"""Queries without SQL against plain Python over the same input rows; a test is named after its query."""

import re
from collections import defaultdict
from urllib.parse import unquote

import pytest

from webinsight.operators import coverage as C
from webinsight.operators import keywords as K
from webinsight.plans import coverage as plans_coverage
from webinsight.plans import keywords as plans_keywords
from webinsight.plans import load
from webinsight.plans import urls as plans_urls
from webinsight.plans.registry import Tables

from .conftest import SF

QUERIES = load().QUERIES


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def covered(rows, weights, cap):
    """Half visit and half revenue coverage of the best `cap` rows of each category."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["main_cat"]].append((-sum(w * r[f"{c}_pct"] for c, w in weights.items()), r["npath"], r["v"], r["m"]))
    top = [x for g in groups.values() for x in sorted(g, key=lambda x: (round(x[0], 12), x[1]))[:cap]]
    return sum(0.5 * sum(x[i] for x in top) / sum(r[k] for r in rows) for i, k in ((2, "v"), (3, "m")))


def ascent(t, frame, target, names, cap=300, rounds=4):
    for c in names:
        frame = C.rank_pct(frame, "main_cat", c)
    goal = {r["npath"]: (r["visits"], r["revenue"]) for r in target.collect()}
    rows = [r.asDict() | dict(zip("vm", goal.get(r["npath"], (0, 0.0)), strict=True)) for r in frame.collect()]
    weights, best = dict.fromkeys(names, 1.0), -1.0
    for _ in range(rounds):
        before = dict(weights)
        for c in names:
            old = weights[c]
            for w in sorted((0.0, 0.5, 1.0, 2.0, 4.0), key=lambda w: (abs(w - old), w)):
                value = covered(rows, weights | {c: w}, cap)
                if value > best + 1e-12:
                    best, weights[c] = value, w
        if before == weights:
            break
    return weights, best


def test_cov_16_backtest_weights(spark, t):
    frame, target = plans_coverage._frame(t)
    weights, best = ascent(t, frame, target, C.FEATURES)
    got = QUERIES["cov_16_backtest_weights"](spark, SF).collect()
    assert all(r["objective"] == pytest.approx(best) for r in got)
    assert {r["feature"]: r["weight"] for r in got} == weights


def test_cov_16_coverage_curve(spark, t):
    frame, target = plans_coverage._frame(t)
    goal = {r["npath"]: r["visits"] for r in target.collect()}
    groups = defaultdict(list)
    for r in C.blend_score(frame, "main_cat").collect():
        groups[r["main_cat"]].append((-r["score"], -r["visits"], r["npath"]))
    every = sum(goal.get(x[2], 0) for g in groups.values() for x in g)
    for r in QUERIES["cov_16_coverage_curve"](spark, SF).collect():
        top = sum(goal.get(x[2], 0) for g in groups.values() for x in sorted(g)[: r["cap"]])
        assert r["coverage_pct"] == pytest.approx(100 * top / every)


def test_cov_21_feature_ablation(spark, t):
    frame, target = plans_coverage._frame(t)
    volume = defaultdict(lambda: None)
    for r in t("v_keywords").collect():
        word = r["keyword"].split(" ")[0]
        volume[word] = max(volume[word] or 0, r["volume"])
    words = [(r["npath"], volume[(re.search("color_([a-z]+)", r["npath"]) or [None, ""])[1]]) for r in frame.select("npath").collect()]
    wide = frame.join(spark.createDataFrame(words, "npath string, volume bigint").distinct(), "npath")
    got = {r["variant"]: r["objective"] for r in QUERIES["cov_21_feature_ablation"](spark, SF).collect()}
    assert got["without"] == pytest.approx(ascent(t, frame, target, C.FEATURES)[1])
    assert got["with_volume"] == pytest.approx(ascent(t, wide, target, (*C.FEATURES, "volume"))[1])


def norm(s):
    return " ".join(re.sub(r"[^a-zA-Z0-9\s]", "", re.sub("[-_]", " ", s)).split()).lower()


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b))


def best_match(query, values, synonyms, strict=()):
    k, tight, found = norm(query), lambda s: re.sub("[^a-z0-9]", "", s), []
    for i, v, n in values:
        vk = norm(v)
        if k == vk:
            found.append((100.0, n, -i, "exact"))
        elif tight(k) == tight(vk):
            found.append((99.0, n, -i, "measure"))
        elif vk in synonyms.get(k, ()):
            found.append((95.0, n, -i, "synonym"))
    if not found:
        for i, v, n in values:
            vk = norm(v)
            if min(len(k), len(vk)) >= 3 and min(len(k), len(vk)) >= 0.4 * max(len(k), len(vk)) and ratio(k, vk) >= (95 if i in strict else 80):
                found.append((ratio(k, vk), n, -i, "fuzzy"))
    if found:
        score, n, i, how = max(found)
        return -i, how, round(score, 9)


def test_key_05_match_keywords(spark, t):
    values = [(r["value_id"], r["value"], r["count"]) for r in plans_keywords.values(t).collect()]
    synonyms = {"red widgets": ["red widget"], "small rings": ["small ring"]}
    want = {r["query"]: best_match(r["query"], values, synonyms) for r in plans_keywords.misspelt(t).distinct().collect()}
    got = {r["query"]: (r["value_id"], r["how"], round(r["score"], 9)) for r in QUERIES["key_05_match_keywords"](spark, SF).collect()}
    assert got == {q: b for q, b in want.items() if b}


def test_errors_at_every_position(spark):
    """No near pair is lost wherever the error is, the first letters included; strict facets need more."""
    words = ["widget", "kettingzaag", "lamp", "hoge tuinstoel met kussen", "abc"]
    values = [(i, w, 10 + i) for i, w in enumerate(words)]
    queries = {w[:i] + x + w[i + d :] for w in words for i in range(len(w) + 1) for d, x in ((0, "q"), (1, ""), (1, "q"), (2, ""))} | {"wdiget", "gewidt", "x"}
    df = spark.createDataFrame([(*v, "Merk" if v[0] == 1 else "Kleur") for v in values], "value_id int, value string, count int, facet string")
    got = K.match_keywords(spark.createDataFrame([(q,) for q in queries], "query string"), df, spark.createDataFrame([], "word string, meaning string")).collect()
    want = {q: best_match(q, values, {}, strict={1}) for q in queries}
    assert {r["query"]: (r["value_id"], r["how"], round(r["score"], 9)) for r in got} == {q: b for q, b in want.items() if b}


def test_common_length_of_long_texts():
    a, b = ["ab" * 70 + "c", "x" * 64, "", "kat"], ["ba" * 80, "x" * 63 + "y", "abc", "tak"]
    want = [round(ratio(x, y) * (len(x) + len(y)) / 200) if x and y else 0 for x, y in zip(a, b, strict=True)]
    assert K.common_length(a, b).tolist() == want


def stem(w):
    if len(w) > 4:
        w = re.sub("(en|s|es|'s)$", "", w)
    return re.sub(r"([aeou])\1+", r"\1", re.sub("z$", "s", re.sub("v$", "f", w)))


def stems(s):
    return [stem(w) for w in re.findall("[a-z0-9]+", s.lower())]


def numbers(s):
    dim = r"\d+(?:[.,]\d+)?\s*[x×]\s*\d+(?:[.,]\d+)?"
    each = lambda x: [n.replace(",", ".") for n in re.findall(r"\d+(?:[.,]\d+)?", x)]
    return {"x".join(sorted(each(d), key=float)) for d in re.findall(dim, s.lower())} | set(each(re.sub(dim, " ", s.lower())))


def best_coverage(query, values):
    q, found = stems(query), []
    for i, v, n in values:
        vs = list(dict.fromkeys(stems(v)))
        at = [k for k, s in enumerate(q) if s in vs]
        if not at or not numbers(v) <= numbers(query):
            continue
        m = len({q[k] for k in at})
        near = 1.0 if at[-1] - at[0] + 1 <= m else m / (at[-1] - at[0] + 1)
        score = int(50 * m / len(vs) + 30 * min(m / len(q), 1) + 20 * near + 1e-9)
        if score >= 50:
            found.append((m, score, n, -i))
    if found:
        m, score, _, i = max(found)
        return -i, m, score


def test_key_06_token_coverage(spark, t):
    values = [(r["value_id"], r["value"], r["count"]) for r in plans_keywords.values(t).collect()]
    got = {r["query"]: (r["value_id"], r["m"], r["score"]) for r in QUERIES["key_06_token_coverage"](spark, SF).collect()}
    queries = {f"cheap {v} online" for _, v, _ in values}
    assert got == {q: b for q in queries if (b := best_coverage(q, values))}


def test_numbers_of_a_value_must_be_in_the_query(spark):
    values = [(1, "200 liter", 50), (2, "300 liter", 9), (3, "3x5 meter", 7), (4, "liter", 1)]
    queries = ["regenton 300 liter", "ton 100 liter", "doek 5x3 meter", "doek 5 meter"]
    df = spark.createDataFrame(values, "value_id int, value string, count int")
    got = {r["query"]: (r["value_id"], r["m"], r["score"]) for r in K.token_coverage(spark.createDataFrame([(q,) for q in queries], "query string"), df).collect()}
    assert got == {q: b for q in queries if (b := best_coverage(q, values))}
    assert got["regenton 300 liter"][0] == 2 and got["ton 100 liter"][0] == 4 and got["doek 5x3 meter"][0] == 3


def test_key_09_heading_overlap(spark, t):
    def share(a, b):
        same = lambda x, y: x == y or (len(x) >= 4 and x in y) or (len(y) >= 4 and y in x)
        return sum(any(same(x, y) for y in stems(b)) for x in stems(a)) / len(stems(a)) if stems(a) else 0.0

    got = {r["p_partkey"]: (r["overlap"], r["score"]) for r in QUERIES["key_09_heading_overlap"](spark, SF).collect()}
    for r in t("part").collect():
        name, head = r["p_name"], f"{(r['p_name'].split(' ') + [''])[1]}s {r['p_type'].lower()}"
        a, b = share(name, head), share(head, name)
        f1 = round(200 * a * b / (a + b)) if a + b else 0
        base = r["p_size"] + 40
        assert got[r["p_partkey"]] == (f1, min(base + 10, 89) if f1 >= 100 and base < 89 else base)


def test_txt_01_mojibake(spark, t):
    for r in QUERIES["txt_01_mojibake"](spark, SF).collect():
        assert r["repaired"] and r["untouched"]


def structural(url):
    low, bare = url.lower(), re.sub("(?i)^https?://[^/]+", "", url)
    path, query = unquote(bare.split("#")[0].split("?")[0]), (url.split("#")[0].split("?") + [""])[1]
    parts = [x for x in path.split("/c/")[0].split("/") if x]
    chunks = [x for x in path.split("/c/")[1].strip("/").split("~~") if x] if "/c/" in path else []
    names = [c.split("~")[0] for c in chunks if c.split("~")[0]]
    tracked = re.compile("(utm_|gclid|fbclid|gad_source)")
    params = [p.split("=")[0] for p in query.split("&") if p.split("=")[0]]
    tests = [
        ("DOUBLE_PRODUCTS", "/products/products/" in low), ("DOUBLE_MAINCAT", len(parts) >= 3 and parts[1].lower() == parts[2].lower()), ("MISSING_PRODUCTS_PREFIX", not path.startswith("/products/") and "products" not in path[:20].lower()),
        ("TRACKING_PARAMS", any(map(tracked.match, params))), ("QUERY_PARAMS", not all(map(tracked.match, params))), ("FRAGMENT_PRESENT", bool((url.split("#") + [""])[1])), ("EMPTY_FACET_SLUG", any(c.startswith("~") for c in chunks)),
        ("EMPTY_FACET_VALUE", any((c.split("~") + [""])[1] == "" for c in chunks)), ("DUPLICATE_FACET", len(set(names)) < len(names)), ("INVALID_CHARS", " " in path or "+" in path), ("UPPERCASE_IN_PATH", path != path.lower()),
        ("HAS_BUCKET", "/r/" in path), ("PAGINATION", "page_" in low), ("UNWANTED_PARAM", any(w in low for w in ("sortby", "device", "shop_id"))),
    ]
    return [code for code, hit in tests if hit]


def facets(url):
    path = url.split("?")[0]
    if "/c/" not in path:
        return []
    pairs = [x.strip("/").split("~") for x in path.split("/c/")[-1].split("~~")]
    return [(p[0].lower(), p[1].split("/")[0]) for p in pairs if p[0] and len(p) > 1 and p[1].split("/")[0]]


def test_url_14_validate(spark, t):
    cats, settings, values = (df.collect() for df in plans_urls._taxonomy(t))
    mains, home = {r["main_cat"] for r in cats}, {r["deepest_cat"]: (r["main_cat"], r["enabled"]) for r in cats}
    linked = {(r["deepest_cat"], r["slug"]): (r["enabled"], r["noindex"]) for r in settings}
    listed = {(r["slug"], r["value_id"]): r["seo"] for r in values}

    def taxonomy(url):
        parts = [x for x in re.sub("(?i)^https?://[^/]+", "", url.split("?")[0]).split("/c/")[0].split("/") if x]
        main, sub = (parts[i].lower() if len(parts) > i else None for i in (1, 2))
        if main is None:
            return ["NO_MAINCAT"]
        if main not in mains:
            return ["MAINCAT_NOT_FOUND"]
        if sub is not None and sub not in home:
            return ["CATEGORY_NOT_FOUND"]
        out = []
        if sub is not None:
            out += ["HIERARCHY_MISMATCH"] * (home[sub][0] != main) + ["CATEGORY_DISABLED"] * (not home[sub][1])
        for slug, value in facets(url):
            if (sub or main, slug) not in linked:
                out.append("FACET_NOT_LINKED")
                continue
            on, hidden = linked[sub or main, slug]
            out += ["FACET_DISABLED"] * (not on) + ["FACET_NOINDEX"] * hidden
            if not re.fullmatch(r"-?\d+", value):
                out.append("INVALID_VALUE_ID")
            elif (slug, int(value)) not in listed:
                out.append("VALUE_NOT_FOUND")
            elif not listed[slug, int(value)]:
                out.append("VALUE_LOW_SEO_PRIORITY")
        return out

    got = QUERIES["url_14_validate"](spark, SF).collect()
    assert len(got) == plans_urls._bad(t).distinct().count()
    for r in got:
        assert r["issues"] == structural(r["url"]) + taxonomy(r["url"]), r["url"]
    seen = {c for r in got for c in r["issues"]}
    assert {"MAINCAT_NOT_FOUND", "CATEGORY_NOT_FOUND", "CATEGORY_DISABLED", "FACET_NOT_LINKED", "FACET_DISABLED", "INVALID_VALUE_ID", "DOUBLE_PRODUCTS", "FRAGMENT_PRESENT"} <= seen


BLOCKING = set(
    "MAINCAT_NOT_FOUND NO_MAINCAT CATEGORY_NOT_FOUND CATEGORY_DISABLED FACET_NOT_LINKED INVALID_VALUE_ID VALUE_NOT_FOUND INVALID_CHARS EMPTY_FACET_SLUG EMPTY_FACET_VALUE MISSING_PRODUCTS_PREFIX DOUBLE_MAINCAT".split()
)
MENDED = set("HIERARCHY_MISMATCH DOUBLE_PRODUCTS UPPERCASE_IN_PATH FRAGMENT_PRESENT TRACKING_PARAMS UNWANTED_PARAM QUERY_PARAMS DUPLICATE_FACET HAS_BUCKET".split())


def rebuilt(r):
    codes, url = set(r["issues"]), r["url"]
    if codes & BLOCKING or not codes & MENDED:
        return None
    main = r["true_main"] if "HIERARCHY_MISMATCH" in codes and r["true_main"] else r["main"]
    host = (re.match("(?i)https?://[^/]+", url) or [""])[0].lower()
    term = (re.search("(?i)/r/([^/?#]+)", url) or ["", ""])[1]
    once = dict(reversed(facets(url.split("#")[0])))
    path = "/products" + "".join(f"/{x}" for x in (main, r["sub"]) if x) + (f"/r/{term}" if term else "")
    names = list(dict.fromkeys(s for s, _ in facets(url.split("#")[0])))
    path += "/c/" + "~~".join(f"{s}~{once[s]}" for s in names) if names else "/"
    return None if host + path.lower() == url.strip() else host + path.lower()


def test_url_15_suggest(spark, t):
    checked = QUERIES["url_14_validate"](spark, SF).collect()
    got = {r["url"]: r["suggestion"] for r in QUERIES["url_15_suggest"](spark, SF).collect()}
    assert got == {r["url"]: rebuilt(r) for r in checked}
    assert any(got.values())
