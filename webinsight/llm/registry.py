"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, exact_dedup, filter_audit, html_extraction, license_scan, merkle_manifest, mixing, piece_sampling, quality_classifier, quality_rules, simhash, substring_dedup, toxicity
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(documents(spark, sf_dir), digest=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), min_words=substring_dedup.PASSAGE_WORDS).select("doc_id", "n_sentences", "n_removed", "text")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_piece_sampling, op3_mixing, op4_lm_scoring, op5_quality_classifier, op6_html_extraction, op7_simhash, op8_substring_dedup, op9_exact_dedup, op10_toxicity, op11_license_scan, op12_merkle_manifest, op13_filter_audit)}


_W = "[^\\x20\\x09-\\x0D]+"

OP1_SQL = f"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
w as (select doc_id, host, t, regexp_extract_all(t, '{_W}') as w from d),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from win) where n > 1),
cov as (select doc_id, count(distinct i + k) as n_repeat_words from rep, (select unnest(range(0, 5)) as k) group by 1),
ln as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) as l from d),
c as (select doc_id, host, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, len(l) as n_lines from w join ln using (doc_id) left join cov using (doc_id)),
f as (select *, n_words < 10 as few, 100 * n_repeat_words > 20 * n_words as rep, 10 * n_symbols > word_chars as sym, 10 * n_dup_lines > 3 * n_lines as dup, word_chars < 2 * n_words or word_chars > 15 * n_words as len from c),
h as (select host, count(*) as n, unnest([count(*) filter (few), count(*) filter (rep), count(*) filter (sym), count(*) filter (dup), count(*) filter (len)]) as x, unnest([1, 2, 3, 4, 5]) as rule from f group by host),
s as (select rule, sum(n)::double as total, count(*) as k, sum(n * n)::double as nn, sum(x)::double / sum(n) as m, sum(x::double / n * x) as q from h group by rule),
v as (select rule, m, case when total - nn / total > 0 then (q - total * m * m - (k - 1) * m * (1 - m)) / (total - nn / total) else 0 end as var from s),
p as (select rule, m, case when var <= 0 then 1000 else least(1000, greatest(1, m * (1 - m) / var - 1)) end as a from v),
r as (select host, max(n) as host_docs, max((x + a * m) / (n + a)) > 0.5 as host_failed from h join p using (rule) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few or rep as base_failed, host_docs, host_failed, not (few or rep) and not host_failed as kept from f join r using (host)
"""

OP3_SQL = f"""
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_W}')) as bigint) as size, cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as u from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
sw as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
level as (select 0 as k, 1.5::double * sum(source_size) / sum(weight) as l from sw
  union all select k + 1, more from (select k, l, (1.5::double * sum(source_size) - sum(case when 2 * source_size <= l * weight then 2 * source_size else 0 end)) / nullif(sum(case when 2 * source_size <= l * weight then 0 else weight end), 0) as more
    from level, sw group by k, l) where more > l),
top as (select max(l) as l from level),
t as (select source, source_size, least(l * weight, 2.0::double * source_size) as target, case when source_size > 0 then floor(least(l * weight, 2.0::double * source_size) / source_size) else 0 end as whole from sw, top),
o as (select d.*, t.source_size, t.target, t.whole, sum(size) over (partition by d.source order by u, doc_id) as run from d join t on t.source is not distinct from d.source)
select doc_id, size, source_size, target, cast(size * (whole + case when 2 * run - size <= 2 * (target - whole * source_size) then 1 else 0 end) as bigint) as taken from o
"""

OP9_SQL = """
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n
"""

_TEMPLATES = ", ".join(f"('{name}', '{label}', [{', '.join(repr(x) for x in license_scan.word_set(text))}])" for name, label, text in license_scan.TEMPLATES)
_PHRASE = lambda p: " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))

OP11_SQL = f"""
with d as (select row_number() over () as uid, doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), chr(65533))), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
t(name, label, words) as (values {_TEMPLATES}),
hit as (select uid, i - 1 as start, unnest(list_filter([{', '.join(f"case when {_PHRASE(p)} then '{label}' end" for p, label in license_scan.PHRASES)}], lambda x: x is not null)) as label
  from (select uid, w, unnest(range(1, len(w) + 1)) as i from d where list_contains(w, 'license'))),
p as (select uid, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as base from hit group by 1),
b as (select uid, s as start, unnest(list_distinct(w[s + 1:s + 64])) as word from (select uid, w, unnest(range(0, greatest(len(w) - 32, 1), 32)) as s from d)),
tw as (select name, label, words, unnest(words) as word from t),
f as (select uid, start, name, label, words, count(*) as overlap from b join tw using (word) group by all having count(*) >= ceil(round(len(words) * 0.9::double, 6))),
k as (select uid, start, label, overlap / len(words) as share from f where not exists (select 1 from f g where g.uid = f.uid and g.start = f.start and len(g.words) > len(f.words) and list_has_all(g.words, f.words))),
m as (select uid, list(distinct label) as more, max(share) as best, count(distinct start) as n_blocks from k group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') as labels, greatest(coalesce(best, 0), case when n_base > 0 then 0.5 else 0 end)::double as score, coalesce(n_blocks, 0) as n_blocks
from d left join p using (uid) left join m using (uid)
"""

_FIELD = lambda x: f"case when {x} is null then '-' else strlen(cast({x} as varchar)) || ':' || {x} end"
_LEAF = lambda text: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', 'n_chars')))} || {_FIELD(text)})"

OP12_SQL = f"""
with recursive crc_bits as (select i, 0 as k, i as x from (select unnest(range(256)) as i) union all select i, k + 1, case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end from crc_bits where k < 8),
crc as (select list(x order by i) as c from crc_bits where k = 8),
d as (select doc_id, source, {_LEAF('text')} as leaf, case when xor(list_reduce(list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda j: cast(ascii(cast(doc_id as varchar)[j]) as bigint)), lambda a, b: xor(a // 256, c[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 5 = 0
  then {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed from documents, crc),
leafs as (select row_number() over (order by doc_id nulls first, leaf) as uid, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, * from d),
up as (select source, 0 as lvl, pos, leaf as digest, count(*) over (partition by source) as n from leafs
  union all select source, lvl + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), any_value((n + 15) // 16) from up where n > 1 group by source, lvl, pos // 16),
sub as (select source, digest as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from up where n = 1),
top as (select 0 as lvl, pos, subroot as digest, n from sub union all select lvl + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), any_value((n + 15) // 16) from top where n > 1 group by lvl, pos // 16),
levels as (select source, lvl, pos, digest, 0 as part from up where n > 1 union all select null, lvl, pos, digest, 1 from top where n > 1),
path as (select uid, l.part, l.lvl, string_agg(digest, '' order by l.pos) filter (l.pos < own) as before, string_agg(digest, '' order by l.pos) filter (l.pos > own) as after from (
    select uid, leafs.source, p.part, p.lvl, case when p.part = 0 then leafs.pos // cast(power(16, p.lvl) as bigint) else sub.pos // cast(power(16, p.lvl) as bigint) end as own from leafs join sub on sub.source is not distinct from leafs.source
      join (select distinct part, source, lvl from levels) p on p.part = 1 or p.source is not distinct from leafs.source) r
  join levels l on l.part = r.part and l.lvl = r.lvl and l.pos // 16 = r.own // 16 and (l.part = 1 or l.source is not distinct from r.source) group by uid, l.part, l.lvl),
lists as (select uid, list(coalesce(before, '') order by part, lvl) as b, list(coalesce(after, '') order by part, lvl) as a from path group by uid),
fold as (select uid, 0 as k, coalesce(changed, leaf) as now, coalesce(b, []) as b, coalesce(a, []) as a from leafs left join lists using (uid) union all select uid, k + 1, sha256(b[k + 1] || now || a[k + 1]), b, a from fold where k < len(b)),
folded as (select uid, now as folded_root, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || a[i]), '') as siblings from fold where k = len(b))
select doc_id, leaf, subroot, digest as root, sha256(siblings) as proof_sha256, folded_root, folded_root = digest as verified, leafs.pos as place, changed is not null as tampered
from leafs join folded using (uid) join sub on sub.source is not distinct from leafs.source cross join (select digest from top where n = 1)
"""

OP13_SQL = f"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_W}') as w from documents),
l as (select doc_id, coalesce(max(quality), 0) = 1 as good, coalesce(max(toxic), 0) = 1 as toxic from labels group by 1),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {{A: len(w) < 200, B: 100 * len(list_distinct(w)) < 50 * len(w), C: 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
  D: regexp_matches(t, '[#$%&*|]'), E: coalesce(doc_id > min(doc_id) over (partition by t), false)}} as x from d left join l using (doc_id)),
m as (select part, good, toxic, concat(case when x.A then 'A' else '' end, case when x.B then 'B' else '' end, case when x.C then 'C' else '' end, case when x.D then 'D' else '' end, case when x.E then 'E' else '' end) as fails, count(*) as n from f group by all),
one as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order from one a, one b, one c, one d, one e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select filter_order, step, filter_order[step] as c, filter_order[1:step - 1] as earlier from o, (select unnest(range(1, 6)) as step)),
r as (select part, filter_order, cast(step as integer) as step, c,
  cast(coalesce(sum(n) filter (translate(fails, earlier || c, '') = fails), 0) as bigint) as kept, cast(coalesce(sum(n) filter (translate(fails, earlier, '') = fails and contains(fails, c)), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (translate(fails, earlier, '') <> fails and contains(fails, c)), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (fails = c), 0) as bigint) as unique_fails,
  cast(coalesce(sum(n) filter (translate(fails, earlier, '') = fails and contains(fails, c) and good), 0) as bigint) as good_lost, cast(coalesce(sum(n) filter (translate(fails, earlier, '') = fails and contains(fails, c) and toxic), 0) as bigint) as toxic_lost
  from m, s group by all)
select * exclude (c), cast(sum(removed) over (partition by part, c) as bigint) as shapley from r
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_license_scan": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_filter_audit": OP13_SQL, "op1_quality_rules": OP1_SQL, "op3_mixing": OP3_SQL, "op9_exact_dedup": OP9_SQL}
