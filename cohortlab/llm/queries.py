"""The thin queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, lang_id, media_png, mixing, ngram_join, quality_rules, simple8b, site_quality, tree_bpe, warc
from ._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_texts(table(spark, sf_dir, "documents"))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op8_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_png.media_features(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 9) for c in ("slot", "weight", "exponent")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simple8b, op3_backoff_lm, op4_site_quality, op5_ngram_join, op6_tree_bpe, op7_lang_id, op8_media_png, op9_mixing, op10_warc)}

_STEPS = "\n  union all ".join(f"select {i} as step, " + ", ".join(f"{cuts[i]!r}::double as c_{rule}" for rule, cuts in quality_rules.CUTOFFS.items()) for i in range(8))
_LOST = " or ".join(f"{rule} > c_{rule}" for rule in quality_rules.CUTOFFS)
_P = quality_rules.ALPHA

_QUALITY = f"""
with d as (select doc_id, coalesce(lang, 'und') as stratum, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
cover as (select distinct doc_id, i + o as i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) cross join (select unnest([0, 1, 2]) as o) where c > 1),
rep as (select doc_id, count(*) as n_repeat_words from cover group by doc_id),
b as (select w.doc_id, stratum, len(w)::bigint as n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l) as n_lines,
        length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_capitals, length(t) - length(translate(t, '!', '')) as n_shouts
      from w left join rep using (doc_id)),
s as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, n_symbols / greatest(word_chars, 1)::double as symbols,
        n_dup_lines / greatest(n_lines, 1)::double as dup_lines, n_repeat_words / greatest(n_words, 1)::double as repeats,
        n_capitals / greatest(word_chars, 1)::double as capitals, n_shouts / greatest(n_words, 1)::double as shouts from b),
r as ({_STEPS}),
good as (select doc_id from labels group by doc_id having min(coalesce(quality, 0)) = 1),
worst as (select doc_id, min(stratum) as stratum, {", ".join(f"max({rule}) as {rule}" for rule in quality_rules.CUTOFFS)} from s join good using (doc_id) where not base_failed group by doc_id),
c as (select stratum, step, count(*) as n, count(*) filter ({_LOST}) as k from worst cross join r group by all),
p as (select *, case when k > n * {_P!r} then 1.0 else (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P!r}) + (n - i) * ln(1 - {_P!r}))) from (select unnest(range(0, k + 1)) as i)) end as p from c),
v as (select *, p <= {quality_rules.DELTA!r} / (select greatest(count(distinct stratum), 1) from c) as passed from p),
stop as (select stratum, coalesce(min(step) filter (not passed), 1000) as stop from v group by all),
cut as (select stratum, max(step) as step from v join stop using (stratum) where step < stop group by all)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected_by is null as kept, rejected_by, stratum
from (select s.*, case when base_failed then null {" ".join(f"when {rule} > c_{rule} then '{rule}'" for rule in quality_rules.CUTOFFS)} end as rejected_by
      from s left join cut using (stratum) left join r using (step)) s
"""


def _mixing_sql() -> str:
    m = mixing
    digest = "('0x' || substr(md5({}), 1, 12))::bigint"
    many = 1 << m.HALVINGS

    def bisected(name: str, t_of: str, fits: str) -> str:
        """Tables that end in one row of ``name``: u, null if the first pass has found none."""
        out, low, step = [], "0.0::double", 1.0
        for i in range(m.PASSES):
            step /= many
            out.append(f"""{name}_t{i} as (select u, sum(pow(p, a)) as z, sum(pow(p, a) * a * ln(p)) as s, max(pow(p, a) / p) as r, max(n) as n
    from (select *, t / (1 - t) as a from (select p, n, u, {t_of} as t from share cross join (select {low} + j * {step!r}::double as u from (select unnest(range(0, {many + 1})) as j))) where t < 1) group by u),
  {name}_{i} as (select min(u) filter ({fits}) as u from {name}_t{i})""")
            low = f"greatest((select u from {name}_{i}) - {step!r}::double, 0.0)"
        return ",\n  ".join(out)

    last = m.PASSES - 1
    chains = bisected("e", "u", f"ln(z) - s / z <= {m.TARGET_EVENNESS!r} * ln(greatest(n, 2)) + 1e-12") + f""",
  th as (select u as t from e_{last}),
  """ + bisected("f", "(select t from th) + u * (0.5::double - (select t from th))", f"r / z <= {m.MAX_REPEAT!r}") + f""",
  tt as (select coalesce(t + u * (0.5::double - t), 0.5) as t from th, f_{last})"""
    return f"""
with d as (select doc_id, coalesce(source, '') as source, greatest(len(string_split(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), ' ')), 1)::bigint as n_tokens,
    ({digest.format(f"'{m.SEED}/' || coalesce(doc_id::varchar, '')")} % {m.BLOCKS})::int as block from documents),
  bl as (select source, block, sum(n_tokens)::double as tokens from d group by all),
  so as (select source, sum(tokens) as size from bl group by all),
  share as (select size / (select sum(size) from so) as p, (select count(*) from so) as n from so),
  {chains},
  x as (select t / (1 - t) as a from tt),
  q as (select source, size, pow(size, a) / (select sum(pow(size, x.a)) from so, x) as weight, pow(size, a) / (select sum(pow(size, x.a)) from so, x) * (select sum(size) from so) as quota, a as exponent from so, x),
  e as (select *, unnest(range(0, ceil(quota / size)::int + 1))::int as epoch from q),
  o as (select source, block, epoch, tokens, size, quota, weight, exponent, {digest.format(f"'{m.SEED}/' || source || '/' || epoch || '/' || block")} as o from bl join e using (source)),
  m as (select *, epoch * size + coalesce(sum(tokens) over (partition by source, epoch order by o, block rows between unbounded preceding and 1 preceding), 0) + tokens / 2 as m from o)
select doc_id, source, n_tokens, epoch, block, round(m / quota, 9) as slot, round(weight, 9) as weight, round(exponent, 9) as exponent from d join m using (source, block) where m <= quota
"""


ORACLE = {
    "op1_quality_rules": _QUALITY,
    "op9_mixing": _mixing_sql(),
    "op10_warc": """
with p as (select page_id, url, coalesce(encode(html), ''::blob) b from pages),
d as (select page_id, url, octet_length(b) n, sha256(b) h from p),
f as (select h, min(page_id) first_id from d where n >= 100 group by h)
select d.page_id, d.n as payload_bytes, d.h as payload_digest,
  case when d.page_id <> f.first_id then 'revisit' else 'response' end as record_type,
  case when d.page_id <> f.first_id then f.first_id end as refers_to,
  case when coalesce(url, '') = '' then '' else
    array_to_string(list_reverse(string_split(lower(regexp_replace(regexp_replace(regexp_extract(r, '^[^/?]*'), '^.*@', ''), ':[0-9]+$', '')), '.')), ',')
    || ')' || regexp_replace(r, '^[^/?]*', '') end as url_key
from (select *, regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') r from d) d
left join f on d.h = f.h and d.n >= 100
""",
}
