"""Every operator as a query over the star-schema tables, and the same in SQL for another engine where SQL can say it.

Numbers are rounded to six decimals on both sides. Assignment queries that hash with functions that only Spark has, and
iterative or Python-backed ones, have no SQL; the tests hold them against invariants.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions import scalar as S
from cohortlab.operators import assign, binning, cube, outcomes, ranking, shapley, strata, subset, validate
from cohortlab.sources import fixtures, synth
from cohortlab.sources.fixtures import CHANNELS, FEATURES, PRODUCTS, duck

from . import approaches, plots, report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LEAST = 60
CHANGED, UNCHANGED = PRODUCTS[:8], PRODUCTS[8:]


def query(name: str, run: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None) -> None:
    """Register a query; ``run`` gets a function from the name of a fixture to its DataFrame."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(lambda fixture: fixtures.frame(spark, sf_dir, fixture))
        return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind in ("double", "float")})

    call.__name__ = name
    QUERIES[name] = call
    if sql is not None:
        ORACLE[name] = sql


def _legacy(f) -> DataFrame:
    return subset.test_group(f("priority_legacy"))


def _new(f) -> DataFrame:
    return subset.test_group(f("priority_new"))


_L = f"(select * from {duck('priority_legacy')} where control = 0)"
_N = f"(select * from {duck('priority_new')} where control = 0)"
_C = duck("strat_customers")


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) as {name}"


def _ranks(source: str, products: list[str] = PRODUCTS) -> str:
    items = ", ".join(f"{{'p': '{p}', 's': coalesce({p}::double, 0)}}" for p in products)
    return f"select customer_id, x.p as product, x.s as s, row_number() over (partition by customer_id order by x.s desc, x.p)::int as r from (select customer_id, unnest([{items}]) as x from {source})"


_RANKED = f"rl as ({_ranks(_L)}), rn as ({_ranks(_N)}), ids as (select distinct customer_id from rl semi join rn using (customer_id))"


def _top(k: int) -> str:
    """Per customer: common items, whether the order differs, squares of rank gaps over the union, its size."""
    return f"""{_RANKED},
a as (select customer_id, product, r from rl where r <= {k}), b as (select customer_id, product, r from rn where r <= {k}),
j as (select customer_id, a.r as ra, b.r as rb from a full join b using (customer_id, product) where customer_id in (select customer_id from ids)),
t as (select customer_id, count(*) filter (ra is not null and rb is not null) as same, count(*) as m, max(case when ra is distinct from rb then 1 else 0 end) as diff,
  sum(pow(coalesce(ra, {k + 1}) - coalesce(rb, {k + 1}), 2)) as d2 from j group by customer_id)"""


_SPEARMAN = "case when m = 1 then 1.0 else 1 - 6 * d2 / (m * (m * m - 1))::double end"

# ---- ranking ----
query("rank_sorted_products", lambda f: ranking.sorted_products(_legacy(f)).select("customer_id", F.array_join("ranked_products", ",").alias("ranked")), f"select customer_id, string_agg(product, ',' order by r) as ranked from ({_ranks(_L)}) group by customer_id")
query("rank_top3_products", lambda f: ranking.topk_products(_legacy(f), 3).select("customer_id", F.array_join("top3_products", ",").alias("top3")), f"select customer_id, string_agg(product, ',' order by r) as top3 from ({_ranks(_L)}) where r <= 3 group by customer_id")
for _k in (1, 3, 5):
    query(f"rank_top{_k}_overlap", lambda f, k=_k: ranking.topk_overlap(_legacy(f), _new(f), k), f"with {_top(_k)} select customer_id, {_r(f'same / {_k}.0::double', f'top{_k}_overlap')} from t")
    query(f"rank_top{_k}_swap", lambda f, k=_k: ranking.topk_swap(_legacy(f), _new(f), k), f"with {_top(_k)} select customer_id, diff::int as top{_k}_changed from t")
    query(f"rank_top{_k}_spearman", lambda f, k=_k: ranking.topn_rank_correlation(_legacy(f), _new(f), k), f"with {_top(_k)} select customer_id, {_r(_SPEARMAN, f'top{_k}_rank_corr')} from t")
query("full_spearman", lambda f: ranking.full_rank_correlation(_legacy(f), _new(f)), f"with {_RANKED} select customer_id, {_r('1 - 6 * sum(pow(rl.r - rn.r, 2)) / (25 * (25 * 25 - 1))::double', 'full_rank_corr')} from rl join rn using (customer_id, product) group by customer_id")
query("top1_agreement", lambda f: ranking.top1_agreement(_legacy(f), _new(f)), f"with {_RANKED} select customer_id, rl.product as top1_legacy, rn.product as top1_new, case when rl.product = rn.product then 1 else 0 end::int as top1_same from rl join rn using (customer_id) where rl.r = 1 and rn.r = 1")
_SUM = " + ".join(f"coalesce({p}::double, 0)" for p in PRODUCTS)
query("ev_total", lambda f: ranking.total_value(_legacy(f)), f"select customer_id, {_r(_SUM, 'total_ev')} from {_L}")
query("ev_top3", lambda f: ranking.topk_value(_legacy(f), 3), f"select customer_id, {_r('sum(s)', 'top3_ev')} from ({_ranks(_L)}) where r <= 3 group by customer_id")
_EV = f"l as (select customer_id, {_SUM} as a from {_L}), n as (select customer_id, {_SUM} as b from {_N})"
query("ev_diff", lambda f: ranking.metric_difference(ranking.total_value(_legacy(f)), ranking.total_value(_new(f)), "total_ev"), f"with {_EV} select customer_id, {_r('a', 'total_ev_legacy')}, {_r('b', 'total_ev_new')}, {_r('b - a', 'total_ev_diff')} from l join n using (customer_id)")


def _summary_sql(x: str, source: str, extra: str = "") -> str:
    q = ", ".join(_r(f"quantile_cont({x}, {p})", f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75))
    return f"select count({x}) as n, {_r(f'avg({x})', 'mean')}, {_r(f'stddev_samp({x})', 'stddev')}, {_r(f'min({x})', 'min')}, {q}, {_r(f'max({x})', 'max')}{extra} from {source}"


query("metric_summary_typed", lambda f: ranking.summary(ranking.total_value(_legacy(f)), "total_ev"), f"with {_EV} {_summary_sql('a', 'l')}")
_COMPARED = ", 'legacy' as side", ", 'new' as side"
query("ev_compare_summary", lambda f: ranking.compare_summaries(ranking.total_value(_legacy(f)), ranking.total_value(_new(f)), "total_ev"), f"with {_EV}, j as (select * from l join n using (customer_id)) {_summary_sql('a', 'j', _COMPARED[0])} union all {_summary_sql('b', 'j', _COMPARED[1])}")
_DIFFS = [f"abs(coalesce(n.{p}::double, 0) - coalesce(l.{p}::double, 0))" for p in PRODUCTS]
query("value_diff", lambda f: ranking.value_differences(_legacy(f), _new(f), PRODUCTS), f"select l.customer_id, {', '.join(_r(d, f'{p}_abs_diff') for p, d in zip(PRODUCTS, _DIFFS, strict=True))}, {_r(' + '.join(_DIFFS), 'sum_abs_diff')} from {_L} l join {_N} n using (customer_id)")
query("value_diff_summary", lambda f: ranking.summary(ranking.value_differences(_legacy(f), _new(f), PRODUCTS), "sum_abs_diff"), f"with j as (select {' + '.join(_DIFFS)} as x from {_L} l join {_N} n using (customer_id)) {_summary_sql('x', 'j')}")
query("product_shift_top3", lambda f: ranking.product_shift(_legacy(f), _new(f), 3), f"""with {_RANKED}, a as (select product, count(*) as f from rl where r <= 3 group by product), b as (select product, count(*) as f from rn where r <= 3 group by product)
select product, coalesce(a.f, 0) as freq_legacy, coalesce(b.f, 0) as freq_new, {_r(f'coalesce(a.f, 0) / (select count(*) from {_L})::double', 'pct_legacy')}, {_r(f'coalesce(b.f, 0) / (select count(*) from {_N})::double', 'pct_new')} from a full join b using (product)""")


def _metrics(f, ks=(1, 3, 5)) -> DataFrame:
    return ranking.topk_metrics(ranking.paired(_legacy(f), _new(f)), ks)


query("overlap_vs_corr_top3", lambda f: ranking.overlap_by_correlation(_metrics(f, (3,)), 3), f"with {_top(3)}, c as (select same::int as overlap_count, {_SPEARMAN} as s from t) select overlap_count, count(*) as n_customers, {_r('overlap_count / 3.0::double', 'avg_overlap')}, {_r('avg(s)', 'avg_rank_corr')}, {_r('quantile_cont(s, 0.5)', 'median_rank_corr')}, round(100 * count(*) / (select count(*) from t)::double, 4) as pct_customers from c group by overlap_count")
query("swap_summary_top3", lambda f: ranking.swap_summary(_metrics(f, (3,)), 3), f"with {_top(3)} select count(*) as n_customers, sum(diff)::bigint as n_changed, {_r('avg(diff)', 'swap_rate')} from t")
query("overlap_count_top5", lambda f: ranking.overlap_count(ranking.topk_overlap(_legacy(f), _new(f), 5), "top5_overlap", 5).groupBy("overlap_count").agg(F.count(F.lit(1)).alias("n")), f"with {_top(5)} select same::int as overlap_count, count(*) as n from t group by 1")


def _fused_sql() -> str:
    parts = []
    for k in (1, 3, 5):
        parts.append(f"""select * from (with {_top(k)}, e as (select customer_id, sum(n) - sum(l) as gap from (
  select customer_id, s as l, 0 as n from rl where r <= {k} union all select customer_id, 0, s from rn where r <= {k}) group by customer_id)
select {k}::int as k, count(*) as n_customers, {_r(f'avg(same / {k}.0::double)', 'avg_overlap')}, {_r('avg(diff)', 'swap_rate')}, {_r(f'avg({_SPEARMAN})', 'avg_rank_corr')}, {_r('avg(gap)', 'avg_ev_diff')}, round(100 * avg(diff), 4) as pct_changed from t join e using (customer_id))""")
    return " union all ".join(parts)


query("fused_report", lambda f: report.fused_summary(f("priority_legacy"), f("priority_new")), _fused_sql())


def _changed_sql() -> str:
    rows = []
    for name, products in (("changed", CHANGED), ("unchanged", UNCHANGED)):
        total = lambda t, products=products: " + ".join(f"coalesce({t}.{p}::double, 0)" for p in products)
        rows.append(_summary_sql("x", f"(select ({total('n')}) - ({total('l')}) as x from {_L} l join {_N} n using (customer_id))", f", '{name}' as products"))
    return " union all ".join(rows)


query("changed_unchanged_ev", lambda f: ranking.changed_unchanged_value(_legacy(f), _new(f), CHANGED, UNCHANGED), _changed_sql())
query("subset_customers_products", lambda f: subset.subset(f("priority_new"), f("strat_customers").where("segment = 'BUILDING'").select(F.col("cost_ID").alias("customer_id")), PRODUCTS), f"select customer_id, control, {', '.join(_r(p, p) for p in PRODUCTS)} from {duck('priority_new')} where control = 0 and customer_id in (select cost_ID from {_C} where segment = 'BUILDING')")
query("ev_diff_histogram", lambda f: plots.histogram(ranking.metric_difference(ranking.total_value(_legacy(f)), ranking.total_value(_new(f)), "total_ev"), "total_ev_diff", 20), f"""with {_EV}, d as (select b - a as v from l join n using (customer_id)), e as (select min(v) as lo, max(v) as hi, (max(v) - min(v)) / 20 as w from d)
select least(19, floor((v - lo) / w))::int as bin, {_r('lo + least(19, floor((v - lo) / w))::int * w', 'low')}, {_r('lo + (least(19, floor((v - lo) / w))::int + 1) * w', 'high')}, count(*) as n from d, e group by 1, 2, 3""")


def _report_tables(f) -> DataFrame:
    made = report.build(f("priority_legacy"), f("priority_new"), report.Scenario("active", tuple(PRODUCTS)), persist=False)
    return made["top3_product_shift"].table


query("report_top3_shift", _report_tables, f"""with {_RANKED}, a as (select product, count(*) as f from rl where r <= 3 group by product), b as (select product, count(*) as f from rn where r <= 3 group by product),
s as (select product, coalesce(a.f, 0) as freq_legacy, coalesce(b.f, 0) as freq_new, coalesce(a.f, 0) / (select count(*) from {_L})::double as x, coalesce(b.f, 0) / (select count(*) from {_N})::double as y from a full join b using (product))
select product, freq_legacy, freq_new, {_r('x', 'pct_legacy')}, {_r('y', 'pct_new')}, {_r('y - x', 'pct_diff')}, {_r('abs(y - x)', 'pct_diff_abs')}, freq_new - freq_legacy as freq_diff from s""")

# ---- binning and strata ----
_VISA = "case when visa_ind is null then '__NULL__' when visa_ind = 1 then '1' else '0' end"
query("visa_bin", lambda f: f("strat_customers").select("cost_ID", binning.flag_label().alias("visa_bin"), binning.flag_label(mode="merge").alias("visa_merged")), f"select cost_ID, {_VISA} as visa_bin, case when visa_ind = 1 then '1' else '0_or_null' end as visa_merged from {_C}")


def _q(x: str, n: int, kind: str = "quantile_disc") -> str:
    return f"(select list_sort(list_distinct({kind}({x}, [{', '.join(str(i / n) for i in range(1, n))}]))) as q from c)"


query("quantile_bin", lambda f: f("strat_customers").select("cost_ID", binning.bin_number("balance", binning.quantile_cuts(f("strat_customers"), {"balance": [8]}, 0.0)["balance", 8]).alias("bin")), f"with c as {_C}, q as {_q('balance', 8)} select cost_ID, (case when balance is null then -1 else len(list_filter(q, lambda e: e < balance)) end)::int as bin from c, q")
query("winsorize", lambda f: binning.winsorise(f("strat_customers"), ["balance"], rel_err=0.0).select("cost_ID", "balance"), f"with c as {_C}, q as (select quantile_disc(balance, [0.01, 0.99]) as q from c) select cost_ID, {_r('greatest(least(balance, q[2]), q[1])', 'balance')} from c, q")
query("clip_exact", lambda f: binning.clip_exact(f("strat_customers"), "balance")[0].select("cost_ID", "balance"), f"with c as {_C}, q as (select quantile_cont(balance, [0.01, 0.99]) as q from c) select cost_ID, {_r('greatest(least(balance, q[2]), q[1])', 'balance')} from c, q")


def _profile_sql(c: str) -> str:
    return _summary_sql(c, "c").replace("select ", f"select '{c}' as \"column\", {_r(f'count(*) filter ({c} is null) / count(*)::double', 'null_share')}, ", 1)


query("null_profile", lambda f: binning.profile(f("strat_customers"), FEATURES), f"with c as {_C} " + " union all ".join(_profile_sql(c) for c in FEATURES))
query("preprocess", lambda f: binning.preprocess(f("strat_customers"), ["visa_ind"], ["n_offers_year"], ["balance"], 0.0).select("cost_ID", "visa_ind_cat", "n_offers_year_cat", "balance"), f"with c as {_C}, q as (select quantile_disc(balance, [0.01, 0.99]) as q from c) select cost_ID, coalesce(visa_ind::varchar, 'UNKNOWN') as visa_ind_cat, coalesce(n_offers_year::varchar, 'UNKNOWN') as n_offers_year_cat, {_r('greatest(least(balance, q[2]), q[1])', 'balance')} from c, q")


def _qcut(x: str, n: int, prefix: str) -> str:
    return f"case when {x} is null then '{prefix}:NULL' else '{prefix}:Q' || (1 + (select len(list_filter(q[2:len(q) - 1], lambda e: e < {x})) from q_{prefix})) end"


def _qcut_cte(x: str, n: int, prefix: str, source: str = "c") -> str:
    return f"q_{prefix} as (select list_sort(list_distinct(quantile_cont({x}, [{', '.join(str(i / n) for i in range(n + 1))}]))) as q from {source})"


query("qcut_bin", lambda f: binning.rank_bin(f("strat_customers"), "n_offers_year", 4, "bin", "off").select("cost_ID", "bin"), f"with c as {_C}, {_qcut_cte('n_offers_year', 4, 'off')} select cost_ID, {_qcut('n_offers_year', 4, 'off')} as bin from c")
query("bucketizer_bin", lambda f: binning.bucketize(f("strat_customers"), "balance", 5, rel_err=0.0).select("cost_ID", "balance_bin"), f"with c as {_C}, q as {_q('balance', 5)} select cost_ID, case when balance is not null then len(list_filter(q, lambda e: e <= balance))::double end as balance_bin from c, q")
query("density_balance", lambda f: plots.density(f("strat_customers").withColumn("group", assign.md5_control("cost_ID")), "balance", "group", 10), f"""with c as (select *, case when ('0x' || substr(md5(cost_ID || '__42'), 1, 8))::bigint % 10000 < 1000 then 1 else 0 end::int as arm from {_C}), e as (select min(balance) as lo, max(balance) as hi from c),
n as (select arm, least(9, floor(10 * ((balance - lo) / (hi - lo))))::int as bin, count(*) as n from c, e where balance is not null group by 1, 2) select arm, bin, {_r('n / sum(n) over (partition by arm)::double', 'share')} from n""")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("visa_bin", binning.flag_label()).withColumn("stratum", strata.key(["visa_bin", "segment"]))


_KEYED = f"(select *, {_VISA} as visa_bin, concat_ws(' | ', 'visa_bin=' || ({_VISA}), 'segment=' || segment) as stratum from {_C})"
query("stratum_key", lambda f: _keyed(f("strat_customers")).select("cost_ID", "stratum"), f"select cost_ID, stratum from {_KEYED}")
query("stratum_number", lambda f: strata.numbered(_keyed(f("strat_customers")), "stratum", "id", "A_").select("cost_ID", "id"), f"select cost_ID, 'A_' || lpad(dense_rank() over (order by stratum)::varchar, 3, '0') as id from {_KEYED}")
query("stratum_simple", lambda f: strata.simple(f("strat_customers"))[0].select("cost_ID", "stratum"), f"""with c0 as {_C}, qb as (select quantile_cont(balance, [0.01, 0.99]) as q from c0), c as (select * replace (greatest(least(balance, q[2]), q[1]) as balance) from c0, qb),
{_qcut_cte('balance', 5, 'bal')}, {_qcut_cte('n_web_logins', 4, 'web')}, {_qcut_cte('n_mobile_logins', 4, 'mob')}, {_qcut_cte('n_offers_year', 4, 'off')}
select cost_ID, case when visa_ind is null then 'visa:NULL' else 'visa:' || visa_ind end || '|' || {_qcut('balance', 5, 'bal')} || '|' || {_qcut('n_web_logins', 4, 'web')} || '|' || {_qcut('n_mobile_logins', 4, 'mob')} || '|' || {_qcut('n_offers_year', 4, 'off')} as stratum from c""")
query("stratum_sizes", lambda f: strata.sizes(_keyed(f("strat_customers")), "stratum", 0.1, 0.03), f"select stratum, count(*) as n, floor(count(*) * 0.1::double)::bigint as n_control, {_r('count(*) * 0.03::double', 'exp_conv')} from {_KEYED} group by stratum")
query("stratum_size_summary", lambda f: strata.size_summary(_keyed(f("strat_customers")), "stratum"), f"with n as (select count(*) as k from {_KEYED} group by stratum) select count(*) as n_strata, min(k) as min, {', '.join(_r(f'quantile_cont(k, {p})', x) for p, x in ((0.5, 'median'), (0.1, 'p10'), (0.25, 'p25'), (0.75, 'p75')))}, max(k) as max from n")
query("merge_sparse", lambda f: strata.merge_sparse(_keyed(f("strat_customers")), "stratum", 200).select("cost_ID", "stratum_final"), f"with k as {_KEYED} select cost_ID, case when count(*) over (partition by stratum) < 200 then 'STRATA_MERGED' else stratum end as stratum_final from k")
query("describe_strata", lambda f: strata.describe(_keyed(f("strat_customers")), "stratum", ["visa_bin", "n_offers_year"]).select("stratum", "n", F.array_join("visa_bin", ",").alias("visa_values"), F.array_join("n_offers_year", ",").alias("offer_values"), "description"), f"""with k as {_KEYED}, d as (select stratum, count(*) as n, list_sort(list_distinct(list(visa_bin)))[1:5] as v, list_sort(list_distinct(list(n_offers_year::varchar) filter (n_offers_year is not null)))[1:5] as o from k group by stratum)
select stratum, n, coalesce(array_to_string(v, ','), '') as visa_values, coalesce(array_to_string(o, ','), '') as offer_values, 'visa=' || coalesce(array_to_string(v, ','), '') || ' | n_offers_year=' || coalesce(array_to_string(o, ','), '') as description from d""")
query("tree_strata", lambda f: strata.tree(f("strat_customers"), LEAST, rel_err=0.0).select("cost_ID", "stratum_A_key", "stratum_A"))
query("tree_first_strata", lambda f: strata.tree(f("strat_customers"), LEAST, rel_err=0.0, selection="first").select("cost_ID", "stratum_A"))


def _coarsen_sql() -> str:
    """Every round of the coarsening as a table; the first whose strata are all large enough counts, else the last."""
    bins, rounds = dict(strata.COARSEN_START), []
    while True:
        rounds.append(dict(bins))
        shrink = next((c for c in strata.COARSEN_ORDER if bins[c] > 2), None)
        if shrink is None:
            break
        bins[shrink] -= 1
    cuts = sorted({(c, n) for r in rounds for c, n in r.items()})
    edge = lambda c, n, i: f"coalesce((q_{c}_{n}.q[{i}])::double::varchar, '')"
    place = lambda c, n: f"len(list_filter(q_{c}_{n}.q, lambda e: e < {c}))"
    text = lambda c, n: f"case when {c} is null then '__NULL__' else '(' || case when {place(c, n)} = 0 then '-inf' else {edge(c, n, place(c, n))} end || ',' || case when {place(c, n)} = len(q_{c}_{n}.q) then 'inf)' else {edge(c, n, f'{place(c, n)} + 1')} || ']' end end"
    ctes = [f"q_{c}_{n} as {_q(c, n)}" for c, n in cuts]
    for i, r in enumerate(rounds):
        key = " || ' | ' || ".join([f"'visa_ind_bin=' || {_VISA}", *[f"'{c}_bin=' || {text(c, n)}" for c, n in r.items()]])
        ctes.append(f"r{i} as (select cost_ID, {key} as stratum_B from c, {', '.join(f'q_{c}_{n}' for c, n in r.items())})")
        ctes.append(f"m{i} as (select min(k) as k from (select count(*) as k from r{i} group by stratum_B))")
    fits = " ".join(f"when (select k from m{i}) >= {LEAST} then {i}" for i in range(len(rounds)))
    every = " union all ".join(f"select {i} as i, * from r{i}" for i in range(len(rounds)))
    return f"with c as {_C}, {', '.join(ctes)}, pick as (select case {fits} else {len(rounds) - 1} end as i) select cost_ID, stratum_B from ({every}) join pick using (i)"


def _coarsen_until_sql() -> str:
    floors, bins, rounds = {"n_web_logins": 2, "n_mobile_logins": 2, "n_offers_year": 2, "balance": 3}, dict(strata.SIMPLE_BINS), []
    while True:
        rounds.append(dict(bins))
        shrink = next((c for c in floors if bins[c] > floors[c]), None)
        if shrink is None:
            break
        bins[shrink] -= 1
    names = {"balance": "bal", "n_web_logins": "web", "n_mobile_logins": "mob", "n_offers_year": "off"}
    ctes = [_qcut_cte(c, n, f"{names[c]}_{n}") for c, n in sorted({(c, n) for r in rounds for c, n in r.items()})]
    for i, r in enumerate(rounds):
        label = " || '|' || ".join(_qcut(c, r[c], f"{names[c]}_{r[c]}").replace(f"'{names[c]}_{r[c]}:", f"'{names[c]}:") for c in strata.SIMPLE_BINS)
        ctes.append(f"r{i} as (select cost_ID, case when visa_ind is null then 'visa:NULL' else 'visa:' || visa_ind end || '|' || {label} as stratum from c)")
        ctes.append(f"m{i} as (select min(floor(k * 0.1::double)) >= 5 and min(k * 0.03::double) >= 1 as fits from (select count(*) as k from r{i} group by stratum))")
    fits = " ".join(f"when (select fits from m{i}) then {i}" for i in range(len(rounds)))
    every = " union all ".join(f"select {i} as i, * from r{i}" for i in range(len(rounds)))
    return f"""with c0 as {_C}, qb as (select quantile_cont(balance, [0.01, 0.99]) as q from c0), c as (select * replace (greatest(least(balance, q[2]), q[1]) as balance) from c0, qb),
{', '.join(ctes)}, pick as (select case {fits} else {len(rounds) - 1} end as i) select cost_ID, stratum from ({every}) join pick using (i)"""


query("coarsen_strata", lambda f: strata.coarsen(f("strat_customers"), LEAST, rel_err=0.0)[0].select("cost_ID", "stratum_B"), _coarsen_sql())
query("coarsen_until", lambda f: strata.coarsen_until(f("strat_customers"), 0.1, 0.03, 5, 1.0)[0].select("cost_ID", "stratum"), _coarsen_until_sql())
query("tree_dt_strata", lambda f: strata.supervised(f("strat_customers")).select("cost_ID", "stratum_C"))
query("kmeans_strata", lambda f: strata.clustered(f("strat_customers"), LEAST, k_start=12)[0].select("cost_ID", "stratum_D"))

query("approach_tree", lambda f: approaches.by_tree(f("strat_customers"), LEAST, rel_err=0.0).summary)
query("approach_coarsening", lambda f: approaches.by_coarsening(f("strat_customers"), LEAST, rel_err=0.0).report)
query("stratum_size_curve", lambda f: plots.stratum_sizes(_keyed(f("strat_customers")), "stratum"), f"select row_number() over (order by count(*) desc, stratum)::int as place, stratum, count(*) as n from {_KEYED} group by stratum")

# ---- assignment ----
_H = "('0x' || substr(md5(cost_ID || '__42'), 1, 8))::bigint"
_SPLIT = f"(select *, case when row_number() over (partition by segment order by {_H}, cost_ID) <= greatest(1, floor(count(*) over (partition by segment) * 0.1::double)) then 'control' else 'test' end as \"group\" from {_C})"


def _split(f) -> DataFrame:
    return assign.exact_split(f("strat_customers"), "segment", "cost_ID")


query("split_md5_exact", lambda f: _split(f).select("cost_ID", "segment", "group"), f'select cost_ID, segment, "group" from {_SPLIT}')
query("split_md5_threshold", lambda f: f("strat_customers").select("cost_ID", assign.md5_control("cost_ID").alias("is_control")), f"select cost_ID, case when {_H} % 10000 < 1000 then 1 else 0 end::int as is_control from {_C}")
query("split_xxhash", lambda f: f("strat_customers").select("cost_ID", assign.hash_control("cost_ID", "segment").alias("is_control")))
query("random_sample", lambda f: assign.random_split(f("strat_customers"), "cost_ID").select("cost_ID", "is_test"))
query("sample_by_stratum", lambda f: assign.stratified_split(f("strat_customers"), "cost_ID", "segment").select("cost_ID", "is_test"))


def _cube(f) -> DataFrame:
    df = f("strat_customers").fillna(0.0, FEATURES)
    return cube.cube_sample(cube.standardise(df, FEATURES), [f"z_{c}" for c in FEATURES], "cost_ID", 0.9, group_rows=500)


query("cube_assignment", _cube)
query("sample_by_engine", lambda f: assign.sample_by(f("strat_customers"), "cost_ID", "segment").select("cost_ID", "is_test"))

# ---- validation ----
_ARMS = "case when {} then {} end"
_ctl, _tst = (lambda x: _ARMS.format("\"group\" = 'control'", x)), (lambda x: _ARMS.format("\"group\" = 'test'", x))


def _smd_sql(x: str) -> str:
    v = f"sqrt((var_samp({_tst(x)}) + var_samp({_ctl(x)})) / 2)"
    return f"case when {v} = 0 then 0 else (avg({_tst(x)}) - avg({_ctl(x)})) / {v} end"


query("smd", lambda f: validate.feature_balance(_split(f), FEATURES), " union all ".join(f"select '{c}' as feature, {_r(f'avg({_ctl(c)})', 'mean_control')}, {_r(f'avg({_tst(c)})', 'mean_test')}, {_r(_smd_sql(c), 'smd')} from {_SPLIT}" for c in FEATURES))


def _strata_sql() -> str:
    stats = ", ".join(f"{_r(f'avg({_ctl(c)})', f'{c}_mc')}, {_r(f'var_samp({_ctl(c)})', f'{c}_vc')}, {_r(f'avg({_tst(c)})', f'{c}_mt')}, {_r(f'var_samp({_tst(c)})', f'{c}_vt')}, abs({_smd_sql(c)}) as s_{c}" for c in ("balance", "n_offers_year"))
    return f"""with x as (select *, {_VISA} as visa_bin from {_SPLIT}),
s as (select segment, count(*) as n, count(*) filter ("group" = 'control') as n_control, count(*) filter ("group" = 'test') as n_test, {stats} from x group by segment),
p as (select segment, visa_bin, count(*) filter ("group" = 'control') as c, count(*) filter ("group" = 'test') as t from x group by all),
d as (select p.segment, max(abs(c / n_control::double - t / n_test::double)) as d from p join s using (segment) group by p.segment)
select segment, n, n_control, n_test, balance_mc, balance_vc, balance_mt, balance_vt, n_offers_year_mc, n_offers_year_vc, n_offers_year_mt, n_offers_year_vt, {_r('s_balance', 'balance_smd')}, {_r('s_n_offers_year', 'n_offers_year_smd')}, {_r('d', 'visa_bin_max_prop_diff')},
(s_balance <= 0.1 and s_n_offers_year <= 0.1 and d <= 0.02)::int as pass_all from s join d using (segment)"""


def _report(f) -> DataFrame:
    df = _split(f).withColumn("visa_bin", binning.flag_label()).withColumn("is_control", (F.col("group") == "control").cast("int"))
    return validate.strata_report(df, "segment", "is_control", ["balance", "n_offers_year"], ["visa_bin"])


query("validate_strata", _report, _strata_sql())
query("validate_summary", lambda f: validate.strata_summary(_report(f)), f"with r as ({_strata_sql()}) select count(*) as n_strata, count(*) filter (pass_all = 0) as n_failed, count(*) filter (pass_all is null) as n_undetermined, min(n) as min_n from r")


def _binned(f) -> DataFrame:
    return _split(f).withColumn("bin", F.coalesce("n_offers_year", F.lit(-1)))


_BINNED = f"(select *, coalesce(n_offers_year, -1) as bin from {_SPLIT})"
_COUNTS = f"n as (select bin, count(*) filter (\"group\" = 'control') as c, count(*) filter (\"group\" = 'test') as t from {_BINNED} group by bin), a as (select sum(c) as c, sum(t) as t, count(*) as k from n)"
query("psi", lambda f: validate.psi(_binned(f), "bin"), f"with {_COUNTS}, s as (select n.c / a.c::double + 1e-6 as c, n.t / a.t::double + 1e-6 as t from n, a) select {_r('sum((t - c) * ln(t / c))', 'psi')} from s")
query("ks_statistic", lambda f: validate.ks(_split(f), "balance"), f"""with v as (select balance, count(*) filter ("group" = 'control') as c, count(*) filter ("group" = 'test') as t from {_SPLIT} where balance is not null group by balance), a as (select sum(c)::bigint as c, sum(t)::bigint as t from v),
d as (select abs(sum(v.c) over (order by balance) / a.c::double - sum(v.t) over (order by balance) / a.t::double) as d from v, a) select {_r('max(d)', 'statistic')}, (select c from a) as n_control, (select t from a) as n_test from d""")
query("chi2_statistic", lambda f: validate.chi_square(_binned(f), "bin"), f"""with {_COUNTS}, e as (select n.c as oc, n.t as ot, (n.c + n.t) * a.c / (a.c + a.t)::double as ec, (n.c + n.t) * a.t / (a.c + a.t)::double as et, k from n, a)
select {_r('sum(pow(oc - ec, 2) / ec + pow(ot - et, 2) / et)', 'statistic')}, max(k) - 1 as dof from e""")
query("welch_t", lambda f: validate.welch(_split(f), "balance"), f"""with m as (select avg({_ctl('balance')}) as mc, avg({_tst('balance')}) as mt, var_samp({_ctl('balance')}) / count({_ctl('balance')}) as b, var_samp({_tst('balance')}) / count({_tst('balance')}) as a, count({_ctl('balance')}) as nc, count({_tst('balance')}) as nt from {_SPLIT})
select {_r('(mt - mc) / sqrt(a + b)', 'statistic')}, {_r('pow(a + b, 2) / (a * a / (nt - 1) + b * b / (nc - 1))', 'dof')} from m""")


def _unrounded(name: str) -> str:
    return re.sub(r"round\((.+?), 6\) as (statistic|dof)", r"(\1) as \2", ORACLE[name])


_KS_P = "greatest(0, least(1, case when x < 0.2 then 1 else 2 * (select sum((case when k % 2 = 1 then 1 else -1 end) * exp(-2 * k * k * x * x)) from (select unnest(range(1, 101)) as k)) end))"
query("ks_p_value", lambda f: validate.p_value(validate.ks(_split(f), "balance"), "ks"), f"with s as (select *, statistic * sqrt(n_control * n_test / (n_control + n_test)::double) as x from ({_unrounded('ks_statistic')})) select {_r('statistic', 'statistic')}, {_r(_KS_P, 'p_value')} from s")
query("chi2_p_value", lambda f: validate.p_value(validate.chi_square(_binned(f), "bin"), "chi_square"), f"with s as ({_unrounded('chi2_statistic')}) select {_r('statistic', 'statistic')}, {_r('1 - (select sum(exp((dof / 2 + n) * ln(statistic / 2) - statistic / 2 - lgamma(dof / 2 + n + 1))) from (select unnest(range(0, 2000)) as n))', 'p_value')} from s")
_BETA = "exp(lgamma(a + 0.5) - lgamma(a) - lgamma(0.5) + a * ln(x) + 0.5 * ln(1 - x)) / a * (select sum(exp(lgamma(a + 0.5 + n) - lgamma(a + 0.5) - lgamma(a + 1 + n) + lgamma(a + 1) + n * ln(x))) from (select unnest(range(0, 1000000)) as n))"
query("welch_p_value", lambda f: validate.p_value(validate.welch(_split(f), "balance"), "welch"), f"with s as (select statistic, dof / 2 as a, dof / (dof + statistic * statistic) as x from ({_unrounded('welch_t')})) select {_r('statistic', 'statistic')}, {_r(_BETA, 'p_value')} from s")


def _smd_frames(f) -> DataFrame:
    df = _split(f)
    return validate.smd_or_errors(df.where("group = 'test'"), df.where("group = 'control'"), [*FEATURES, "segment", "nowhere"])


_FILLED = f"(select \"group\", {', '.join(f'coalesce({c}, 0) as {c}' for c in FEATURES)} from {_SPLIT})"
query("smd_or_errors", _smd_frames, " union all ".join([f"select '{c}' as feature, {_r(f'abs({_smd_sql(c)})', 'smd')}, null as error from {_FILLED}" for c in FEATURES] + ["select 'segment', null, 'not a number'", "select 'nowhere', null, 'no such column'"]))


def _methods(f) -> DataFrame:
    df = f("strat_customers").fillna(0.0, FEATURES).withColumn("bin", F.coalesce("n_offers_year", F.lit(0)))
    md5 = df.withColumn("is_test", 1 - assign.md5_control("cost_ID"))
    exact = assign.exact_split(df, "segment", "cost_ID").withColumn("is_test", (F.col("group") == "test").cast("int"))
    return validate.compare_methods({"md5": md5, "exact": exact}, ["balance", "n_offers_year"], "bin")


query("method_compare", _methods)

# ---- Shapley ----
_G = duck("coalitions")


def _shapley_sql(v: str) -> str:
    from math import factorial

    n = len(CHANNELS)
    w = " ".join(f"when {r} then {factorial(r) * factorial(n - r - 1)}::double / {factorial(n)}" for r in range(n))
    bits = ", ".join(f"({1 << i}, '{c}')" for i, c in enumerate(CHANNELS))
    return f"""with g as {_G}, m as (select i::int as mask, bit_count(i::int) as size from range({1 << n}) t(i)), sm as (select bit_count(mask::int) as size, avg(rate) as mean from g group by 1),
v as (select m.mask, m.size, {v} as v from m left join g using (mask) left join sm on sm.size = m.size), c(bit, channel) as (values {bits})
select channel, {_r(f"sum(case a.size {w} end * (b.v - a.v))", 'value')} from c join v a on (a.mask & c.bit) = 0 join v b on b.mask = a.mask + c.bit group by channel"""


_BASE = "coalesce((select rate from g where mask = 0), 0)"
_ADD = f"{_BASE} + " + " + ".join(f"case when m.mask & {1 << i} <> 0 then coalesce((select rate from g where mask = {1 << i}), {_BASE}) - {_BASE} else 0 end" for i in range(len(CHANNELS)))
_V = {"full": "coalesce(g.rate, 0)", "additive": _ADD, "grouping": "coalesce(case when g.sample_size >= 100 then g.rate end, sm.mean, 0)"}
for _m, _v in _V.items():
    query(f"shapley_{_m}", lambda f, m=_m: shapley.shapley(f("coalitions"), CHANNELS, m, 100), _shapley_sql(_v))
query("shapley_auto", lambda f: shapley.shapley(f("coalitions"), CHANNELS, "auto", 5), _shapley_sql(_V["full"]))
query("shapley_methods", lambda f: plots.attribution(f("coalitions"), CHANNELS, 100, shapley.METHODS[:3]), " union all ".join(f"select '{m}' as method, channel, value from ({_shapley_sql(v)})" for m, v in _V.items()))
query("coalition_summary", lambda f: shapley.summary(f("coalitions"), len(CHANNELS), 100), f"with g as {_G} select 16::int as possible, count(*) as observed, 16 - count(*) as missing, count(*) filter (sample_size >= 100) as sufficient, count(*) / 16::double as coverage, {_r('count(*) filter (sample_size >= 100) / count(*)::double', 'sufficient_share')} from g")
query("synth_customers", lambda f: synth.customers(f("strat_customers").sparkSession, 1000))
query("synth_coalitions", lambda f: synth.coalitions(f("strat_customers").sparkSession, CHANNELS, "mixed"))

# ---- outcomes ----
_M, _O = duck("measurement"), duck("scored_offers")


def _offer_ranks(f) -> DataFrame:
    return outcomes.proposed_ranks(f("priority_new"), f("proposed_offers"), PRODUCTS)


_PLACES = f"(select p.customer_id, p.proposed_product, coalesce(x.r, 0)::int as rank from {duck('proposed_offers')} p left join ({_ranks(duck('priority_new'))}) x on x.customer_id = p.customer_id and x.product = p.proposed_product)"
query("priority_ranks", _offer_ranks, f"select * from {_PLACES}")
query("priority_alignment", lambda f: outcomes.priority_alignment(_offer_ranks(f)), f"select count(*) as n_offers, count(*) filter (rank = 0) as n_unranked, {', '.join(_r(f'avg(case when rank <= {k} then 1.0 else 0.0 end)', f'pct_top{k}') for k in (1, 3, 5, 10))} from {_PLACES}")
query("priority_distribution", lambda f: outcomes.rank_distribution(_offer_ranks(f)), f"select rank, count(*) as n_offers from {_PLACES} group by rank")
_FLAGGED = f"(select *, coalesce(upper(response_state) in ('ACTIVATED', 'ACTIONED', 'INTERESTED'), false)::int as activated, coalesce(upper(response_state) in ('ACTIONED', 'INTERESTED'), false)::int as actioned, coalesce(upper(response_state) = 'INTERESTED', false)::int as interested from {_M})"
_RATES = "count(*) as n, " + ", ".join(_r(f"avg({x})", f"{x}_rate") for x in ("activated", "actioned", "interested"))
query("response_flags", lambda f: outcomes.with_flags(f("measurement")), f"select * from {_FLAGGED}")
query("response_funnel", lambda f: outcomes.funnel_by(f("measurement")), f"select {_RATES} from {_FLAGGED}")
query("response_by_state", lambda f: outcomes.funnel_by(f("measurement"), ["response_state"]), f"select response_state, {_RATES} from {_FLAGGED} group by response_state")


def _by_group(f) -> DataFrame:
    groups = f("strat_customers").where("visa_ind is not null").select(F.col("cost_ID").alias("customer_id"), "segment")
    return outcomes.funnel_by_group(f("measurement"), groups, "segment")


query("outcome_by_group", _by_group, f"select g.segment, {_RATES} from {_FLAGGED} m left join (select cost_ID, segment from {_C} where visa_ind is not null) g on g.cost_ID = m.customer_id group by g.segment")
_DECILES = f"(select *, ntile(10) over (order by legacy_score desc nulls last, offer_id)::int as legacy_decile, ntile(10) over (order by new_score desc nulls last, offer_id)::int as new_decile from {_O})"


def _deciles(f) -> DataFrame:
    df = outcomes.score_deciles(f("scored_offers"), "legacy_score", "legacy_decile", ["offer_id"])
    return outcomes.score_deciles(df, "new_score", "new_decile", ["offer_id"])


query("score_deciles", lambda f: _deciles(f).select("offer_id", "legacy_decile", "new_decile"), f"select offer_id, legacy_decile, new_decile from {_DECILES}")
query("score_deciles_by_product", lambda f: outcomes.score_deciles(f("scored_offers"), "new_score", "decile", ["offer_id"], ["product"]).select("offer_id", "decile"), f"select offer_id, ntile(10) over (partition by product order by new_score desc nulls last, offer_id)::int as decile from {_O}")
query("decile_distribution", lambda f: outcomes.decile_distribution(_deciles(f), "new_decile"), f"select product, new_decile as decile, count(*) as n from {_DECILES} group by all")
query("decile_transition", lambda f: outcomes.decile_transition(_deciles(f)), f"select legacy_decile, new_decile, count(*) as n from {_DECILES} group by all")
query("month_product_rates", lambda f: outcomes.month_rates(f("measurement"), [199505, 199511]), f"select month, product, {_RATES} from {_FLAGGED} where month in (199505, 199511) group by month, product")
query("common_customer_rates", lambda f: outcomes.common_customer_rates(f("measurement"), 199505, 199511), f"with c as (select customer_id from {_M} where month = 199505 intersect select customer_id from {_M} where month = 199511) select month, product, {_RATES} from {_FLAGGED} where customer_id in (select customer_id from c) group by month, product")
query("to_pct", lambda f: f("scored_offers").select("offer_id", S.to_pct((F.col("offer_id") % 1000) / 1000).alias("pct")), f"select offer_id, round(100 * ((offer_id % 1000) / 1000::double), 4) as pct from {_O}")
