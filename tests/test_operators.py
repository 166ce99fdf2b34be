"""Edge cases and invariants on hand-written frames."""

import math
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlab.functions import scalar as S
from cohortlab.functions import special
from cohortlab.operators import assign, binning, cube, outcomes, ranking, shapley, strata, subset, validate
from cohortlab.plans import approaches, plots, report
from cohortlab.sources import fixtures, sinks, synth, work

SF = "/root/testdata/sf0.001"


def wide(spark, rows, products=("product_1", "product_2", "product_10")):
    schema = "customer_id long, control int, " + ", ".join(f"{p} double" for p in products)
    return spark.createDataFrame(rows, schema)


def test_ties_go_by_name_as_text(spark):
    df = wide(spark, [(1, 0, 5.0, 5.0, 5.0), (2, 0, None, 1.0, -1.0)])
    got = {r.customer_id: r.ranked_products for r in ranking.sorted_products(df).collect()}
    assert got == {1: ["product_1", "product_10", "product_2"], 2: ["product_2", "product_1", "product_10"]}


def test_top_k_beyond_the_products(spark):
    df = wide(spark, [(1, 0, 3.0, 2.0, 1.0)])
    assert ranking.topk_value(df, 10).first()["top10_ev"] == 6.0
    assert ranking.topk_overlap(df, df, 10).first()["top10_overlap"] == pytest.approx(0.3)
    assert ranking.total_value(df, []).first()["total_ev"] == 0.0


@pytest.mark.parametrize("n, want", [(1, -1.0), (2, 0.0), (3, 0.2), (5, 1 / 3)])
def test_spearman_of_disjoint_lists(spark, n, want):
    df = spark.createDataFrame([([f"a{i}" for i in range(n)], [f"b{i}" for i in range(n)])], "a array<string>, b array<string>")
    assert df.select(S.topn_spearman("a", "b")).first()[0] == pytest.approx(want)


def test_full_spearman_edges(spark):
    df = spark.createDataFrame([(["x"], ["y"]), (["x", "y"], ["y", "x"]), (["x", "y"], ["y", "z"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(S.full_spearman("a", "b")).collect()] == [1.0, -1.0, None]


def test_swap_minds_the_order(spark):
    a, b = wide(spark, [(1, 0, 3.0, 2.0, 1.0)]), wide(spark, [(1, 0, 2.0, 3.0, 1.0)])
    assert ranking.topk_swap(a, b, 2).first()["top2_changed"] == 1
    assert ranking.topk_overlap(a, b, 2).first()["top2_overlap"] == 1.0


def test_subsets(spark):
    df = wide(spark, [(1, 0, 1.0, 1.0, 1.0), (2, 1, 1.0, 1.0, 1.0), (3, None, 1.0, 1.0, 1.0)])
    assert [r.customer_id for r in subset.test_group(df).collect()] == [1]
    assert subset.by_customers(df, [1, 3]).count() == 2
    assert subset.by_products(df, ["product_2", "nope"]).columns == ["customer_id", "control", "product_2"]
    with pytest.raises(ValueError):
        subset.by_customers(df, 5)


def test_binning_edges(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, x double")
    assert {r.b for r in binning.quantile_bin(df, "x", "b", 4).collect()} == {"__NULL__"}
    df = spark.createDataFrame([(i, 7.0) for i in range(5)], "id long, x double")
    assert binning.quantile_cuts(df, {"x": [4]}, 0.0)["x", 4] == [7.0]
    assert binning.tree_cuts(df, "x", F.lit(1)) == []
    assert df.select(binning.interval_label("x", []).alias("b")).first().b == "(-inf,inf)"
    with pytest.raises(ValueError):
        binning.bucketize(df, "x", 1)
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert fixtures.nan_to_null(nan).where("x is null").count() == 1
    empty = df.where("id < 0")
    assert binning.profile(empty, ["x"]).first().null_share is None


@pytest.mark.parametrize("n", [6, 100, 600, 7 * 12])
def test_exact_ranks_are_those_of_the_sql(spark, n):
    import duckdb

    df = spark.range(n + 1).selectExpr("if(id = 0, null, cast(id as double)) as x", "if(id = 1, double('nan'), if(id > 3, id, null)) as y", "cast(null as double) as z")
    probs = [i / k for k in range(2, 9) for i in range(1, k)] + [0.0, 0.01, 0.07, 0.99, 1.0]
    want = lambda start: duckdb.sql(f"select quantile_disc(i::double, [{', '.join(map(str, probs))}]) from range({start}, {n + 1}) r(i)").fetchall()[0][0]
    assert binning.quantiles(df, dict.fromkeys("xyz", probs), 0.0) == {"x": want(1), "y": want(4), "z": []}


def test_supervised_cuts_read_every_row(spark):
    x = lambda n: spark.range(n).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 10 < F.when(F.col("id") % 8 < 4, 2).otherwise(8)).cast("int").alias("y"))
    assert binning.tree_cuts(x(800), "x", F.col("y")) == binning.tree_cuts(x(640_000), "x", F.col("y")) == [3.5]
    many = spark.range(300_000).select("id", (F.col("id") >= 150_000).cast("int").alias("y"))
    cuts = binning.tree_cuts(many, "id", F.col("y"))
    assert any(abs(c - 150_000) < 10_000 for c in cuts)


@given(st.dictionaries(st.integers(-1, 12), st.integers(1, 60), min_size=1), st.integers(1, 80))
def test_merged_bins_keep_all_rows(counts, least):
    groups = binning.merge_small(counts, least)
    assert sum(g.size for g in groups) == sum(counts.values())
    assert sorted(b for g in groups for b in g.bins if b != -1) == sorted(b for b in counts if b != -1)
    assert len(groups) == 1 or min(g.size for g in groups if g.bins != [-1]) >= least or len([g for g in groups if g.bins != [-1]]) == 1
    for g in groups:
        inner = [b for b in g.bins if b != -1]
        assert inner == sorted(inner)


def test_tree_leaves_are_large_enough(spark):
    df = fixtures.frame(spark, "/root/testdata/sf0.01", "strat_customers")
    out = strata.tree(df, 80, rel_err=0.0)
    sizes = [r["count"] for r in out.groupBy("stratum_A").count().collect()]
    assert sum(sizes) == df.count() and min(sizes) >= 80 and len(sizes) > 1
    assert strata.tree(df, 10_000).select("stratum_A_key").distinct().first()[0] == "ROOT"


MANY_NODES = ["cast(id % 3 as int) as visa_ind", "cast(id * 7919 % 6007 as double) as balance", "id * 31 % 11 as n_offers_year", "if(id % 5 = 0, null, id * 17 % 13) as n_web_logins", "id % 7 as n_mobile_logins"]


@pytest.mark.parametrize("selection", ["best", "first"])
def test_tree_of_many_nodes_leaves_them_off_the_driver(spark, monkeypatch, selection):
    df, seen = spark.range(6000).selectExpr("id as cost_ID", *MANY_NODES), []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.extend(rows := collect(self)) or rows)
    out = strata.tree(df, 2, rel_err=0.0, selection=selection)
    monkeypatch.undo()
    sizes = [r["count"] for r in out.groupBy("stratum_A").count().collect()]
    assert sum(sizes) == 6000 and min(sizes) >= 2 and len(sizes) > 500
    assert len(seen) < 100


def test_approach_by_a_tree_of_many_nodes_leaves_them_off_the_driver(spark, monkeypatch):
    df, seen = spark.range(6000).selectExpr("id as cost_ID", *MANY_NODES), []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.extend(rows := collect(self)) or rows)
    got = approaches.by_tree(df, 2, rel_err=0.0).summary.collect()[0]
    assert got.n_strata > 500 and got.min_n >= 2 and len(seen) < 100


@pytest.mark.parametrize("selection", ["best", "first"])
def test_rows_of_a_tree_are_planned_once_and_its_tables_dropped(spark, selection):
    made = len(work._made)
    df = spark.range(3000).selectExpr("id as cost_ID", *MANY_NODES, "null as nothing")
    out = strata.tree(df, 20, rel_err=0.0, selection=selection)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1 and len(work._made) == made + 1
    assert out.dtypes[:-2] == df.dtypes and {r.cost_ID for r in out.collect()} == set(range(3000))


def test_work_tables_are_data_files_only(spark, tmp_path):
    assert work.save(spark.range(3), "three", f"file://{tmp_path}").count() == 3
    names = [p.name for d in tmp_path.iterdir() for p in d.iterdir()]
    assert names and not [n for n in names if "_SUCCESS" in n]


@pytest.mark.parametrize("nodes", [0, 1 << 20])
def test_tree_is_the_same_merged_and_broadcast(spark, monkeypatch, nodes):
    df = spark.range(3000).selectExpr("id as cost_ID", *MANY_NODES)
    want = {r.cost_ID: r.stratum_A_key for r in strata.tree(df, 20, rel_err=0.0).collect()}
    monkeypatch.setattr(strata, "FEW_NODES", nodes)
    assert {r.cost_ID: r.stratum_A_key for r in strata.tree(df, 20, rel_err=0.0).collect()} == want and len(set(want.values())) > 20


def test_tree_edges(spark):
    df = spark.range(40).selectExpr("id as cost_ID", "cast(null as int) as visa_ind", "cast(null as double) as balance", "id as n_offers_year")
    order = ("visa_ind", "balance", "n_offers_year")
    assert strata.tree(df, 10, order).groupBy("stratum_A_key").count().count() > 1
    assert {r.stratum_A for r in strata.tree(df, 10, order[:2]).collect()} == {"A_001"}
    assert strata.tree(df, 10, ("visa_ind",)).first().stratum_A_key == "ROOT"
    assert strata.tree(df, 10, order, max_depth=0).first().stratum_A_key == "ROOT"
    assert strata.tree(df, 10, order, bins_try=()).first().stratum_A_key == "ROOT"
    assert strata.tree(df.where("cost_ID < 0"), 10, order).count() == 0


def test_coarsening_and_ids(spark):
    df = fixtures.frame(spark, "/root/testdata/sf0.01", "strat_customers")
    out, bins = strata.coarsen(df, 1, rel_err=0.0)
    assert bins == strata.COARSEN_START
    _, bins = strata.coarsen(df, 10_000, rel_err=0.0)
    assert set(bins.values()) == {2}
    keys = spark.range(1500).select(F.format_string("k%05d", "id").alias("k"))
    ids = [r.i for r in strata.numbered(keys, "k", "i", "A_").orderBy("k").collect()]
    assert ids[0] == "A_001" and ids[999] == "A_1000" and len(set(ids)) == 1500


def test_clusters_stop(spark):
    df = fixtures.frame(spark, SF, "strat_customers")
    out, k = strata.clustered(df, 10_000, k_start=3)
    assert k == 1 and out.select("stratum_D").distinct().count() == 1


def test_exact_split_counts_and_partitions(spark):
    df = spark.range(997).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("c").alias("s"))
    runs = [sorted((r.id, r.group) for r in assign.exact_split(df.repartition(n), "s", "id").select("id", "group").collect()) for n in (1, 13)]
    assert runs[0] == runs[1]
    for r in assign.exact_split(df, "s", "id").groupBy("s").agg(F.count_if(F.col("group") == "control").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        assert r.c == max(1, math.floor(r.n * 0.1))
    for split in (assign.random_split(df, "id"), assign.stratified_split(df, "id", "s")):
        assert 0.85 < split.agg(F.avg("is_test")).first()[0] < 0.95
    with pytest.raises(ValueError):
        assign.random_split(df, "nope")


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    x, pi = rng.normal(size=(400, 3)), np.full(400, 0.3)
    x = np.hstack([x, pi[:, None]])
    out = cube.flight(x, pi, rng)
    assert ((out > 0) & (out < 1)).sum() <= 4
    assert np.allclose((x / pi[:, None] * out[:, None]).sum(axis=0), x.sum(axis=0))


def test_cube_decides_everyone_once(spark):
    df = spark.range(3000).select("id", *[F.randn(i).alias(f"z{i}") for i in range(3)])
    df = spark.createDataFrame(df.toPandas())
    out = cube.cube_sample(df, ["z0", "z1", "z2"], "id", 0.9, group_rows=400)
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    got = out.join(df, "id").where("is_test = 1").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"z{i}") for i in range(3)]).first()
    assert abs(got.n - 2700) <= 6


def test_validation_edges(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 1.0), ("b", 0, 3.0), ("b", 0, 4.0), (None, 0, 1.0)], "s string, is_control int, x double")
    got = {r.s: r.pass_all for r in validate.strata_report(df, "s", numeric=["x"]).collect()}
    assert got == {"a": None, "b": None}
    assert validate.strata_summary(validate.strata_report(df, "s", numeric=["x"])).first().n_undetermined == 2
    one = df.where("is_control = 1")
    assert validate.chi_square(one, "x", "is_control", 1, 0).first().statistic is None
    assert validate.ks(one, "x", "is_control", 1, 0).first().statistic is None
    same = spark.createDataFrame([(i % 2, 5.0) for i in range(10)], "arm int, x double")
    assert validate.feature_balance(same, ["x"], "arm", 0, 1).first().smd == 0.0


def test_p_values():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.kolmogorov_tail(1.3580986393225505) == pytest.approx(0.05, abs=1e-7)
    assert special.gamma_upper(2.0, 0.0) == 1.0 and special.beta_regularised(1, 1, 0.25) == pytest.approx(0.25)


#: A worked example of eight rates and its Shapley values.
RATES = {0: 0.05, 1: 0.08, 2: 0.10, 4: 0.06, 3: 0.14, 5: 0.12, 6: 0.13, 7: 0.18}
SHARES = {"full": (0.13 / 3, 0.35 / 6, 0.17 / 6), "grouping": (0.13 / 3, 0.35 / 6, 0.17 / 6), "auto": (0.13 / 3, 0.35 / 6, 0.17 / 6), "additive": (0.03, 0.05, 0.01)}


@pytest.mark.parametrize("method", sorted(SHARES))
def test_worked_example(spark, method):
    table = spark.createDataFrame([(m, 10, r) for m, r in RATES.items()], "mask int, sample_size int, rate double")
    got = {r.channel: r.value for r in shapley.shapley(table, ["A", "B", "C"], method).collect()}
    assert [got[c] for c in "ABC"] == pytest.approx(list(SHARES[method]), abs=1e-9)


def test_shapley_methods(spark):
    few = spark.createDataFrame([(0, 10, 0.1), (1, 10, 0.2)], "mask int, sample_size int, rate double")
    assert shapley.choose_method(few, 3) == "additive"
    with pytest.raises(ValueError):
        shapley.shapley(few, ["A"], "nope")
    table = synth.coalitions(spark, ["a", "b", "c", "d"], "complete")
    got = {r.channel: r.value for r in shapley.shapley(shapley.to_masks(table, ["a", "b", "c", "d"]), ["a", "b", "c", "d"]).collect()}
    assert sum(got.values()) == pytest.approx(0.12)
    gone = synth.custom_coalitions(spark, ["a", "b"], missing=[["a"]], small=[["a", "b"]])
    assert gone.count() == 3 and gone.where("a = 1 and b = 1").first().sample_size == 1
    assert synth.coalitions(spark, ["a", "b"], "small_sample", min_count=1).count() == 4


def test_synth_does_not_depend_on_partitions(spark):
    df = synth.customers(spark, 2000)
    assert abs(df.where("visa_ind is null").count() / 2000 - 0.3) < 0.05
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, synth.customers(spark, 2000).repartition(7).collect()), key=repr)


def test_flags_and_unranked(spark):
    df = spark.createDataFrame([("interested",), (None,), ("Proposed",)], "response_state string")
    assert [tuple(r)[1:] for r in outcomes.with_flags(df).collect()] == [(1, 1, 1), (0, 0, 0), (0, 0, 0)]
    pr = wide(spark, [(1, 0, 3.0, 2.0, 1.0)])
    offers = spark.createDataFrame([(1, "product_99"), (1, "product_2")], "customer_id long, proposed_product string")
    got = lambda u: sorted((r.proposed_product, r.rank) for r in outcomes.proposed_ranks(pr, offers, ["product_1", "product_2", "product_10"], unranked=u).collect())
    assert got("zero") == [("product_2", 2), ("product_99", 0)] and got("null") == [("product_2", 2), ("product_99", None)]
    assert outcomes.funnel_by_group(df, None, "g") is None


@settings(deadline=None, max_examples=5)
@given(st.lists(st.one_of(st.none(), st.integers(0, 6).map(float)), min_size=1, max_size=60))
def test_deciles_are_tiles(spark, scores):
    df = spark.createDataFrame(list(enumerate(scores)), "id long, s double")
    got = {r.id: r.d for r in outcomes.score_deciles(df, "s", "d", ["id"]).collect()}
    order = sorted(range(len(scores)), key=lambda i: (scores[i] is None, -(scores[i] or 0), i))
    small, large = divmod(len(scores), 10)
    want = [t + 1 for t in range(10) for _ in range(small + (t < large))]
    assert [got[i] for i in order] == want


def test_deciles_where_one_score_has_half_the_rows(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 2 = 0, 5d, cast(id % 97 as double)) as s").repartition(8)
    got = outcomes.score_deciles(df, "s", "d", ["id"])
    want = df.selectExpr("id", "ntile(10) over (order by s desc nulls last, id) as want")
    assert got.join(want, "id").where("d <> want").isEmpty()


def test_percentiles_of_columns_too_large_to_gather(spark):
    df = spark.range(5000).selectExpr("if(id % 11 = 0, null, pow(id % 701, 2) / 7) as a", "if(id % 2 = 0, 3d, cast(id as double)) as b", "cast(null as double) as c")
    probs = [0.0, 0.25, 0.77]
    want = df.selectExpr(*[f"percentile({c}, array({', '.join(map(str, probs))})) as {c}" for c in "ab"]).first()
    for most in (10_000, 300):
        got = binning.exact_percentiles(df, dict.fromkeys("abc", probs), most)
        assert got["a"] == pytest.approx(list(want.a)) and got["b"] == pytest.approx(list(want.b)) and got["c"] is None


def test_work_tables_can_be_cleared(spark, tmp_path):
    import os

    work.clear(spark)
    saved = work.save(spark.range(3), "x", f"file://{tmp_path}")
    assert saved.count() == 3 and len(os.listdir(tmp_path)) == 1
    assert work.clear(spark) == 1 and not os.listdir(tmp_path) and work.clear(spark) == 0


def test_last_row_of_a_channel_set_wins(spark):
    df = spark.createDataFrame([(1, 1, 0, 10, 0.1), (2, 1, 0, 5, 0.3), (3, 0, 1, 7, 0.2)], "k int, a int, b int, sample_size int, rate double")
    got = {r.mask: (r.sample_size, r.rate) for r in shapley.to_masks(df, ["a", "b"], last_by="k").collect()}
    assert got == {1: (5, 0.3), 2: (7, 0.2)}


def test_cube_joins_back(spark):
    df = spark.range(400).selectExpr("id as cost_ID", "cast(id % 7 as double) as x", "'kept' as note")
    got = cube.cube_split(df, ["x"], "cost_ID", 0.5, group_rows=100)
    assert got.columns == [*df.columns, "is_test"] and got.count() == 400 and abs(got.where("is_test = 1").count() - 200) <= 3


def test_report_and_files(spark, tmp_path):
    legacy, new = (fixtures.frame(spark, SF, f"priority_{s}") for s in ("legacy", "new"))
    made, pictures, path = report.run(legacy, new, report.Scenario("active", tuple(fixtures.PRODUCTS[:4])), tmp_path)
    with made:
        assert len(made.artifacts) == 6 + 10 * 3
        n = made["customers"].table.first().n_customers
        assert sum(r.n_customers for r in made["top3_overlap_vs_corr"].table.collect()) == n
        assert {"ev_diff", "swap_rates", "top5_product_shift"} <= set(pictures)
        assert pictures["ev_diff"].agg(F.sum("n")).first()[0] == n
    text = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert "top3_swap_summary" in text and "swap_rate" in text
    many = sinks.write_xlsx(tmp_path / "x.xlsx", [("a" * 40, [["x", 1, None, True]]), ("a" * 40, [])])
    assert zipfile.ZipFile(many).testzip() is None
    sinks.write_files(new.limit(3), str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == new.columns
    assert plots.overlaid(ranking.total_value(legacy), ranking.total_value(new), "total_ev").count() > 0
    assert len(report.presets({"all": fixtures.PRODUCTS}, new)) == 2
