"""Every query that SQL can express equals its SQL; the others run and have a stable shape."""

import collections
import math

import duckdb
import pytest

from cohortlab.operators import strata
from cohortlab.plans import catalogue
from cohortlab.sources import fixtures

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE[name])


def test_coarsening_equals_sql_where_a_rank_is_whole(spark, tmp_path):
    """Sixty customers for each of the table's: ranks of sixths are whole numbers between two values."""
    con = connect(SF)
    con.execute(f"copy (select c.* replace (c_custkey + 1000 * i as c_custkey) from customer c, range(60) r(i)) to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (select o.* replace (o_orderkey + 10000 * i as o_orderkey, o_custkey + 1000 * i as o_custkey) from orders o, range(60) r(i)) to '{tmp_path}/orders.parquet'")
    con.execute(f"copy (select e.* replace (user_id + 1000 * i as user_id) from events e, range(60) r(i)) to '{tmp_path}/events.parquet'")
    large = duckdb.connect()
    for t in ("customer", "orders", "events"):
        large.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = catalogue.QUERIES["coarsen_strata"](spark, str(tmp_path))
    assert_same(got, large, catalogue.ORACLE["coarsen_strata"])


def _is_share(df, column, low, high):
    assert set(df[column]) <= {0, 1} and low <= df[column].mean() <= high and df.cost_ID.is_unique and len(df) == 150


def _strata_hold(df, column, least):
    sizes = df.groupby(column).size()
    assert df.cost_ID.is_unique and len(df) == 150 and (sizes.min() >= least or len(sizes) == 1)


INVARIANTS = {
    "tree_strata": lambda d: _strata_hold(d, "stratum_A", catalogue.LEAST),
    "tree_first_strata": lambda d: _strata_hold(d, "stratum_A", catalogue.LEAST),
    "tree_dt_strata": lambda d: _strata_hold(d, "stratum_C", 1),
    "kmeans_strata": lambda d: _strata_hold(d, "stratum_D", catalogue.LEAST),
    "approach_tree": lambda d: _one_row(d),
    "approach_coarsening": lambda d: _report(d),
    "split_xxhash": lambda d: _is_share(d, "is_control", 0.02, 0.2),
    "random_sample": lambda d: _is_share(d, "is_test", 0.8, 0.98),
    "sample_by_stratum": lambda d: _is_share(d, "is_test", 0.8, 0.98),
    "sample_by_engine": lambda d: _is_share(d, "is_test", 0.8, 0.98),
    "cube_assignment": lambda d: _is_share(d, "is_test", 0.87, 0.93),
    "method_compare": lambda d: _methods(d),
    "synth_customers": lambda d: _thousand(d),
    "synth_coalitions": lambda d: _coalitions(d),
}


def _one_row(d):
    assert len(d) == 1 and not d.isna().all(axis=None)


def _report(d):
    assert d.n.sum() == 150 and (d.n_control + d.n_test == d.n).all() and set(d.pass_all.dropna()) <= {0, 1}


def _methods(d):
    assert sorted(d.method) == ["exact", "md5"] and (d[["mean_smd", "mean_ks", "chi_square", "mean_total_error"]] >= 0).all(axis=None) and (d.mean_ks <= 1).all()


def _thousand(d):
    assert len(d) == 1000 and d.iloc[:, 0].is_unique


def _coalitions(d):
    assert 0 < len(d) <= 2 ** len(catalogue.CHANNELS) and not d.isna().any(axis=None)
    assert not d[[c for c in d.columns if c in catalogue.CHANNELS or c == "mask"]].duplicated().any()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_holds_its_invariants(spark, name):
    INVARIANTS[name](catalogue.QUERIES[name](spark, SF).toPandas())


def brute_tree(df, least, selection, order=("visa_ind", "balance", "n_offers_year", "n_web_logins", "n_mobile_logins"), bins_try=(6, 5, 4, 3, 2), depth=6):
    """The split tree, node by node on plain lists; keys by customer."""
    rows = df.astype(object).where(df.notna(), None).to_dict("records")
    keys = {r["cost_ID"]: {} for r in rows}

    def quantile(values, p):
        return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]

    def merged(sizes):
        groups = [([b], n) for b, n in sorted(sizes.items()) if b >= 0]
        missing = sizes.get(-1, 0)
        if not groups:
            return [([-1], missing)]
        while len(groups) > 1 and min(n for _, n in groups) < least:
            i = [n for _, n in groups].index(min(n for _, n in groups))
            j = min((x for x in (i - 1, i + 1) if 0 <= x < len(groups)), key=lambda x: groups[x][1])
            a, b = min(i, j), max(i, j)
            groups[a : b + 1] = [(groups[a][0] + groups[b][0], groups[a][1] + groups[b][1])]
        if missing >= least:
            return [([-1], missing), *groups]
        return [(groups[0][0] + [-1] * bool(missing), groups[0][1] + missing), *groups[1:]]

    def split(node, c):
        if c == "visa_ind":
            label = {r["cost_ID"]: "__NULL__" if r[c] is None else str(int(r[c] == 1)) for r in node}
            return label if len(set(label.values())) > 1 and min(collections.Counter(label.values()).values()) >= least else None
        values = [r[c] for r in node if r[c] is not None]
        for n in bins_try if values else ():
            cuts = sorted({quantile(values, i / n) for i in range(1, n)})
            number = {r["cost_ID"]: -1 if r[c] is None else sum(x < r[c] for x in cuts) for r in node}
            groups = merged(collections.Counter(number.values()))
            if len(groups) > 1 and min(k for _, k in groups) >= least:
                return {i: next(f"G{g}" for g, (bins, _) in enumerate(groups) if b in bins) for i, b in number.items()}
        return None

    level, used = [rows], []
    for d in range(depth):
        below = []
        for node in level:
            found = [(c, x) for c in order if len(node) >= 2 * least and (x := split(node, c))]
            if not found:
                continue
            best = lambda f: (len(set(f[1].values())), min(collections.Counter(f[1].values()).values()))
            c, label = found[0] if selection == "first" else max(found, key=best)
            column = f"__A_L{d}_{c}_bin"
            used.append(column)
            for i, x in label.items():
                keys[i][column] = x
            below += [[r for r in node if label[r["cost_ID"]] == x] for x in sorted(set(label.values()))]
        level = below
    return {i: " | ".join(f"{c}={k.get(c, '__NA__')}" for c in sorted(set(used))) or "ROOT" for i, k in keys.items()}


@pytest.mark.parametrize("selection", ["best", "first"])
def test_tree_equals_a_node_by_node_tree(spark, selection):
    sf = "/root/testdata/sf0.01"
    df = fixtures.frame(spark, sf, "strat_customers")
    got = {r.cost_ID: r.stratum_A_key for r in strata.tree(df, catalogue.LEAST, rel_err=0.0, selection=selection).collect()}
    assert got == brute_tree(df.toPandas(), catalogue.LEAST, selection) and len(set(got.values())) > 8


def test_first_tree_of_many_nodes_equals_a_node_by_node_tree(spark):
    df = fixtures.frame(spark, "/root/testdata/sf0.01", "strat_customers")
    got = {r.cost_ID: r.stratum_A_key for r in strata.tree(df, 3, rel_err=0.0, selection="first").collect()}
    assert got == brute_tree(df.toPandas(), 3, "first") and len(set(got.values())) > 200


def test_every_product_is_compared(spark):
    assert {f"{p}_abs_diff" for p in catalogue.PRODUCTS} < set(catalogue.QUERIES["value_diff"](spark, SF).columns)
    assert {r["product"] for r in catalogue.QUERIES["report_top3_shift"](spark, SF).collect()} - set(catalogue.PRODUCTS[:12])


def test_subset_goes_by_segment(spark):
    got = {r.customer_id % 8 for r in catalogue.QUERIES["subset_customers_products"](spark, SF).collect()}
    assert len(got) > 1


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_works_without_the_optional_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).parent.parent
    shutil.copytree(here / "cohortlab", tmp_path / "cohortlab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(q.startswith('op') for q in e.queries()); print(len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert run.returncode == 0, run.stderr
