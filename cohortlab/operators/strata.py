"""Customer strata with a least size."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.scalar import NULL_LABEL
from cohortlab.sources import work

from . import binning

NUMERIC = ("balance", "n_offers_year", "n_web_logins", "n_mobile_logins")
FLAG = "visa_ind"


def key(columns: Sequence[str], sep: str = " | ", named: bool = True) -> Column:
    """The columns' values in one text, ``name=value`` each; null parts vanish."""
    return F.concat_ws(sep, *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) if named else F.col(c).cast("string") for c in columns])


def numbered(df: DataFrame, key_col: str, out: str, prefix: str, width: int = 3) -> DataFrame:
    """Short ids by rank of the key: ``A_001``. The rank runs over the distinct keys, not over the rows, and widens
    where there are more keys than digits hold."""
    keys = df.select(key_col).distinct()
    n = F.row_number().over(Window.orderBy(key_col)).cast("string")
    ids = keys.select(F.col(key_col).alias("__key"), F.concat(F.lit(prefix), F.when(F.length(n) > width, n).otherwise(F.lpad(n, width, "0"))).alias(out))
    return df.join(ids, df[key_col].eqNullSafe(ids["__key"]), "left").drop("__key")


@dataclass
class _Split:
    """A node's split: the feature's place in the order, the cuts (none for a flag), and by code + 1 of the feature the
    label of the child, whose sizes ``children`` has. A code is the number of the interval, or the flag's value; -1 is null."""

    feature: int
    cuts: list[float]
    label_of: list[str | None]
    children: dict[str, int]


def _interval(c: str, cuts: Column) -> Column:
    """Number of the right-closed interval between the cuts, -1 for null."""
    return F.when(F.col(c).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda x: F.col(c).cast("double") > x)))


def _flag_code(c: str, mode: str) -> Column:
    zero = F.when(F.col(c).isNull(), -1).otherwise(0) if mode == "3way" else F.lit(0)
    return F.when(F.col(c) == 1, 1).otherwise(zero)


def _flag_labels(mode: str) -> list[str]:
    return [NULL_LABEL, "0", "1"] if mode == "3way" else ["", "0_or_null", "1"]


def tree(df: DataFrame, least: int, order: Sequence[str] = (FLAG, *NUMERIC), bins_try: Sequence[int] = (6, 5, 4, 3, 2), max_depth: int = 6, rel_err: float = 0.001, flag_mode: str = "3way", selection: str = "best", key_col: str = "stratum_A_key", id_col: str = "stratum_A") -> DataFrame:
    """Split customers into a tree whose leaves all have ``least`` rows or more.

    A node may split by a flag's values or by the first bin count of a numeric feature whose merged bins are large
    enough. ``best`` takes the feature with the most children, then the largest least child, then the earlier one;
    ``first`` the earliest feature that can split. Jobs are per level, not per node: one grouped percentile for the cuts
    of all nodes, features and bin counts, one grouped count of the finest intervals that any bin count needs, from which
    every bin of a node is added up where the node's counts are. Nodes are as many as the rows allow, so they stay in
    tables: a row's node is the text of its path, which each level joins to its splits; the driver holds none of them.
    ``rel_err`` is the error of the quantiles (0: exact, up to ten million values a node).
    """
    numeric = [c for c in order if c != FLAG]
    void = {c for c, kind in df.dtypes if kind == "void"}  # no file holds these
    probs = sorted({i / n for n in bins_try for i in range(1, n)})
    here = work.save(df.select(*dict.fromkeys(order)).withColumn("__node", F.lit("")), "tree-rows")
    levels: list[tuple[DataFrame, list[int]]] = []
    while len(levels) < max_depth:
        cuts = work.save(_level_cuts(here, numeric, probs, rel_err).where(F.col("__n") >= 2 * least), "tree-cuts")
        splits = work.save(_level_splits(here, cuts, order, probs, bins_try, least, flag_mode, selection), "tree-splits")
        if not (used := sorted(r[0] for r in splits.select("__feature").distinct().collect())):
            work.drop(cuts, splits)
            break
        levels.append((splits, used))
        if len(levels) < max_depth:
            below = _down(here, order, splits, used, flag_mode, "inner").where(F.col("__size") >= 2 * least)
            above, here = here, work.save(below.select(*here.columns), "tree-rows")
            work.drop(above)
        work.drop(cuts)
    out, parts = df.withColumn("__node", F.lit("")), {}
    for depth, (splits, used) in enumerate(levels):
        out = _down(out, order, splits, used, flag_mode, "left").drop("__size")
        out = out.withColumnsRenamed({x: f"{x}_{depth}" for x in ("__feature", "__label")})
        for j in used:
            parts[f"__A_L{depth}_{order[j]}_bin"] = F.when(F.col(f"__feature_{depth}") == j, F.col(f"__label_{depth}"))
    named = [F.concat(F.lit(f"{c}="), F.coalesce(parts[c], F.lit("__NA__"))) for c in sorted(parts)]
    out = out.withColumn(key_col, F.concat_ws(" | ", *named) if named else F.lit("ROOT"))
    # what the caller does with the rows plans one join for the ids, not all levels once more for every use of them
    keyed = work.save(out.select(*[F.lit(1).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns], key_col), "tree-keys")
    work.drop(here, *[splits for splits, _ in levels])
    return numbered(keyed.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns], key_col), key_col, id_col, "A_")


#: Nodes of a level up to which their table is sent to all executors; it has a kilobyte a node at most.
FEW_NODES = 4096


def _with_nodes(df: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Rows with what ``nodes`` has of theirs: broadcast while there are few nodes with many rows each, else merged."""
    return df.join(F.broadcast(nodes) if nodes.count() <= FEW_NODES else nodes.hint("merge"), "__node", how)


def _down(df: DataFrame, order: Sequence[str], splits: DataFrame, used: Sequence[int], flag_mode: str, how: str) -> DataFrame:
    """Replace ``__node`` by the child's; rows of closed nodes keep theirs. Adds the splitting feature's place as
    ``__feature``, the child's ``__label`` and its ``__size``, null for rows of closed nodes."""
    code = F.coalesce(*[F.when(F.col("__feature") == j, _flag_code(order[j], flag_mode) if order[j] == FLAG else _interval(order[j], F.col("__cuts"))) for j in used])
    out = _with_nodes(df, splits, how).withColumn("__code", code + 2)
    out = out.withColumns({"__label": F.try_element_at("__labels", F.col("__code")), "__size": F.try_element_at("__sizes", F.col("__code"))})
    child = F.concat("__node", F.lit("/"), F.col("__feature").cast("string"), F.lit(":"), "__label")
    return out.withColumn("__node", F.coalesce(child, "__node")).drop("__code", "__cuts", "__labels", "__sizes")


def _level_cuts(here: DataFrame, numeric: Sequence[str], probs: Sequence[float], rel_err: float) -> DataFrame:
    """``__node, __n, __cuts_0, ...``: rows, and by numeric feature the quantiles of all ``probs``, which may repeat; null
    without values."""
    accuracy = 10_000_000 if not rel_err else max(100, round(1 / rel_err))
    cut = lambda c: F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy) if probs else F.first(F.lit(None).cast("array<double>"))
    return here.groupBy("__node").agg(F.count(F.lit(1)).alias("__n"), *[cut(c).alias(f"__cuts_{i}") for i, c in enumerate(numeric)])


def _level_splits(here: DataFrame, cuts: DataFrame, order: Sequence[str], probs: Sequence[float], bins_try: Sequence[int], least: int, flag_mode: str, selection: str) -> DataFrame:
    """``__node, __feature, __cuts, __labels, __sizes``: the chosen split of every node that has one; labels and sizes of
    the children are by code + 1. Rows are counted by node, feature and code; codes of numeric features count the finest
    intervals."""
    flags, tests, column = _flag_labels(flag_mode), [], {}
    for j, c in enumerate(order):
        if c == FLAG:
            code = _flag_code(c, flag_mode)
        else:
            column[j] = f"__cuts_{len(column)}"
            code = _interval(c, F.coalesce(column[j], F.array().cast("array<double>")))
        tests.append(F.struct(F.lit(j).alias("j"), code.alias("code")))
    counts = _with_nodes(here, cuts, "inner").select("__node", F.inline(F.array(*tests))).groupBy("__node", "j", "code").count()
    counts = counts.groupBy("__node").agg(F.flatten(F.collect_list(F.array(*[F.col(c).cast("long") for c in ("j", "code", "count")]))).alias("__counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                found: dict[int, dict[int, int]] = {}
                for j, code, n in row["__counts"].reshape(-1, 3).tolist():
                    found.setdefault(j, {})[code] = n
                fine = {j: [] if row[x] is None else row[x].tolist() for j, x in column.items()}
                can = [s for j in range(len(order)) if (s := _split(j, found[j], fine.get(j), probs, bins_try, least, flags))]
                if can:
                    s = can[0] if selection == "first" else max(can, key=lambda s: (len(s.children), min(s.children.values())))
                    out.append((row["__node"], s.feature, s.cuts, s.label_of, [s.children.get(x) for x in s.label_of]))
            yield pd.DataFrame(out, columns=["__node", "__feature", "__cuts", "__labels", "__sizes"])

    nodes = counts.join(cuts, "__node").select("__node", "__counts", *column.values())
    return nodes.mapInPandas(run, "__node string, __feature int, __cuts array<double>, __labels array<string>, __sizes array<long>")


def _split(j: int, found: Mapping[int, int], fine: Sequence[float] | None, probs: Sequence[float], bins_try: Sequence[int], least: int, flags: Sequence[str]) -> _Split | None:
    """A node's split by its ``j``-th feature, whose rows by code are ``found``; ``fine`` has the node's quantiles of all
    ``probs``, None for a flag."""
    if fine is None:
        children = {flags[code + 1]: n for code, n in sorted(found.items(), key=lambda x: flags[x[0] + 1])}
        return _Split(j, [], list(flags), children) if len(children) > 1 and min(children.values()) >= least else None
    at = dict(zip(probs, fine, strict=False))
    for n in bins_try if fine else ():
        if not (own := sorted({at[i / n] for i in range(1, n)})):
            continue
        bins: dict[int, int] = {}
        for code, k in found.items():
            b = code if code < 1 else bisect_right(own, fine[code - 1])
            bins[b] = bins.get(b, 0) + k
        groups = binning.merge_small(bins, least)
        if len(groups) > 1 and min(g.size for g in groups) >= least:
            label_of: list[str | None] = [None] * (len(own) + 2)
            for i, g in enumerate(groups):
                for b in g.bins:
                    label_of[b + 1] = f"G{i}"
            return _Split(j, own, label_of, {f"G{i}": g.size for i, g in enumerate(groups)})
    return None


COARSEN_START = {"balance": 6, "n_offers_year": 4, "n_web_logins": 4, "n_mobile_logins": 4}
COARSEN_ORDER = ("n_offers_year", "n_mobile_logins", "n_web_logins", "balance")


def _binned(df: DataFrame, bins: Mapping[str, int], cuts: Mapping, flag_mode: str) -> DataFrame:
    out = df.withColumn(f"{FLAG}_bin", binning.flag_label(FLAG, flag_mode))
    out = out.withColumns({f"{c}_bin": binning.interval_label(c, cuts[c, n]) if cuts[c, n] else F.when(F.col(c).isNull(), NULL_LABEL).otherwise("(-inf,inf)") for c, n in bins.items()})
    return out.withColumn("stratum_B", key([f"{FLAG}_bin", *[f"{c}_bin" for c in bins]]))


def coarsen(df: DataFrame, least: int, start: Mapping[str, int] = COARSEN_START, order: Sequence[str] = COARSEN_ORDER, floor: int = 2, max_rounds: int = 20, rel_err: float = 0.001, flag_mode: str = "3way") -> tuple[DataFrame, dict[str, int]]:
    """Cross all bins; while a stratum is under ``least``, take a bin from the first feature in ``order`` that has more
    than ``floor``. Returns the frame with ``stratum_B`` and the bin counts; the last may still have small strata. Cuts
    of all bin counts come from one job, each round is one grouped count."""
    cuts = binning.quantile_cuts(df, {c: range(floor, n + 1) for c, n in start.items()}, rel_err)
    bins = dict(start)
    for left in range(max(1, max_rounds), 0, -1):
        out = _binned(df, bins, cuts, flag_mode)
        small = out.groupBy("stratum_B").count().agg(F.min("count")).first()[0]
        shrink = next((c for c in order if bins[c] > floor), None)
        if small is None or small >= least or shrink is None or left == 1:
            break
        bins[shrink] -= 1
    return out, bins


SIMPLE_BINS = {"balance": 5, "n_web_logins": 4, "n_mobile_logins": 4, "n_offers_year": 4}


def simple(df: DataFrame, bins: Mapping[str, int] = SIMPLE_BINS, clip: tuple[float, float] = (0.01, 0.99), out: str = "stratum") -> tuple[DataFrame, dict]:
    """Clip the balance, cut features between exact quantiles and join ``visa|balance|web|mobile|offers``."""
    df, lo, hi = binning.clip_exact(df, "balance", *clip)
    names = {"balance": "bal", "n_web_logins": "web", "n_mobile_logins": "mob", "n_offers_year": "off"}
    df = df.withColumn("visa_bin", F.when(F.col(FLAG).isNull(), "visa:NULL").otherwise(F.concat(F.lit("visa:"), F.col(FLAG).cast("int").cast("string"))))
    for c, n in bins.items():
        df = binning.rank_bin(df, c, n, f"{names[c]}_bin", names[c])
    return df.withColumn(out, key(["visa_bin", *[f"{names[c]}_bin" for c in bins]], "|", named=False)), {"balance_low": lo, "balance_high": hi}


def coarsen_until(df: DataFrame, control_share: float, p_global: float, least_control: int = 4000, least_conversions: float = 100, start: Mapping[str, int] = SIMPLE_BINS, floors: Mapping[str, int] | None = None, max_rounds: int = 50) -> tuple[DataFrame, dict[str, int], bool]:
    """Coarsen :func:`simple` strata, web before mobile, offers and balance, until each has controls and expected
    conversions enough; returns the frame, the bins and whether that was reached."""
    floors = floors or {"n_web_logins": 2, "n_mobile_logins": 2, "n_offers_year": 2, "balance": 3}
    bins = dict(start)
    for left in range(max(1, max_rounds), 0, -1):
        out, _ = simple(df, bins)
        worst = sizes(out, "stratum", control_share, p_global).agg(F.min("n_control"), F.min("exp_conv")).first()
        reached = worst[0] is not None and worst[0] >= least_control and worst[1] >= least_conversions
        shrink = next((c for c in floors if bins[c] > floors[c]), None)
        if reached or shrink is None or left == 1:
            break
        bins[shrink] -= 1
    return out, bins, reached


def supervised(df: DataFrame, max_bins: int = 5, features: Sequence[str] = NUMERIC) -> DataFrame:
    """Strata from cut points that separate the flag best (a decision tree per feature): ``stratum_C_key, stratum_C``."""
    target = F.coalesce((F.col(FLAG) == 1).cast("int"), F.lit(0))
    cuts = {c: binning.tree_cuts(df, c, target, max_bins) for c in features}
    out = df.withColumns({f"{c}_cbin": binning.cut_label(c, x) for c, x in cuts.items()}).withColumn(f"{FLAG}_cbin", binning.flag_label())
    return numbered(out.withColumn("stratum_C_key", key([f"{FLAG}_cbin", *[f"{c}_cbin" for c in features]])), "stratum_C_key", "stratum_C", "C_", 4)


def clustered(df: DataFrame, least: int, k_start: int = 50, k_min: int = 2, seed: int = 7, features: Sequence[str] = NUMERIC, id_col: str = "cost_ID") -> tuple[DataFrame, int]:
    """K-means strata: k shrinks by 0.7 until the smallest cluster has ``least`` rows; with ``k_min`` tried in vain all
    rows are one stratum. Returns the frame with ``stratum_D`` and k. Null counts as 0 beside a null indicator."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    made = df.withColumns({f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features} | {f"__n_{c}": F.col(c).isNull().cast("double") for c in features})
    made = made.withColumn("__f_flag", F.coalesce(F.col(FLAG).cast("double"), F.lit(-1.0)))
    inputs = [f"__{x}_{c}" for c in features for x in "fn"] + ["__f_flag"]
    ready = VectorAssembler(inputCols=inputs, outputCol="__v").transform(made)
    ready = StandardScaler(inputCol="__v", outputCol="__features", withMean=True).fit(ready).transform(ready).persist()
    try:
        k = k_start
        while True:
            model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="__k").fit(ready.select("__features"))
            out = model.transform(ready)
            small = out.groupBy("__k").count().agg(F.min("count")).first()[0]
            if (small is not None and small >= least) or k <= k_min:
                break
            k = max(k_min, int(k * 0.7))
        ok = small is not None and small >= least
    finally:
        ready.unpersist()
    number = F.lpad((F.col("__k") + 1).cast("string"), 4, "0") if ok else F.lit("0001")
    return out.withColumn("stratum_D", F.concat(F.lit("D_"), number)).select(*df.columns, "stratum_D"), k if ok else 1


def merge_sparse(df: DataFrame, column: str, floor: int = 30, merged: str = "STRATA_MERGED") -> DataFrame:
    """Strata under ``floor`` rows become one, in ``<column>_final``; null stays null. Counts are joined, not windowed, so
    that a large stratum is in no one task."""
    small = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__s")).count().where(F.col("count") < floor).select("__s", F.lit(merged).alias("__m"))
    out = df.join(small, df[column] == small["__s"], "left")
    return out.withColumn(f"{column}_final", F.coalesce("__m", column)).drop("__s", "__m")


def sizes(df: DataFrame, column: str, control_share: float, p_global: float) -> DataFrame:
    """Rows, controls and expected conversions of every stratum."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(column, "n", F.floor(F.col("n") * F.lit(control_share)).alias("n_control"), (F.col("n") * F.lit(p_global)).alias("exp_conv"))


def size_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: strata, and least, median, 10th, 25th, 75th percentile and greatest size."""
    n = df.groupBy(column).count()
    return n.agg(F.count(F.lit(1)).alias("n_strata"), F.min("count").alias("min"), F.percentile("count", F.array(*[F.lit(x) for x in (0.5, 0.1, 0.25, 0.75)])).alias("q"), F.max("count").alias("max")).select("n_strata", "min", *[F.col("q")[i].alias(x) for i, x in enumerate(("median", "p10", "p25", "p75"))], "max")


def describe(df: DataFrame, column: str, bin_columns: Sequence[str], most: int = 5) -> DataFrame:
    """Rows of each stratum and the first ``most`` distinct values of each bin column; ``description`` has them as text."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), *[F.slice(F.sort_array(F.collect_set(F.col(c).cast("string"))), 1, most).alias(c) for c in bin_columns])
    short = {c: c.removesuffix("_bin").replace("__", "") for c in bin_columns}
    return out.withColumn("description", F.concat_ws(" | ", *[F.concat(F.lit(f"{short[c]}="), F.array_join(c, ",")) for c in bin_columns]))
