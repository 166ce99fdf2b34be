"""Balance of control and test groups. Statistics come from one grouped pass; p-values from the few numbers it gives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions import scalar as S
from cohortlab.functions import special


def _moments(c: str, arm: Column, name: str) -> list[Column]:
    v = F.when(arm, F.col(c).cast("double"))
    return [F.avg(v).alias(f"{c}_m{name}"), F.var_samp(v).alias(f"{c}_v{name}"), F.count(v).alias(f"{c}_n{name}")]


def strata_report(df: DataFrame, stratum: str, treat: str = "is_control", numeric: Sequence[str] = (), categorical: Sequence[str] = (), max_smd: float = 0.10, max_diff: float = 0.02) -> DataFrame:
    """Per stratum: sizes, means, variances and absolute SMD of numeric features, greatest difference of a category's
    share, and ``pass_all`` (null where a part can't be told, as with an arm of one row). ``treat`` is 1 for control."""
    control, test = F.col(treat) == 1, F.col(treat) == 0
    df = df.where(F.col(stratum).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(control).alias("n_control"), F.count_if(test).alias("n_test")]
    for c in numeric:
        aggs += _moments(c, control, "c") + _moments(c, test, "t")
    out = df.groupBy(stratum).agg(*aggs).drop(*[f"{c}_n{a}" for c in numeric for a in "ct"])
    out = out.withColumns({f"{c}_smd": F.abs(S.smd(F.col(f"{c}_mt"), F.col(f"{c}_mc"), F.col(f"{c}_vt"), F.col(f"{c}_vc"))) for c in numeric})
    if categorical:
        items = F.array(*[F.struct(F.lit(c).alias("__f"), F.coalesce(F.col(c).cast("string"), F.lit(S.NULL_LABEL)).alias("__v")) for c in categorical])
        long = df.select(stratum, treat, F.inline(items)).groupBy(stratum, "__f", "__v").agg(F.count_if(control).alias("__c"), F.count_if(test).alias("__t"))
        sides = long.join(out.select(F.col(stratum).alias("__s"), "n_control", "n_test"), F.col(stratum) == F.col("__s"))
        gap = F.abs(F.try_divide("__c", "n_control") - F.try_divide("__t", "n_test"))
        gaps = sides.groupBy("__s").agg(*[F.max(F.when(F.col("__f") == c, gap)).alias(f"{c}_max_prop_diff") for c in categorical])
        out = out.join(gaps, out[stratum] == gaps["__s"], "left").drop("__s")
    tests = [F.col(f"{c}_smd") <= max_smd for c in numeric] + [F.col(f"{c}_max_prop_diff") <= max_diff for c in categorical]
    return out.withColumn("pass_all", reduce(lambda a, b: a & b, tests, F.lit(True)).cast("int"))


def strata_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("n_strata"), F.count_if(F.col("pass_all") == 0).alias("n_failed"), F.count_if(F.col("pass_all").isNull()).alias("n_undetermined"), F.min("n").alias("min_n"))


def feature_balance(df: DataFrame, features: Sequence[str], arm: str = "group", control: object = "control", test: object = "test", signed: bool = True) -> DataFrame:
    """A row per feature: means of both arms and the SMD, test minus control."""
    aggs = [x for c in features for x in _moments(c, F.col(arm) == control, "c") + _moments(c, F.col(arm) == test, "t")]
    wide = df.agg(*aggs)
    d = lambda c: S.smd(F.col(f"{c}_mt"), F.col(f"{c}_mc"), F.col(f"{c}_vt"), F.col(f"{c}_vc"))
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_mc").alias("mean_control"), F.col(f"{c}_mt").alias("mean_test"), (d(c) if signed else F.abs(d(c))).alias("smd")) for c in features]
    return wide.select(F.inline(F.array(*rows)))


def _shares(df: DataFrame, column: str, arm: str, control: object, test: object) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("bin")).agg(F.count_if(F.col(arm) == control).alias("n_c"), F.count_if(F.col(arm) == test).alias("n_t"))


def psi(df: DataFrame, column: str, arm: str = "group", control: object = "control", test: object = "test") -> DataFrame:
    """Population stability index of a binned column: one row, ``psi``."""
    counts = _shares(df, column, arm, control, test)
    sums = counts.agg(F.sum("n_c").alias("all_c"), F.sum("n_t").alias("all_t"))
    share = lambda s: F.coalesce(F.try_divide(F.col(f"n_{s}"), F.col(f"all_{s}")), F.lit(0.0)) + F.lit(1e-6)
    c, t = share("c"), share("t")
    return counts.crossJoin(F.broadcast(sums)).agg(F.sum((t - c) * F.log(t / c)).alias("psi"))


def ks(df: DataFrame, column: str, arm: str = "group", control: object = "control", test: object = "test", parts: int = 256) -> DataFrame:
    """Exact two-sample Kolmogorov-Smirnov statistic over all rows: ``statistic, n_control, n_test``.

    Values are counted first; their running sums are taken within ranges of values, each starting from the sum of the
    ranges below, so that no task holds all distinct values. ``parts`` quantiles bound the ranges."""
    v = F.col(column).cast("double")
    counts = df.where(F.col(column).isNotNull()).groupBy(v.alias("v")).agg(F.count_if(F.col(arm) == control).cast("double").alias("c"), F.count_if(F.col(arm) == test).cast("double").alias("t"))
    edges = counts.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("e"))
    ranged = counts.crossJoin(F.broadcast(edges)).withColumn("part", F.size(F.filter("e", lambda e: e < F.col("v")))).drop("e")
    sums = ranged.groupBy("part").agg(F.sum("c").alias("pc"), F.sum("t").alias("pt"))
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = sums.select("part", *[F.coalesce(F.sum(f"p{s}").over(below), F.lit(0.0)).alias(f"b{s}") for s in "ct"], *[F.sum(f"p{s}").over(whole).alias(f"n{s}") for s in "ct"])
    run = Window.partitionBy("part").orderBy("v")
    share = lambda s: F.try_divide(F.sum(s).over(run) + F.col(f"b{s}"), F.col(f"n{s}"))
    placed = ranged.join(F.broadcast(starts), "part").select(F.abs(share("c") - share("t")).alias("d"), "nc", "nt")
    return placed.agg(F.max("d").alias("statistic"), F.max("nc").cast("long").alias("n_control"), F.max("nt").cast("long").alias("n_test"))


def chi_square(df: DataFrame, column: str, arm: str = "group", control: object = "control", test: object = "test") -> DataFrame:
    """Chi-square of a 2 x N table of counts, with Yates' correction at one degree of freedom: ``statistic, dof``; null
    where fewer than two categories have rows or an arm has none."""
    counts = _shares(df, column, arm, control, test).where("n_c + n_t > 0")
    sums = counts.agg(F.sum("n_c").alias("all_c"), F.sum("n_t").alias("all_t"), F.count(F.lit(1)).alias("k"))
    row = (F.col("n_c") + F.col("n_t")).cast("double")
    every = (F.col("all_c") + F.col("all_t")).cast("double")

    def term(side: str) -> Column:
        expected = F.try_divide(row * F.col(f"all_{side}"), every)
        gap = F.abs(F.col(f"n_{side}") - expected)
        gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.try_divide(gap * gap, expected)

    out = counts.crossJoin(F.broadcast(sums)).agg(F.sum(term("c") + term("t")).alias("s"), F.max("k").alias("k"), F.max("all_c").alias("a"), F.max("all_t").alias("b"))
    fine = (F.col("k") >= 2) & (F.col("a") > 0) & (F.col("b") > 0)
    return out.select(F.when(fine, F.col("s")).alias("statistic"), F.when(fine, F.col("k") - 1).alias("dof"))


def welch(df: DataFrame, column: str, arm: str = "group", control: object = "control", test: object = "test") -> DataFrame:
    """Welch's t for unequal variances, test minus control: ``statistic, dof``."""
    m = df.agg(*_moments(column, F.col(arm) == control, "c"), *_moments(column, F.col(arm) == test, "t"))
    a, b = (F.try_divide(F.col(f"{column}_v{s}"), F.col(f"{column}_n{s}")) for s in "tc")
    t = F.try_divide(F.col(f"{column}_mt") - F.col(f"{column}_mc"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col(f"{column}_nt") - 1) + b * b / (F.col(f"{column}_nc") - 1))
    return m.select(t.alias("statistic"), dof.alias("dof"))


def with_p_value(df: DataFrame, test: str) -> dict:
    """The single row of a statistic with its p-value: ``ks``, ``chi_square`` or ``welch``."""
    row = df.first().asDict()
    s = row["statistic"]
    if s is None:
        return row | {"p_value": None}
    p = special.ks_p_value(s, row["n_control"], row["n_test"]) if test == "ks" else special.chi2_tail(s, row["dof"]) if test == "chi_square" else special.t_two_sided(s, row["dof"])
    return row | {"p_value": p}


def p_value(df: DataFrame, test: str) -> DataFrame:
    """``statistic, p_value`` of a statistic's single row, as a table; null where the statistic is."""
    row = with_p_value(df, test)
    return df.sparkSession.createDataFrame([(row["statistic"], row["p_value"])], "statistic double, p_value double")


def smd_or_errors(test: DataFrame, control: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, smd, error``: absolute SMD of two frames, missing values as 0. A column that one frame lacks or that is
    no number gives a row with the error instead. One job a frame."""
    number = lambda df, c: c in df.columns and dict(df.dtypes)[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")
    wrong = {c: "no such column" if c not in test.columns or c not in control.columns else "not a number" for c in columns if not (number(test, c) and number(control, c))}
    fine = [c for c in columns if c not in wrong]
    filled = lambda df: df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in fine])
    out = [test.sparkSession.createDataFrame([(c, None, e) for c, e in wrong.items()], "feature string, smd double, error string")]
    if fine:
        both = filled(test).withColumn("__arm", F.lit(1)).unionByName(filled(control).withColumn("__arm", F.lit(0)))
        out.append(feature_balance(both, fine, "__arm", 0, 1, signed=False).select("feature", "smd", F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, out)


def compare_methods(arms: dict[str, DataFrame], features: Sequence[str], binned: str, arm: str = "is_test", test_share: float = 0.9) -> DataFrame:
    """A row per assignment method: mean absolute SMD and KS of the features, chi-square of a binned column and the
    relative error of scaled-up totals. ``arm`` is 1 for test."""
    out = []
    for name, df in arms.items():
        smds = feature_balance(df, features, arm, 0, 1, signed=False).agg(F.avg("smd").alias("mean_smd"))
        stats = reduce(DataFrame.unionByName, [ks(df, c, arm, 0, 1).select("statistic") for c in features]).agg(F.avg("statistic").alias("mean_ks"))
        chi = chi_square(df, binned, arm, 0, 1).select(F.col("statistic").alias("chi_square"))
        sums = df.agg(*[F.struct(F.sum(F.when(F.col(arm) == 1, F.col(c))).alias("t"), F.sum(c).alias("p")).alias(c) for c in features])
        error = reduce(add, [F.abs(F.try_divide(F.col(f"{c}.t") / test_share - F.col(f"{c}.p"), F.col(f"{c}.p"))) for c in features]) / len(features)
        row = sums.select(F.lit(name).alias("method"), error.alias("mean_total_error"))
        for part in (smds, stats, chi):
            row = row.crossJoin(part)
        out.append(row)
    return reduce(DataFrame.unionByName, out)
