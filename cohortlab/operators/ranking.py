"""Comparing two product-score tables per customer.

:func:`ranked` ranks a table once, :func:`paired` joins two rankings once; every metric is an expression over the pair, so
a report over several k costs one join. Ties rank by product name as text (``product_10`` before ``product_2``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import scalar as S

from .subset import product_columns


def sorted_products(df: DataFrame, products: Sequence[str] | None = None, out: str = "ranked_products", id_col: str = "customer_id", control_col: str | None = "control", fill: float = 0.0) -> DataFrame:
    """Add all product names by score, best first."""
    products = product_columns(df, id_col, control_col) if products is None else products
    return df.withColumn(out, F.transform(S.scored_array(products, fill), lambda x: x["product"]))


def topk_products(df: DataFrame, k: int, products: Sequence[str] | None = None, out: str | None = None, **kw) -> DataFrame:
    """Add the names of the k best products."""
    name = out or f"top{k}_products"
    return sorted_products(df, products, name, **kw).withColumn(name, F.slice(name, 1, k))


def total_value(df: DataFrame, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control", fill: float = 0.0) -> DataFrame:
    """``id, total_ev``: the sum of all scores."""
    products = product_columns(df, id_col, control_col) if products is None else products
    return df.select(id_col, S.total(products, fill).alias("total_ev"))


def topk_value(df: DataFrame, k: int, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control", fill: float = 0.0) -> DataFrame:
    """``id, top{k}_ev``: the sum of the k best scores."""
    products = product_columns(df, id_col, control_col) if products is None else products
    return df.select(id_col, S.top_value(S.scored_array(products, fill), k).alias(f"top{k}_ev"))


def ranked(df: DataFrame, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control", fill: float = 0.0, suffix: str = "") -> DataFrame:
    """``id, ranked, scored, ev``: everything that comparisons need of a side."""
    products = product_columns(df, id_col, control_col) if products is None else products
    df = df.select(id_col, S.scored_array(products, fill).alias(f"scored{suffix}"), S.total(products, fill).alias(f"ev{suffix}"))
    return df.withColumn(f"ranked{suffix}", F.transform(f"scored{suffix}", lambda x: x["product"]))


def paired(legacy: DataFrame, new: DataFrame, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control", fill: float = 0.0) -> DataFrame:
    """Customers of both tables with both rankings."""
    return ranked(legacy, products, id_col, control_col, fill, "_legacy").join(ranked(new, products, id_col, control_col, fill, "_new"), id_col)


def with_top(pair: DataFrame, k: int) -> DataFrame:
    return pair.withColumns({f"top{k}_{s}": F.slice(f"ranked_{s}", 1, k) for s in ("legacy", "new")})


def topk_metrics(pair: DataFrame, ks: Sequence[int], id_col: str = "customer_id") -> DataFrame:
    """``id`` and for each k ``overlap_k, changed_k, spearman_k, ev_legacy_k, ev_new_k``, in one projection."""
    for k in ks:
        pair = with_top(pair, k)
    out: list[Column] = [F.col(id_col), "ev_legacy", "ev_new", S.full_spearman("ranked_legacy", "ranked_new").alias("full_spearman")]
    for k in ks:
        a, b = f"top{k}_legacy", f"top{k}_new"
        out += [S.overlap(a, b, k).alias(f"overlap_{k}"), S.changed(a, b).alias(f"changed_{k}"), S.topn_spearman(a, b).alias(f"spearman_{k}")]
        out += [S.top_value(f"scored_{s}", k).alias(f"ev_{s}_{k}") for s in ("legacy", "new")]
    return pair.select(*out)


def _metric(legacy: DataFrame, new: DataFrame, k: int, value, name: str, products, id_col: str, control_col) -> DataFrame:
    pair = with_top(paired(legacy, new, products, id_col, control_col), k)
    return pair.select(id_col, value(f"top{k}_legacy", f"top{k}_new").alias(name))


def full_rank_correlation(legacy: DataFrame, new: DataFrame, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control") -> DataFrame:
    return paired(legacy, new, products, id_col, control_col).select(id_col, S.full_spearman("ranked_legacy", "ranked_new").alias("full_rank_corr"))


def topn_rank_correlation(legacy: DataFrame, new: DataFrame, k: int, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control") -> DataFrame:
    return _metric(legacy, new, k, S.topn_spearman, f"top{k}_rank_corr", products, id_col, control_col)


def topk_overlap(legacy: DataFrame, new: DataFrame, k: int, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control") -> DataFrame:
    return _metric(legacy, new, k, lambda a, b: S.overlap(a, b, k), f"top{k}_overlap", products, id_col, control_col)


def topk_swap(legacy: DataFrame, new: DataFrame, k: int, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control") -> DataFrame:
    return _metric(legacy, new, k, S.changed, f"top{k}_changed", products, id_col, control_col)


def top1_agreement(legacy: DataFrame, new: DataFrame, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control") -> DataFrame:
    """``id, top1_legacy, top1_new, top1_same``."""
    pair = paired(legacy, new, products, id_col, control_col)
    first = {s: F.try_element_at(F.col(f"ranked_{s}"), F.lit(1)) for s in ("legacy", "new")}
    return pair.select(id_col, first["legacy"].alias("top1_legacy"), first["new"].alias("top1_new"), F.when(first["legacy"] == first["new"], 1).otherwise(0).alias("top1_same"))


def overlap_count(df: DataFrame, ratio_col: str, k: int, out: str = "overlap_count") -> DataFrame:
    return df.withColumn(out, F.round(F.col(ratio_col) * k, 0).cast("int"))


def product_shift(legacy: DataFrame, new: DataFrame, k: int, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control") -> DataFrame:
    """Per product: how many top-k lists of either side have it, and the share of that side's customers. Both sides go
    into one grouped count; sides are not matched by customer."""
    sides = []
    for side, df in (("legacy", legacy), ("new", new)):
        top = topk_products(df, k, products, "top", id_col=id_col, control_col=control_col)
        sides.append(top.select(F.lit(side).alias("side"), F.explode("top").alias("product")))
    sizes = [df.agg(F.count(F.lit(1)).alias(f"n_{side}")) for side, df in (("legacy", legacy), ("new", new))]
    counts = sides[0].unionByName(sides[1]).groupBy("product").agg(*[F.count_if(F.col("side") == s).alias(f"freq_{s}") for s in ("legacy", "new")])
    out = counts.crossJoin(F.broadcast(sizes[0].crossJoin(sizes[1])))
    share = lambda s: F.coalesce(F.try_divide(F.col(f"freq_{s}"), F.col(f"n_{s}")), F.lit(0.0))
    return out.select("product", "freq_legacy", "freq_new", share("legacy").alias("pct_legacy"), share("new").alias("pct_new")).orderBy("product")


def summary(df: DataFrame, column: str) -> DataFrame:
    """One typed row: count, mean, stddev, min, exact quartiles, max of the non-null values."""
    c = F.col(column).cast("double")
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"), F.min(c).alias("min"), q.alias("q"), F.max(c).alias("max")).select("n", "mean", "stddev", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def metric_difference(legacy: DataFrame, new: DataFrame, column: str, id_col: str = "customer_id") -> DataFrame:
    """``id, {column}_legacy, {column}_new, {column}_diff`` for customers of both."""
    pair = legacy.select(id_col, F.col(column).alias(f"{column}_legacy")).join(new.select(id_col, F.col(column).alias(f"{column}_new")), id_col)
    return pair.withColumn(f"{column}_diff", F.col(f"{column}_new") - F.col(f"{column}_legacy"))


def compare_summaries(legacy: DataFrame, new: DataFrame, column: str, id_col: str = "customer_id") -> DataFrame:
    """Both sides' summaries over the customers they share, a row a side."""
    pair = metric_difference(legacy, new, column, id_col)
    return reduce(DataFrame.unionByName, [summary(pair, f"{column}_{s}").withColumn("side", F.lit(s)) for s in ("legacy", "new")])


def value_differences(legacy: DataFrame, new: DataFrame, products: Sequence[str], id_col: str = "customer_id") -> DataFrame:
    """``id``, the absolute difference of each product's score and their sum."""
    a = legacy.select(id_col, *[S.filled(c).alias(f"__a_{c}") for c in products])
    b = new.select(id_col, *[S.filled(c).alias(f"__b_{c}") for c in products])
    diffs = [F.abs(F.col(f"__b_{c}") - F.col(f"__a_{c}")) for c in products]
    return a.join(b, id_col).select(id_col, *[d.alias(f"{c}_abs_diff") for c, d in zip(products, diffs, strict=True)], reduce(add, diffs, F.lit(0.0)).alias("sum_abs_diff"))


def overlap_by_correlation(metrics: DataFrame, k: int) -> DataFrame:
    """From :func:`topk_metrics`: per number of common products how many customers, their share and rank correlation."""
    counted = overlap_count(metrics, f"overlap_{k}", k)
    groups = counted.groupBy("overlap_count").agg(F.count(F.lit(1)).alias("n_customers"), F.avg(f"overlap_{k}").alias("avg_overlap"), F.avg(f"spearman_{k}").alias("avg_rank_corr"), F.percentile(f"spearman_{k}", 0.5).alias("median_rank_corr"))
    total = metrics.agg(F.count(F.lit(1)).alias("__all"))
    return groups.crossJoin(F.broadcast(total)).withColumn("pct_customers", S.to_pct(F.col("n_customers") / F.col("__all"))).drop("__all").orderBy("overlap_count")


def swap_summary(metrics: DataFrame, k: int) -> DataFrame:
    """How many customers' top-k lists changed, and the share."""
    c = F.col(f"changed_{k}")
    return metrics.agg(F.count(F.lit(1)).alias("n_customers"), F.sum(c).alias("n_changed"), F.avg(c.cast("double")).alias("swap_rate"))


def changed_unchanged_value(legacy: DataFrame, new: DataFrame, changed: Sequence[str], unchanged: Sequence[str], id_col: str = "customer_id") -> DataFrame:
    """Summaries of the value difference over changed and over unchanged products; the latter should be 0."""
    parts = []
    for name, products in (("changed", changed), ("unchanged", unchanged)):
        diff = metric_difference(total_value(legacy, products, id_col), total_value(new, products, id_col), "total_ev", id_col)
        parts.append(summary(diff, "total_ev_diff").withColumn("products", F.lit(name)))
    return parts[0].unionByName(parts[1])
