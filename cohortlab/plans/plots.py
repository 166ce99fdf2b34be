"""The numbers behind plots, as small tables; pictures where matplotlib is there."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.operators import shapley
from cohortlab.sources import sinks

if TYPE_CHECKING:
    from .report import Report


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """``bin, low, high, n`` over all rows: equal widths from the least to the greatest value."""
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull()).select(v.alias("v"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))))).cast("int")
    counted = rows.crossJoin(F.broadcast(ends)).groupBy(number.alias("bin"), "lo", width.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n").orderBy("bin")


def overlaid(legacy: DataFrame, new: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Histograms of both sides over common bins."""
    both = legacy.select(F.lit("legacy").alias("side"), F.col(column).alias("v")).unionByName(new.select(F.lit("new").alias("side"), F.col(column).alias("v"))).where("v is not null")
    ends = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    number = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor(bins * F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))))).cast("int")
    return both.crossJoin(F.broadcast(ends)).groupBy("side", number.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("side", "bin")


def density(df: DataFrame, column: str, arm: str, points: int = 100) -> DataFrame:
    """Shares of each arm in equal bins, the data of a density plot."""
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull()).select(F.col(arm).alias("arm"), v.alias("v"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    number = F.least(F.lit(points - 1), F.floor(points * F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)))).cast("int")
    counts = rows.crossJoin(F.broadcast(ends)).groupBy("arm", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(F.col("arm").alias("__a")).agg(F.sum("n").alias("__n"))
    return counts.join(sums, counts["arm"].eqNullSafe(sums["__a"])).select("arm", "bin", (F.col("n") / F.col("__n")).alias("share"))


def stratum_sizes(df: DataFrame, column: str) -> DataFrame:
    """``place, stratum, n``: strata from large to small, the data of a size curve; a row per stratum."""
    sizes = df.groupBy(F.col(column).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(F.row_number().over(Window.orderBy(F.desc("n"), "stratum")).alias("place"), "stratum", "n")


def attribution(table: DataFrame, channels: Sequence[str], min_count: int = 5, methods: Sequence[str] = shapley.METHODS) -> DataFrame:
    """``method, channel, value`` of the Shapley methods, the data of grouped bars."""
    parts = [shapley.shapley(table, channels, m, min_count).withColumn("method", F.lit(m)) for m in methods]
    return reduce(DataFrame.unionByName, parts).select("method", "channel", "value")


def report_plots(report: Report, top: int = 15) -> dict[str, DataFrame]:
    """A table per plot of a report."""
    out = {"ev_diff": histogram(report["ev_diff"].table, "total_ev_diff")}
    for k in report.scenario.ks:
        pairs = report[f"top{k}_overlap_vs_corr"].table
        out |= {
            f"top{k}_ev_diff": histogram(report[f"top{k}_ev_diff"].table, f"top{k}_ev_diff"),
            f"top{k}_overlap": pairs.select("overlap_count", "pct_customers"),
            f"top{k}_overlap_vs_corr": pairs.select("overlap_count", "avg_rank_corr"),
            f"top{k}_product_shift": report[f"top{k}_product_shift"].table.limit(top),
        }
    swaps = [report[f"top{k}_swap_summary"].table.select(F.lit(k).alias("k"), "swap_rate") for k in report.scenario.ks]
    for part in swaps[1:]:
        swaps[0] = swaps[0].unionByName(part)
    return out | {"swap_rates": swaps[0]}


def draw(table: DataFrame, x: str, y: str, path: str, title: str = "") -> bool:
    """Bars as PNG; False where matplotlib is not installed."""
    try:
        from matplotlib import pyplot
    except ImportError:
        return False
    data = sinks.bounded_pandas(table)
    figure, axes = pyplot.subplots()
    axes.bar(data[x].astype(str), data[y])
    axes.set_title(title)
    figure.savefig(path)
    pyplot.close(figure)
    return True
