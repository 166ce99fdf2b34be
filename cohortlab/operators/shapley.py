"""Shapley values of marketing channels from conversion rates of channel sets.

A set of channels is a bitmask; the table of all sets comes from ``range(2 ** n)``. A channel's value sums, over all sets
without it, the weighted gain of adding it: an equi-join of the value table with itself on ``mask + bit``.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("full", "additive", "grouping", "auto")
MOST_CHANNELS = 20


def to_masks(df: DataFrame, channels: Sequence[str], rate: str = "rate", size: str = "sample_size", last_by: str | None = None) -> DataFrame:
    """``mask, sample_size, rate`` from a column of 0/1 per channel. Rows of one set are pooled by their sizes or, with
    ``last_by``, the row with the greatest value of that column stands for its set."""
    mask = sum((F.when(F.col(c) == 1, 1 << i).otherwise(0) for i, c in enumerate(channels)), F.lit(0))
    rows = df.select(mask.cast("int").alias("mask"), F.col(size).alias("n"), F.col(rate).cast("double").alias("r"))
    if last_by:
        last = df.select(mask.cast("int").alias("mask"), F.struct(F.col(last_by), F.col(size).alias("n"), F.col(rate).cast("double").alias("r")).alias("x")).groupBy("mask").agg(F.max("x").alias("x"))
        return last.select("mask", F.col("x.n").alias("sample_size"), F.col("x.r").alias("rate"))
    pooled = F.coalesce(F.try_divide(F.sum(F.col("r") * F.col("n")), F.sum("n")), F.avg("r"))
    return rows.groupBy("mask").agg(F.sum("n").alias("sample_size"), pooled.alias("rate"))


def _bits(mask: Column) -> Column:
    return F.bit_count(mask)


def summary(table: DataFrame, n: int, min_count: int = 5) -> DataFrame:
    """One row: possible, observed and missing sets, sets with rows enough, coverage and their share."""
    possible = 1 << n
    enough = F.count_if(F.col("sample_size") >= min_count)
    return table.agg(F.lit(possible).alias("possible"), F.count(F.lit(1)).alias("observed"), (F.lit(possible) - F.count(F.lit(1))).alias("missing"), enough.alias("sufficient"), (F.count(F.lit(1)) / F.lit(float(possible))).alias("coverage"), F.coalesce(F.try_divide(enough.cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("sufficient_share"))


def choose_method(table: DataFrame, n: int, min_count: int = 5) -> str:
    """``full`` where sets and rows suffice, ``additive`` where under half of the sets are there, else ``grouping``."""
    s = summary(table, n, min_count).first()
    if s["coverage"] >= 0.9 and s["sufficient_share"] >= 0.9:
        return "full"
    return "additive" if s["coverage"] < 0.5 else "grouping"


def values(table: DataFrame, n: int, method: str, min_count: int = 5) -> DataFrame:
    """``mask, v`` of all sets. full: the rate, 0 if missing; additive: the empty set's rate plus the gains of single
    channels; grouping: the rate where there are rows enough, else the plain mean rate of sets of that size."""
    if n > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels")
    every = table.sparkSession.range(1 << n).select(F.col("id").cast("int").alias("mask"))
    if method == "additive":
        bits = [1 << i for i in range(n)]
        known = table.agg(F.max(F.when(F.col("mask") == 0, F.col("rate"))).alias("b"), *[F.max(F.when(F.col("mask") == b, F.col("rate"))).alias(f"s{b}") for b in bits])
        base = F.coalesce(F.col("b"), F.lit(0.0))
        gains = sum((F.when(F.col("mask").bitwiseAND(b) != 0, F.coalesce(F.col(f"s{b}"), base) - base).otherwise(0.0) for b in bits), F.lit(0.0))
        return every.crossJoin(F.broadcast(known)).select("mask", (base + gains).alias("v"))
    joined = every.join(F.broadcast(table.select("mask", "rate", "sample_size")), "mask", "left")
    if method == "full":
        return joined.select("mask", F.coalesce("rate", F.lit(0.0)).alias("v"))
    if method != "grouping":
        raise ValueError(f"unknown method {method}")
    means = table.groupBy(_bits(F.col("mask")).alias("size")).agg(F.avg("rate").alias("mean"))
    own = F.when(F.col("sample_size") >= min_count, F.col("rate"))
    return joined.withColumn("size", _bits(F.col("mask"))).join(F.broadcast(means), "size", "left").select("mask", F.coalesce(own, "mean", F.lit(0.0)).alias("v"))


def shapley(table: DataFrame, channels: Sequence[str], method: str = "full", min_count: int = 5) -> DataFrame:
    """``channel, value``."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    n = len(channels)
    v = values(table, n, choose_method(table, n, min_count) if method == "auto" else method, min_count)
    names = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(c).alias("channel")) for i, c in enumerate(channels)])
    without = v.select("mask", "v", F.inline(names)).where("(mask & bit) = 0")
    more = v.select(F.col("mask").alias("__m"), F.col("v").alias("__v"))
    weights = F.array(*[F.lit(factorial(r) * factorial(n - r - 1) / factorial(n)) for r in range(n)])
    gains = without.join(more, without["mask"] + without["bit"] == more["__m"])
    return gains.groupBy("channel").agg(F.sum(weights[_bits(F.col("mask"))] * (F.col("__v") - F.col("v"))).alias("value"))
