"""Seeded inputs for trials: customers and channel sets. Values are functions of id and seed, not of partitions."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from math import exp, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, salt: str, *cols: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, salt: str, *cols: str) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, salt + "r", *cols))) * F.cos(6.283185307179586 * _uniform(seed, salt + "a", *cols))


def _poisson(u: Column, mean: float, most: int = 40) -> Column:
    total, steps = 0.0, []
    for k in range(most):
        total += exp(-mean) * mean**k / factorial(k)
        steps.append(total)
    return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s < u))


def customers(spark: SparkSession, n: int = 100_000, seed: int = 42) -> DataFrame:
    """Features with the usual shares of nulls: flag 30 %, balance 7 %, web 40 %, mobile 70 %, offers 33 %."""
    df = spark.range(1, n + 1).select(F.col("id").alias("cost_ID"))
    u = lambda salt: _uniform(seed, salt, "cost_ID")
    keep = lambda salt, share, value: F.when(u(salt) >= share, value)
    level = F.when(u("segment") < 0.7, 7.0).when(u("segment") < 0.95, 8.5).otherwise(10.5)
    return df.select(
        "cost_ID",
        keep("vn", 0.30, (u("visa") < 0.42).cast("int")).alias("visa_ind"),
        keep("bn", 0.07, F.round(F.exp(level + 0.8 * _normal(seed, "balance", "cost_ID")), 2)).alias("balance"),
        keep("wn", 0.40, _poisson(u("web"), 6.0)).alias("n_web_logins"),
        keep("mn", 0.70, _poisson(u("mobile"), 9.0)).alias("n_mobile_logins"),
        keep("on", 0.33, _poisson(u("offers"), 4.0)).alias("n_offers_year"),
    )


#: Of each scenario the share of proper sets that are missing, and of middle sets with few rows.
SCENARIOS = {"complete": (0.0, 0.0), "missing": (0.3, 0.0), "small_sample": (0.0, 0.4), "mixed": (0.2, 0.3)}


def coalitions(spark: SparkSession, channels: Sequence[str], scenario: str = "complete", base: float = 0.05, lift: float = 0.03, min_count: int = 5, seed: int = 42) -> DataFrame:
    """A 0/1 column per channel, ``sample_size, rate`` of all sets but the missing ones."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario}")
    gone, few = SCENARIOS[scenario]
    n = len(channels)
    df = spark.range(1 << n).select(F.col("id").cast("int").alias("mask")).withColumn("k", F.bit_count("mask"))
    size = 50 + F.floor(_uniform(seed, "size", "mask") * 150)
    small = 1 + F.floor(_uniform(seed, "small", "mask") * max(1, min_count - 1))
    middle = (F.col("k") >= 2) & (F.col("k") < n)
    df = df.where(~((F.col("k") < n) & (F.col("k") > 0) & (_uniform(seed, "gone", "mask") < gone)))
    df = df.withColumn("sample_size", F.when(middle & (_uniform(seed, "few", "mask") < few), small).otherwise(size).cast("int"))
    return df.select(*[F.col("mask").bitwiseAND(1 << i).cast("boolean").cast("int").alias(c) for i, c in enumerate(channels)], "sample_size", F.least(F.lit(1.0), base + lift * F.col("k")).alias("rate"))


def custom_coalitions(spark: SparkSession, channels: Sequence[str], missing: Collection[Collection[str]] = (), small: Collection[Collection[str]] = (), **kw) -> DataFrame:
    """The complete table without the given sets, and with one row in the others."""
    df = coalitions(spark, channels, **kw)

    def among(sets: Collection[Collection[str]]) -> Column:
        keys = [",".join(c for c in channels if c in set(s)) for s in sets]
        own = F.concat_ws(",", *[F.when(F.col(c) == 1, c) for c in channels])
        return own.isin(*keys) if keys else F.lit(False)

    return df.withColumn("sample_size", F.when(among(small), 1).otherwise(F.col("sample_size"))).where(~among(missing))
