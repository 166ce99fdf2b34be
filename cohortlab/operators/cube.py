"""Balanced sampling by the cube method, in groups.

Customers are dealt to groups by a hash. In each group a flight moves inclusion probabilities along directions that keep
the balancing totals until no direction is left; the few undecided customers of all groups then fly together, and what is
undecided after that is landed by independent draws. Every draw is seeded by group, and the flight's outcome is written
before it is used twice, so that a customer is decided once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.sources import work

EDGE = 1e-9


def standardise(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Centre and scale columns by their mean and sample deviation (0 for a constant); null is an error."""
    stats = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns], *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first().asDict()
    if bad := [c for c in columns if stats[f"n_{c}"]]:
        raise ValueError(f"{bad[0]} has nulls; fill them first")
    return df.withColumns({prefix + c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"]) if stats[f"s_{c}"] else F.lit(0.0) for c in columns})


def flight(x: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide all but at most as many units as there are balancing columns. ``x`` is units x columns."""
    pi = pi.astype(float).copy()
    scaled = x / np.where(pi > 0, pi, 1)[:, None]
    waiting = np.flatnonzero((pi > EDGE) & (pi < 1 - EDGE)).tolist()
    width = x.shape[1] + 1
    active, rest = waiting[:width], waiting[width:][::-1]
    while len(active) == width:
        *_, vt = np.linalg.svd(scaled[active].T, full_matrices=True)
        u, p = vt[-1], pi[active]
        with np.errstate(divide="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        p = p + (up if rng.random() < down / (up + down) else -down) * u
        pi[active] = np.where(p < EDGE, 0, np.where(p > 1 - EDGE, 1, p))
        active = [i for i in active if 0 < pi[i] < 1]
        while rest and len(active) < width:
            active.append(rest.pop())
    return pi


def _flier(names: list[str], seed: int, level: int, last: bool, keep_size: bool):
    """The flight of one group; the last group's undecided are landed."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x = pdf[names].to_numpy(float)
        x = np.hstack([x, pdf[["pi"]].to_numpy(float)]) if keep_size else x
        rng = np.random.default_rng([seed, level, int(pdf["g"].iloc[0])])
        pi = flight(x, pdf["pi"].to_numpy(float), rng)
        if last:
            open_ = (pi > 0) & (pi < 1)
            pi[open_] = rng.random(int(open_.sum())) < pi[open_]
        return pdf.assign(pi=pi)[["id", *names, "pi"]]

    return fly


def cube_sample(df: DataFrame, columns: Sequence[str], id_col: str, share: float, seed: int = 42, group_rows: int = 5000, keep_size: bool = True, work_dir: str | None = None) -> DataFrame:
    """``id, is_test``: a sample of ``share`` whose totals of ``columns`` are close to the population's.

    ``keep_size`` also balances on the inclusion probability, which fixes the sample's size. Undecided customers, at
    most ``len(columns) + 1`` a group, fly again in groups of the same size until one group is left."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    names = [*columns]
    current = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in names], F.lit(float(share)).alias("pi"))
    schema = f"id {df.schema[id_col].dataType.simpleString()}, {', '.join(f'`{c}` double' for c in names)}, pi double"
    decided, n = [], current.count()
    for level in range(64):
        groups = max(1, -(-n // group_rows))
        dealt = current.withColumn("g", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed + level)), F.lit(groups)))
        flown = work.save(dealt.groupBy("g").applyInPandas(_flier(names, seed, level, groups == 1, keep_size), schema), "cube", work_dir)
        decided.append(flown.where("pi = 0 or pi = 1").select(F.col("id").alias(id_col), F.col("pi").cast("int").alias("is_test")))
        if groups == 1:
            break
        current = flown.where("pi > 0 and pi < 1")
        n = current.count()
        if not n:
            break
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def cube_split(df: DataFrame, columns: Sequence[str], id_col: str, share: float, **options) -> DataFrame:
    """``df`` with ``is_test`` from :func:`cube_sample`, joined back by the id."""
    return df.join(cube_sample(df, columns, id_col, share, **options), id_col)
