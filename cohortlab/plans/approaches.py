"""From features to validated groups in one call: stratify, assign, validate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from cohortlab.operators import assign, binning, strata, validate


class Outcome(NamedTuple):
    customers: DataFrame
    report: DataFrame
    summary: DataFrame


def _validated(df: DataFrame, stratum: str, id_col: str, share: float, numeric: Sequence[str], max_smd: float, max_diff: float) -> Outcome:
    out = df.withColumn("is_control", assign.hash_control(id_col, stratum, share)).withColumn("visa_label", binning.flag_label())
    report = validate.strata_report(out, stratum, "is_control", numeric, ["visa_label"], max_smd, max_diff).orderBy("pass_all", "n")
    return Outcome(out.drop("visa_label"), report, validate.strata_summary(report))


def by_tree(df: DataFrame, least: int, id_col: str = "cost_ID", share: float = 0.10, numeric: Sequence[str] = strata.NUMERIC, max_smd: float = 0.10, max_diff: float = 0.02, **tree) -> Outcome:
    """Adaptive tree strata."""
    return _validated(strata.tree(df, least, **tree), "stratum_A", id_col, share, numeric, max_smd, max_diff)


def by_coarsening(df: DataFrame, least: int, id_col: str = "cost_ID", share: float = 0.10, numeric: Sequence[str] = strata.NUMERIC, max_smd: float = 0.10, max_diff: float = 0.02, **coarsen) -> Outcome:
    """Crossed bins, coarsened until every stratum is large enough."""
    return _validated(strata.coarsen(df, least, **coarsen)[0], "stratum_B", id_col, share, numeric, max_smd, max_diff)


def balance_checks(df: DataFrame, stratum: str, id_col: str, features: Sequence[str], share: float = 0.10, split: Callable[..., DataFrame] = assign.exact_split) -> tuple[DataFrame, DataFrame]:
    """Exact split of every stratum and the signed SMD of every feature over all."""
    out = split(df, stratum, id_col, share)
    return out, validate.feature_balance(out, features)
