"""Scenario reports: two score tables in, named tables out.

A report joins the two rankings once, writes nothing and computes every per-customer metric of every k in one projection,
which is kept in memory while its small summaries are made (``persist``; a lost executor recomputes its part).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import scalar as S
from cohortlab.operators import ranking as R
from cohortlab.operators.subset import product_columns, subset
from cohortlab.sources import sinks

from . import plots

SHEET_ROWS = 5000


@dataclass
class Artifact:
    """A part of a report: a lazy table or, for metadata, records."""

    name: str
    section: str
    table: DataFrame | None = None
    records: list[dict[str, Any]] = field(default_factory=list)
    customer_level: bool = False
    in_sheet: bool = True


@dataclass(frozen=True)
class Scenario:
    name: str
    products: tuple[str, ...] | None = None
    customers: DataFrame | None = None
    ks: tuple[int, ...] = (1, 3, 5)
    id_col: str = "customer_id"
    control_col: str | None = "control"


def presets(products: dict[str, Sequence[str]], customers: DataFrame) -> list[Scenario]:
    """All customers and a chosen set, for each list of products."""
    return [Scenario(f"{who}_{name}", tuple(cols), ids) for who, ids in (("full", None), ("subset", customers)) for name, cols in products.items()]


@dataclass
class Report:
    scenario: Scenario
    artifacts: list[Artifact]
    _held: list[DataFrame] = field(default_factory=list)

    def __getitem__(self, name: str) -> Artifact:
        return next(a for a in self.artifacts if a.name == name)

    def close(self) -> None:
        for df in self._held:
            df.unpersist()

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def build(legacy: DataFrame, new: DataFrame, scenario: Scenario, persist: bool = True) -> Report:
    s = scenario
    legacy, new = (subset(df, s.customers, s.products, s.id_col, s.control_col) for df in (legacy, new))
    products = [c for c in product_columns(legacy, s.id_col, s.control_col) if c in new.columns]
    metrics = R.topk_metrics(R.paired(legacy, new, products, s.id_col, s.control_col), s.ks, s.id_col)
    held = [metrics.persist()] if persist else []
    diff = metrics.select(s.id_col, F.col("ev_legacy").alias("total_ev_legacy"), F.col("ev_new").alias("total_ev_new"), (F.col("ev_new") - F.col("ev_legacy")).alias("total_ev_diff"))
    out = [
        Artifact("metadata", "meta", records=[{"scenario": s.name, "products": len(products), "ks": list(s.ks)}]),
        Artifact("customers", "meta", metrics.agg(F.count(F.lit(1)).alias("n_customers"))),
        Artifact("ev_diff", "ev", diff, customer_level=True, in_sheet=False),
        Artifact("ev_summary", "ev", R.summary(diff, "total_ev_diff")),
        Artifact("full_rank_corr", "rank", metrics.select(s.id_col, "full_spearman"), customer_level=True, in_sheet=False),
        Artifact("full_rank_corr_summary", "rank", R.summary(metrics, "full_spearman")),
    ]
    for k in s.ks:
        gap = (F.col(f"ev_new_{k}") - F.col(f"ev_legacy_{k}")).alias(f"top{k}_ev_diff")
        shift = R.product_shift(legacy, new, k, products, s.id_col, s.control_col)
        pct = (F.col("pct_new") - F.col("pct_legacy")).alias("pct_diff")
        out += [
            Artifact(f"top{k}_ev_diff", "ev", metrics.select(s.id_col, gap), customer_level=True, in_sheet=False),
            Artifact(f"top{k}_ev_summary", "ev", R.summary(metrics.select(gap), f"top{k}_ev_diff")),
            Artifact(f"top{k}_overlap", "rank", metrics.select(s.id_col, f"overlap_{k}"), customer_level=True, in_sheet=False),
            Artifact(f"top{k}_overlap_summary", "rank", R.summary(metrics, f"overlap_{k}")),
            Artifact(f"top{k}_rank_corr", "rank", metrics.select(s.id_col, f"spearman_{k}"), customer_level=True, in_sheet=False),
            Artifact(f"top{k}_rank_corr_summary", "rank", R.summary(metrics, f"spearman_{k}")),
            Artifact(f"top{k}_swap", "rank", metrics.select(s.id_col, f"changed_{k}"), customer_level=True, in_sheet=False),
            Artifact(f"top{k}_swap_summary", "rank", R.swap_summary(metrics, k)),
            Artifact(f"top{k}_overlap_vs_corr", "rank", R.overlap_by_correlation(metrics, k)),
            Artifact(f"top{k}_product_shift", "shift", shift.select("*", pct, F.abs(pct).alias("pct_diff_abs"), (F.col("freq_new") - F.col("freq_legacy")).alias("freq_diff")).orderBy(F.desc("pct_diff_abs"), "product")),
        ]
    return Report(s, out, held)


def to_spreadsheet(report: Report, path: str | Path, one_sheet: bool = True) -> Path:
    """The small tables of a report, below each other by section on one sheet or on a sheet each."""
    tables = [(a.section, a.name, sinks.bounded_pandas(a.table, SHEET_ROWS)) for a in report.artifacts if a.in_sheet and not a.customer_level and a.table is not None]
    tables.sort(key=lambda t: t[0])
    if one_sheet:
        return sinks.write_xlsx(path, [(report.scenario.name, sinks.sheet_rows((n, t) for _, n, t in tables))])
    return sinks.write_xlsx(path, [(n, sinks.sheet_rows([(n, t)])) for _, n, t in tables])


def run(legacy: DataFrame, new: DataFrame, scenario: Scenario, root: str | Path) -> tuple[Report, dict[str, DataFrame], Path]:
    """Report, plot data and spreadsheet of one scenario."""
    report = build(legacy, new, scenario)
    folder = sinks.output_dir(root, scenario.name)
    return report, plots.report_plots(report), to_spreadsheet(report, folder / "report.xlsx")


def fused_summary(legacy: DataFrame, new: DataFrame, ks: Sequence[int] = (1, 3, 5), products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control") -> DataFrame:
    """The report's headline numbers for all k, from one pass over the paired customers: a row per k."""
    metrics = R.topk_metrics(R.paired(subset(legacy, None, products, id_col, control_col), subset(new, None, products, id_col, control_col), products, id_col, control_col), ks, id_col)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"overlap_{k}").alias("overlap"), F.col(f"changed_{k}").alias("changed"), F.col(f"spearman_{k}").alias("corr"), (F.col(f"ev_new_{k}") - F.col(f"ev_legacy_{k}")).alias("gap")) for k in ks])
    out = metrics.select(F.inline(rows)).groupBy("k").agg(F.count(F.lit(1)).alias("n_customers"), F.avg("overlap").alias("avg_overlap"), F.avg(F.col("changed").cast("double")).alias("swap_rate"), F.avg("corr").alias("avg_rank_corr"), F.avg("gap").alias("avg_ev_diff"))
    return out.withColumn("pct_changed", S.to_pct("swap_rate"))
