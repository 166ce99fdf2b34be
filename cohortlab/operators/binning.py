"""Profiles, clipping and bins of customer features.

Cut points come from one job for all columns and bin counts: quantiles of every probability that any bin count needs,
null and NaN left out. Bins are CASE expressions over literal cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalar import NULL_LABEL


def exact_percentiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], most: int = 1_000_000) -> dict[str, list[float] | None]:
    """Exact interpolated percentiles of columns, None for one without values. No task gathers more than ``most`` values:
    columns with more are narrowed by approximate quantiles around each rank until that few are left."""
    counts = df.agg(*[F.count(c).alias(c) for c in wanted]).first().asDict()
    small = [c for c in wanted if 0 < counts[c] <= most]
    found = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(float(p)) for p in wanted[c]])).alias(c) for c in small]).first().asDict() if small else {}
    out: dict[str, list[float] | None] = {}
    for c, probs in wanted.items():
        if c in found or not counts[c]:
            out[c] = found.get(c)
            continue
        values = df.select(F.col(c).cast("double").alias("v")).where("v is not null")
        places = [(counts[c] - 1) * p for p in probs]
        at = {k: _at_rank(values, k, counts[c], most) for k in sorted({f(x) for x in places for f in (floor, ceil)})}
        out[c] = [at[int(x)] if x == int(x) else (ceil(x) - x) * at[floor(x)] + (x - floor(x)) * at[ceil(x)] for x in places]
    return out


def _at_rank(values: DataFrame, rank: int, n: int, most: int) -> float:
    """The value with ``rank`` others before it in ascending order."""
    inside, below, size, slack = values, 0, n, 1e-3
    while size > most:
        q = (rank - below) / size
        low, high = inside.agg(F.percentile_approx("v", [max(0.0, q - slack), min(1.0, q + slack)], 100_000).alias("e")).first()["e"]
        v, place = F.col("v"), rank - below
        k = inside.agg(F.count_if(v < low).alias("lt_low"), F.count_if(v <= low).alias("le_low"), F.count_if(v < high).alias("lt_high"), F.count_if(v <= high).alias("le_high")).first()
        if k["lt_low"] <= place < k["le_low"]:
            return low
        if k["lt_high"] <= place < k["le_high"]:
            return high
        if k["le_low"] <= place < k["lt_high"]:  # both edges go, so that a frequent value is met once
            inside, size, below = inside.where((v > low) & (v < high)), k["lt_high"] - k["le_low"], below + k["le_low"]
        else:
            slack *= 4
    return inside.agg(F.percentile("v", (rank - below) / max(size - 1, 1)).alias("x")).first()["x"]


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: count, null share (null on an empty table), mean, stddev, min, exact quartiles, max."""
    q = exact_percentiles(df, {c: (0.25, 0.5, 0.75) for c in columns})
    parts = {c: F.struct(F.count(c).alias("n"), F.try_divide(F.count_if(F.col(c).isNull()).cast("double"), F.count(F.lit(1))).alias("null_share"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("stddev"), F.min(F.col(c).cast("double")).alias("min"), *[F.lit(x).cast("double").alias(p) for p, x in zip(("p25", "p50", "p75"), q[c] or (None,) * 3, strict=True)], F.max(F.col(c).cast("double")).alias("max")) for c in columns}
    wide = df.agg(*[s.alias(c) for c, s in parts.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    return wide.select(F.inline(rows)).select("column", "s.*")


def clip(c: str, low: float | None, high: float | None) -> Column:
    """Within [low, high]; null stays null, an absent bound bounds nothing."""
    v = F.col(c)
    v = F.least(v, F.lit(high)) if high is not None else v
    v = F.greatest(v, F.lit(low)) if low is not None else v
    return F.when(F.col(c).isNotNull(), v)


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], rel_err: float = 0.001) -> dict[str, list[float]]:
    """The value of rank ceil(p * n) for every wanted p of columns, in one job; none for a column without values, null and
    NaN left out. With ``rel_err`` 0 ranks are exact: p is the decimal number that it prints as and the product no float,
    which could fall beside a whole rank; that takes a job to count the values."""
    if rel_err:
        at = {(c, p): p for c, probs in wanted.items() for p in probs}
    else:
        n = df.agg(*[F.count(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in wanted]).first().asDict()
        at = {(c, p): (max(1, ceil(Decimal(repr(float(p))) * n[c])) - 0.5) / n[c] for c, probs in wanted.items() if n[c] for p in probs}
    asked = sorted(set(at.values()))
    found = dict(zip(wanted, df.approxQuantile(list(wanted), asked, rel_err), strict=True)) if asked else {}
    return {c: [found[c][asked.index(at[c, p])] for p in probs] if found.get(c) else [] for c, probs in wanted.items()}


def winsorise(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, rel_err: float = 0.001) -> DataFrame:
    """Clip columns to their approximate quantiles, found in one job; a column without values stays as it is."""
    found = quantiles(df, {c: (low, high) for c in columns}, rel_err)
    return df.withColumns({c: clip(c, *q) for c, q in found.items() if q})


def clip_exact(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> tuple[DataFrame, float | None, float | None]:
    """Clip a column to its exact, interpolated quantiles; returns the frame and both bounds."""
    lo, hi = exact_percentiles(df, {column: (low, high)})[column] or (None, None)
    return df.withColumn(column, clip(column, lo, hi)), lo, hi


def preprocess(df: DataFrame, categorical: Sequence[str] = (), discrete: Sequence[str] = (), continuous: Sequence[str] = (), rel_err: float = 0.001) -> DataFrame:
    """Categorical and discrete columns get a text twin ``<c>_cat`` with null as ``UNKNOWN`` (the numbers stay usable);
    continuous ones are winsorised at 1 and 99 per cent."""
    df = df.withColumns({f"{c}_cat": F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in [*categorical, *discrete]})
    return winsorise(df, continuous, rel_err=rel_err) if continuous else df


def flag_label(c: str = "visa_ind", mode: str = "3way") -> Column:
    """A 0/1/null flag as text: three values, or null together with 0."""
    if mode == "3way":
        return F.when(F.col(c).isNull(), NULL_LABEL).when(F.col(c) == 1, "1").otherwise("0")
    return F.when(F.col(c) == 1, "1").otherwise("0_or_null")


def quantile_cuts(df: DataFrame, bins: Mapping[str, Sequence[int]], rel_err: float = 0.001) -> dict[tuple[str, int], list[float]]:
    """Distinct cut points of every (column, number of bins), in one job."""
    probs = {c: sorted({i / n for n in counts for i in range(1, n)}) for c, counts in bins.items()}
    found = {c: dict(zip(probs[c], q, strict=False)) for c, q in quantiles(df, probs, rel_err).items()}
    return {(c, n): sorted({found[c][i / n] for i in range(1, n)} if found[c] else set()) for c, counts in bins.items() for n in counts}


def interval_label(c: str, cuts: Sequence[float], null_label: str = NULL_LABEL, prefix: str = "") -> Column:
    """Right-closed intervals as text: ``(-inf,a]``, ``(a,b]``, ``(z,inf)``; ``(-inf,inf)`` without cuts."""
    out, low = F.when(F.col(c).isNull(), null_label), "-inf"
    for i, cut in enumerate(cuts):
        out = out.when(F.col(c) <= F.lit(cut), f"{prefix.format(i)}({low},{cut}]")
        low = str(cut)
    return out.otherwise(f"{prefix.format(len(cuts))}({low},inf)")


def quantile_bin(df: DataFrame, column: str, out: str, n_bins: int, rel_err: float = 0.001) -> DataFrame:
    """Add the quantile interval of a numeric column; null has a label of its own."""
    cuts = quantile_cuts(df, {column: [n_bins]}, rel_err)[column, n_bins]
    has = df.agg(F.count(column)).first()[0] if not cuts else 1
    return df.withColumn(out, interval_label(column, cuts) if has else F.lit(NULL_LABEL))


def bin_number(c: str, cuts: Sequence[float]) -> Column:
    """Number of the right-closed interval, -1 for null."""
    out = F.when(F.col(c).isNull(), -1)
    for i, cut in enumerate(cuts):
        out = out.when(F.col(c) <= F.lit(cut), i)
    return out.otherwise(len(cuts))


def bucketize(df: DataFrame, column: str, n_bins: int, out: str | None = None, rel_err: float = 0.001) -> DataFrame:
    """Left-closed quantile buckets as a number; null stays null, NaN is a bucket after the last."""
    from pyspark.ml.feature import QuantileDiscretizer

    if column not in df.columns or n_bins < 2:
        raise ValueError("the column must exist and there must be two bins at least")
    model = QuantileDiscretizer(numBuckets=n_bins, inputCol=column, outputCol=out or f"{column}_bin", relativeError=rel_err, handleInvalid="keep").fit(df.where(F.col(column).isNotNull()))
    return model.transform(df)


def rank_bin(df: DataFrame, column: str, n_bins: int, out: str, prefix: str) -> DataFrame:
    """Bins between exact interpolated quantiles, right-closed, the lowest value included: ``prefix:Q1`` and on; equal
    edges are one edge; ``prefix:NULL`` for null."""
    edges = sorted(set(exact_percentiles(df, {column: [i / n_bins for i in range(n_bins + 1)]})[column] or []))
    label = F.when(F.col(column).isNull(), f"{prefix}:NULL")
    for i, edge in enumerate(edges[1:-1], 1):
        label = label.when(F.col(column) <= F.lit(edge), f"{prefix}:Q{i}")
    return df.withColumn(out, label.otherwise(f"{prefix}:Q{max(1, len(edges) - 1)}"))


@dataclass
class Group:
    """Neighbouring bins that form one group."""

    bins: list[int]
    size: int


def merge_small(counts: Mapping[int, int], least: int) -> list[Group]:
    """Join neighbouring bins until every group has ``least`` rows or one is left: the smallest (first of equals) goes
    to its smaller neighbour (the left of equals). The null bin, -1, is a group of its own in front if it is large
    enough, else part of the first. Works on counts, a handful per column."""
    groups = [Group([b], n) for b, n in sorted(counts.items()) if b != -1]
    missing = counts.get(-1, 0)
    if not groups:
        return [Group([-1], missing)]
    while len(groups) > 1 and (small := min(groups, key=lambda g: g.size)).size < least:
        i = groups.index(small)
        sides = [j for j in (i - 1, i + 1) if 0 <= j < len(groups)]
        j = min(sides, key=lambda x: groups[x].size)
        a, b = sorted((i, j))
        groups[a : b + 1] = [Group(groups[a].bins + groups[b].bins, groups[a].size + groups[b].size)]
    if 0 < missing < least:
        groups[0] = Group([-1, *groups[0].bins], groups[0].size + missing)
    elif missing:
        groups.insert(0, Group([-1], missing))
    return groups


#: MLlib looks for thresholds among all rows up to so many, and in a sample of them beyond.
PAIRS = 10_000


def tree_cuts(df: DataFrame, column: str, target: Column, max_bins: int = 6, min_share: float = 0.05) -> list[float]:
    """Supervised cut points: the thresholds of a one-column decision tree against a 0/1 target, fitted on every row.
    Up to ``PAIRS`` distinct (value, target) pairs stand for their rows by weight, so that equal shares give equal cuts
    whatever the number of rows. No signal gives no cuts."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(F.col(column).cast("double").alias("x"), target.cast("double").alias("y")).where("x is not null and y is not null")
    pairs = rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).limit(PAIRS + 1).collect()
    if not pairs:
        return []
    weighted = rows.withColumn("w", F.lit(1.0)) if len(pairs) > PAIRS else df.sparkSession.createDataFrame(sorted(pairs), "x double, y double, w double")
    data = VectorAssembler(inputCols=["x"], outputCol="v").transform(weighted)
    depth = max(1, (max_bins - 1).bit_length())
    model = DecisionTreeClassifier(featuresCol="v", labelCol="y", weightCol="w", maxDepth=depth, maxBins=64, minInstancesPerNode=1, minWeightFractionPerNode=min(min_share, 0.49), seed=1).fit(data)
    nodes, cuts = [model._call_java("rootNode")], []
    while nodes:
        node = nodes.pop(0)
        if node.subtreeDepth() > 0:
            cuts.append((-node.gain(), node.split().threshold()))
            nodes += [node.leftChild(), node.rightChild()]
    return sorted(cut for _, cut in sorted(cuts)[: max_bins - 1])


def cut_label(c: str, cuts: Sequence[float]) -> Column:
    """Numbered intervals ``B0:(-inf,a]`` and on; ``B0:[NON_NULL]`` without cuts."""
    if not cuts:
        return F.when(F.col(c).isNull(), NULL_LABEL).otherwise("B0:[NON_NULL]")
    return interval_label(c, cuts, prefix="B{}:")
