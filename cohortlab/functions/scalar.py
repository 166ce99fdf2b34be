"""Column expressions that several operators share; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_LABEL = "__NULL__"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_pct(x: str | Column) -> Column:
    """A share in per cent, four decimals."""
    return F.round(100 * col(x), 4)


def filled(c: str, fill: float = 0.0) -> Column:
    """A score as double; null and text that is no number become ``fill``."""
    return F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(float(fill)))


def total(columns: Sequence[str], fill: float = 0.0) -> Column:
    """Filled scores, summed from left to right; no columns sum to 0."""
    return reduce(add, [filled(c, fill) for c in columns], F.lit(0.0))


def scored_array(columns: Sequence[str], fill: float = 0.0) -> Column:
    """``array<struct<loss, product>>`` by score descending, then by name as text; ``loss`` is the negated score."""
    items = [F.struct((-filled(c, fill)).alias("loss"), F.lit(c).alias("product")) for c in columns]
    return F.sort_array(F.array(*items)) if items else F.expr("cast(array() as array<struct<loss:double,product:string>>)")


def top_value(scored: str | Column, k: int) -> Column:
    """The sum of the k best scores of a :func:`scored_array`."""
    return F.aggregate(F.slice(col(scored), 1, k), F.lit(0.0), lambda acc, x: acc - x["loss"])


def overlap(a: str, b: str, k: int) -> Column:
    """Common items over k, also where lists are shorter than k."""
    return F.size(F.array_intersect(a, b)) / F.lit(float(k))


def changed(a: str, b: str) -> Column:
    """0 where the lists are equal in order, else 1."""
    return F.when(F.col(a) == F.col(b), 0).otherwise(1)


def _square_sum(items: Column, rank_a, rank_b) -> Column:
    def gap(acc: Column, x: Column) -> Column:
        d = (rank_a(x) - rank_b(x)).cast("double")
        return acc + d * d

    return F.aggregate(items, F.lit(0.0), gap)


def _spearman(items: Column, squares: Column) -> Column:
    m = F.size(items).cast("double")
    return 1 - 6 * squares / (m * (m * m - 1))


def full_spearman(a: str, b: str) -> Column:
    """Rank correlation over the items both lists have, ranks being positions in the whole lists. One item in the first
    list gives 1, fewer than two common items null."""
    both = F.array_intersect(a, b)
    squares = _square_sum(both, lambda x: F.array_position(F.col(a), x), lambda x: F.array_position(F.col(b), x))
    return F.when(F.size(a) == 1, 1.0).when(F.size(both) >= 2, _spearman(both, squares))


def topn_spearman(a: str, b: str) -> Column:
    """Rank correlation over the union of two top lists; an item that a list lacks has the rank after the longer one's
    last. A union of one item gives 1. The closed formula is kept though such ranks are tied, so that disjoint lists of
    one give -1, of two 0, of five 1/3."""
    union = F.array_union(a, b)
    last = F.greatest(F.size(a), F.size(b)) + 1
    rank = lambda side: lambda x: F.coalesce(F.nullif(F.array_position(F.col(side), x), F.lit(0)), last)
    return F.when(F.size(union) == 0, None).when(F.size(union) == 1, 1.0).otherwise(_spearman(union, _square_sum(union, rank(a), rank(b))))


def smd(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column) -> Column:
    """Standardised mean difference; 0 where neither side varies, null where a part is null."""
    scale = F.sqrt((var_a + var_b) / 2)
    return F.when(scale == 0, 0.0).otherwise(F.try_divide(mean_a - mean_b, scale))


def md5_number(text: Column) -> Column:
    """The first 32 bits of a digest as a number: the same in Spark and in other SQL engines."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
