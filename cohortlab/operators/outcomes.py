"""What became of offers: alignment with a ranking, response funnel, score deciles, months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.sources import work

from .ranking import sorted_products

FLAGS = ("activated", "actioned", "interested")
#: The response states that count for each flag, each flag's states being among the one before's.
STATES = {"activated": ("ACTIVATED", "ACTIONED", "INTERESTED"), "actioned": ("ACTIONED", "INTERESTED"), "interested": ("INTERESTED",)}


def proposed_ranks(priority: DataFrame, proposed: DataFrame, products: Sequence[str], id_col: str = "customer_id", product_col: str = "proposed_product", unranked: str = "zero") -> DataFrame:
    """Proposed offers with the place of their product in the customer's ranking; a product that is not ranked has
    ``rank`` 0 (``zero``) or null (``null``)."""
    order = sorted_products(priority.select(id_col, *products), products, "ranked_products", id_col, None)
    out = proposed.join(order.select(id_col, "ranked_products"), id_col)
    place = F.coalesce(F.array_position("ranked_products", F.col(product_col)), F.lit(0))
    return out.select(*proposed.columns, (F.nullif(place, F.lit(0)) if unranked == "null" else place).cast("int").alias("rank"))


def priority_alignment(ranks: DataFrame, tops: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """One row: offers, and the share whose product is among the first 1, 3, 5, 10. With unranked products as 0 they
    count as hits; ``n_unranked`` tells how many there are."""
    rank = F.col("rank")
    shares = [F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"pct_top{k}") for k in tops]
    return ranks.agg(F.count(F.lit(1)).alias("n_offers"), F.count_if(F.coalesce(rank, F.lit(0)) == 0).alias("n_unranked"), *shares)


def rank_distribution(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n_offers"))


def with_flags(df: DataFrame, state_col: str = "response_state") -> DataFrame:
    """Add the flags that are missing, from the state in any case; a null state is 0."""
    state = F.upper(F.col(state_col)) if state_col in df.columns else F.lit(None).cast("string")
    return df.withColumns({f: F.coalesce(state.isin(*STATES[f]), F.lit(False)).cast("int") for f in FLAGS if f not in df.columns})


def _rates() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in FLAGS]]


def funnel_by(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Rows and the three rates, over all or by columns."""
    return with_flags(df).groupBy(*columns).agg(*_rates())


def funnel_by_group(df: DataFrame, groups: DataFrame | None, group_col: str, id_col: str = "customer_id") -> DataFrame | None:
    """Rates by a customer grouping; customers without a group are the null group. None without groups."""
    if groups is None:
        return None
    return funnel_by(df.join(groups.select(id_col, group_col), id_col, "left"), [group_col])


def score_deciles(df: DataFrame, score: str, out: str, tie: Sequence[str], partition: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Ten groups as equal as can be, 1 the highest scores, null last, ``tie`` deciding between equals.

    Rows are dealt to ranges of (score, tie), so that no frequent score lands in one task as long as ties are told apart,
    and written so. Each range starts after the rows of the ranges above it (grouped counts, a number a range), and rows
    are ranked inside their range."""
    by = list(partition)
    order = [F.col(score).desc_nulls_last(), *tie]
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = work.save(df.repartitionByRange(n, *by, *order).withColumn("__p", F.spark_partition_id()), "deciles")
    counts = ranged.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__k"))
    whole = Window.partitionBy(*by)
    starts = counts.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__p").alias("__q"), (F.sum("__k").over(whole.orderBy("__p")) - F.col("__k")).alias("__above"), F.sum("__k").over(whole).alias("__n"))
    on = ranged["__p"] == starts["__q"]
    for c in by:
        on = on & ranged[c].eqNullSafe(starts[f"__b_{c}"])
    place = F.row_number().over(Window.partitionBy("__p", *by).orderBy(*order)) + F.col("__above") - 1
    joined = ranged.join(F.broadcast(starts) if not by else starts, on)
    # the first n mod 10 groups have one row more
    small, large = F.floor(F.col("__n") / 10), F.col("__n") % 10
    head = large * (small + 1)
    tile = F.when(F.col("__r") < head, F.floor(F.col("__r") / (small + 1))).otherwise(large + F.floor(F.try_divide(F.col("__r") - head, small)))
    return joined.withColumn("__r", place).withColumn(out, (tile + 1).cast("int")).select(*df.columns, out)


def decile_distribution(df: DataFrame, decile: str, product: str = "product") -> DataFrame:
    return df.groupBy(product, F.col(decile).alias("decile")).agg(F.count(F.lit(1)).alias("n"))


def decile_transition(df: DataFrame, a: str = "legacy_decile", b: str = "new_decile") -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def month_rates(df: DataFrame, months: Sequence) -> DataFrame:
    """Rates by month and product, for the given months."""
    return funnel_by(df.where(F.col("month").isin(*months)), ["month", "product"])


def common_customers(df: DataFrame, a, b, id_col: str = "customer_id") -> DataFrame:
    """Customers with offers in both months."""
    return df.where(F.col("month") == a).select(id_col).intersect(df.where(F.col("month") == b).select(id_col))


def common_customer_rates(df: DataFrame, a, b, id_col: str = "customer_id") -> DataFrame:
    """Rates by month and product over all months, of customers with offers in both given ones."""
    return funnel_by(df.join(common_customers(df, a, b, id_col), id_col, "left_semi"), ["month", "product"])
