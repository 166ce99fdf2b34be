"""Choosing customers and product columns."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def test_group(df: DataFrame, control_col: str | None = "control") -> DataFrame:
    """Customers that are not in the control group; a null flag is dropped. Without the column nothing is filtered."""
    return df.where(F.col(control_col) == 0) if control_col and control_col in df.columns else df


def by_customers(df: DataFrame, ids: DataFrame | Collection | None, id_col: str = "customer_id") -> DataFrame:
    """Rows of the given customers: a table of ids (semi-join), a collection of ids, or None for all."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(id_col), id_col, "left_semi")
    if isinstance(ids, list | tuple | set | frozenset):
        return df.where(F.col(id_col).isin(*ids))
    raise ValueError("ids must be a DataFrame, a list, tuple or set, or None")


def product_columns(df: DataFrame, id_col: str = "customer_id", control_col: str | None = "control", but: Collection[str] = ()) -> list[str]:
    """All columns that are neither id, control flag nor excluded."""
    other = {id_col, control_col, *but}
    return [c for c in df.columns if c not in other]


def by_products(df: DataFrame, products: Sequence[str] | None, id_col: str = "customer_id", control_col: str | None = "control", extra: Sequence[str] = ()) -> DataFrame:
    """Ids, control flag and those of the products that exist; None keeps all."""
    if products is None:
        return df
    wanted = dict.fromkeys([id_col, *extra, *([control_col] if control_col else []), *products])
    return df.select(*[c for c in wanted if c in df.columns])


def subset(df: DataFrame, ids: DataFrame | Collection | None = None, products: Sequence[str] | None = None, id_col: str = "customer_id", control_col: str | None = "control", extra: Sequence[str] = ()) -> DataFrame:
    """Test group, then customers, then products."""
    return by_products(by_customers(test_group(df, control_col), ids, id_col), products, id_col, control_col, extra)
