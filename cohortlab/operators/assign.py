"""Control and test groups that do not depend on how rows are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.scalar import md5_number
from cohortlab.sources import work


def hash_control(id_col: str, stratum_col: str, share: float = 0.10) -> Column:
    """1 for control: a hash of id and stratum under the share. Each customer is decided alone, so the same customer is
    in the same group in batch and stream, on any cluster."""
    return (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(stratum_col)), F.lit(10_000)) < round(share * 10_000)).cast("int")


def md5_control(id_col: str, share: float = 0.10, seed: int = 42) -> Column:
    """The same by a digest that other engines have."""
    return (md5_number(F.concat(F.col(id_col).cast("string"), F.lit(f"__{seed}"))) % 10_000 < round(share * 10_000)).cast("int")


def exact_split(df: DataFrame, stratum_col: str, id_col: str, share: float = 0.10, seed: int = 42, out: str = "group") -> DataFrame:
    """Of each stratum the customers with the lowest digests are ``control``, as many as the share makes, one at least.

    Digests fall into 4096 ranges. Counts per stratum and range say how many controls each range still has to give, so
    rows are ranked within a range of a stratum and never in a whole stratum."""
    keyed = df.withColumn("__h", md5_number(F.concat(F.col(id_col).cast("string"), F.lit(f"__{seed}")))).withColumn("__b", F.shiftright("__h", 20))
    parts = keyed.groupBy(F.col(stratum_col).alias("__s"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    size = F.sum("__n").over(Window.partitionBy("__s"))
    before = F.sum("__n").over(Window.partitionBy("__s").orderBy("__c")) - F.col("__n")
    left = parts.select("__s", "__c", (F.greatest(F.lit(1), F.floor(size * F.lit(share))) - before).alias("__left"))
    rows = keyed.join(left, keyed[stratum_col].eqNullSafe(left["__s"]) & (keyed["__b"] == left["__c"]))
    place = F.row_number().over(Window.partitionBy(stratum_col, "__b").orderBy("__h", id_col))
    return rows.withColumn(out, F.when(place <= F.col("__left"), "control").otherwise("test")).drop("__h", "__b", "__s", "__c", "__left")


def _check(df: DataFrame, columns: Sequence[str], share: float) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {missing[0]}")
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")


def random_split(df: DataFrame, id_col: str, test_share: float = 0.9, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Customers by a seeded hash of the id: 1 for test, 0 for control."""
    _check(df, [id_col], test_share)
    if df.isEmpty():
        raise ValueError("there are no rows")
    return df.withColumn(out, (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1_000_000)) < round(test_share * 1_000_000)).cast("int"))


def stratified_split(df: DataFrame, id_col: str, stratum_col: str, test_share: float = 0.9, seed: int = 42, out: str = "is_test") -> DataFrame:
    """The same share of every stratum, by a hash of stratum and id."""
    _check(df, [id_col, stratum_col], test_share)
    return df.withColumn(out, (F.pmod(F.xxhash64(F.col(stratum_col), F.col(id_col).cast("string"), F.lit(seed)), F.lit(1_000_000)) < round(test_share * 1_000_000)).cast("int"))


def sample_by(df: DataFrame, id_col: str, stratum_col: str, test_share: float = 0.9, seed: int = 42, out: str = "is_test") -> DataFrame:
    """The engine's own stratified draw, the same share of every stratum: 1 for drawn ids, 0 for the others. The draw
    depends on how rows are partitioned, so its ids are written before they are used; null strata are not drawn."""
    _check(df, [id_col, stratum_col], test_share)
    shares = {r[0]: test_share for r in df.where(F.col(stratum_col).isNotNull()).select(stratum_col).distinct().collect()}
    drawn = work.save(df.sampleBy(stratum_col, shares, seed).select(F.col(id_col).alias("__id")).distinct(), "drawn")
    return df.join(drawn.withColumn("__in", F.lit(1)), df[id_col] == drawn["__id"], "left").withColumn(out, F.coalesce("__in", F.lit(0))).drop("__id", "__in")


def two_frames(df: DataFrame, flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """Test and control as frames of their own."""
    return df.where(F.col(flag) == 1).drop(flag), df.where(F.col(flag) == 0).drop(flag)
