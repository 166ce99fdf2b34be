"""Helpers shared by the training-data operators.

Anything that cuts lineage or is handed from one job to the next is written below the folder that the cluster names in
``spark.checkpoint.dir``; executors and driver all reach it, so a lost executor costs a retry and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.sources.work import drop, fresh_path, save

__all__ = ["at_most", "by_bytes", "drop", "frame", "fresh_path", "joined_small", "mix64", "save", "sieved", "table", "utf8"]

#: Bits of a sieve, at most (16 MB); a longer list makes it coarser, never wrong.
SIEVE_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(name: str, null: bytes = b""):
    """The column's text as UTF-8 bytes; null becomes ``null``."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(null))


def by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring items with about ``limit`` bytes each; an item over the limit stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def at_most(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def joined_small(left: DataFrame, right: DataFrame, on, how: str, most: int) -> DataFrame:
    """``left`` join ``right``, broadcast if ``right`` is proven to have at most ``most`` rows, shuffled otherwise."""
    return left.join(F.broadcast(right) if at_most(right, most) else right, on, how)


def sieved(df: DataFrame, listed: DataFrame, on: list[str], out: str = "__maybe") -> DataFrame:
    """Add ``out``: false for rows whose ``on`` is certainly not in ``listed``, true for all that are and about one in
    sixteen others. Bits of a hash, sixteen a listed row, are broadcast, so that an exact join need only shuffle the rest."""
    bits = min(SIEVE_BITS, max(1 << 15, 1 << (16 * listed.count()).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    maps = listed.select(bucket.alias("__bucket"), bit.alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    found = df.withColumns({"__bucket": bucket, "__bit": bit}).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__map", F.shiftright("__bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.getbit(byte, F.col("__bit").bitwiseAND(F.lit(7)).cast("int")) == 1
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(hit, F.lit(False)).alias(out))


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows for Spark that keep integers beside nulls; missing fields at the end are null."""
    return pd.DataFrame([(*r, *[None] * (len(names) - len(r))) for r in rows], columns=names, dtype=object)
