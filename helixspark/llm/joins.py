"""Joins of many rows with one row for each key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than ``max(LEAST, rows / MOST)`` rows are hot, so there are never more than ``MOST`` of them.
MOST, LEAST = 10_000, 500


def _cutoff(total: int) -> int:
    return max(LEAST, total // MOST)


def join_hot(big: DataFrame, small: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """Inner join on ``key``; ``small`` has one short row per key, with ``size``, its number of rows in ``big``.

    Rows of hot keys meet a broadcast of ``MOST`` rows at most, so they stay
    where they are; all others are joined as Spark likes. ``big`` is read twice
    and should be a cut table.
    """
    cutoff = _cutoff(big.count())
    hot = F.broadcast(small.where(F.col(size) > cutoff))
    keys = small.where(F.col(size) > cutoff).select(*([key] if isinstance(key, str) else key))
    cold = big.join(F.broadcast(keys), key, "left_anti").join(small.where(F.col(size) <= cutoff), key)
    return big.join(hot, key).unionByName(cold)


def join_sliced(big: DataFrame, small: DataFrame, key: str, spread: Column, keys: DataFrame) -> DataFrame:
    """Inner join on ``key``; ``small`` has one row per key, of any length.

    Rows of a hot key are dealt to slices of ``LEAST`` rows or so by the hash of
    ``spread``, and only its row of ``small`` is copied, once for each slice.
    ``keys`` is a cut table with the key of each row of ``big``.
    """
    cutoff = _cutoff(keys.count())
    slices = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > cutoff)
    slices = slices.select(F.col(key).alias("_hot"), F.ceil(F.col("_size") / F.lit(cutoff)).cast("int").alias("_slices"))

    def sliced(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(slices), df[key] == F.col("_hot"), "left").drop("_hot").withColumn("_slices", F.coalesce("_slices", F.lit(1)))

    left = sliced(big).withColumn("_slice", F.pmod(F.xxhash64(spread), F.col("_slices")).cast("int")).drop("_slices")
    right = sliced(small).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return left.join(right, [key, "_slice"]).drop("_slice")
