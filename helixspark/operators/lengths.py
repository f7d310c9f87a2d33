"""Length statistics: N50 and the summary of a set of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seq_n50(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    """One row ``n50``: the first length, from the longest, at which the running sum reaches half the total.

    Half is an integer division; no lengths give 0. The running sum goes over
    distinct lengths with their counts, a table bounded by the longest length.
    """
    histogram = lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    longest = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("len") * F.col("n")
    run = histogram.select("len", F.sum(mass).over(longest).alias("run"), F.sum(mass).over(whole).alias("total"))
    return run.where(F.col("run") >= F.expr("total div 2")).agg(F.coalesce(F.max("len"), F.lit(0).cast("long")).alias("n50"))


def summarize_sequences(sequences: DataFrame, length_col: str = "length", gc_col: str = "gc") -> DataFrame:
    """One row: count, total, least, most and mean length, N50 and the plain mean of GC values; zeros without rows."""
    n = F.count(length_col)
    totals = sequences.agg(
        n.alias("count"),
        F.coalesce(F.sum(length_col), F.lit(0)).cast("long").alias("total_length"),
        F.coalesce(F.min(length_col), F.lit(0)).cast("long").alias("min_length"),
        F.coalesce(F.max(length_col), F.lit(0)).cast("long").alias("max_length"),
        F.coalesce(F.avg(length_col), F.lit(0.0)).alias("avg_length"),
        F.when(n > 0, F.coalesce(F.avg(gc_col), F.lit(0.0))).otherwise(F.lit(0.0)).alias("avg_gc"),
    )
    return totals.crossJoin(F.broadcast(seq_n50(sequences, length_col)))  # one row each
