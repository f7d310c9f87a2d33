"""k-mer counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ascii import as_bytes, ascii_upper


def windows(sequence: Column, size: int) -> Column:
    """All overlapping windows of ``size``; one pass over the text, whatever its length."""
    return F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def kmers(sequences: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """``seq_id, kmer``: every upper-case window of ``k`` without N; none for ``k`` of 0 or less."""
    if k <= 0:
        return sequences.select(F.col(id_col).alias("seq_id"), F.lit("").alias("kmer")).where("false")
    rows = sequences.select(F.col(id_col).alias("seq_id"), F.explode(windows(ascii_upper(as_bytes(F.col(seq_col))), k)).alias("kmer"))
    return rows.where(~F.contains("kmer", F.lit("N")))


def kmer_count(sequences: DataFrame, k: int, top_n: int, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """``seq_id, kmer, count``: each sequence's ``top_n`` most frequent k-mers, ties by k-mer."""
    counts = kmers(sequences, k, id_col, seq_col).groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("count"))
    best = Window.partitionBy("seq_id").orderBy(F.desc("count"), "kmer")
    return counts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top_n).drop("_r")


def kmer_corpus(sequences: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """``kmer, count`` over all sequences."""
    return kmers(sequences, k, id_col, seq_col).groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))
