"""The corpus pipeline: five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents; the last adds ``mix_epoch``, the epoch in
which the mixture takes the document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import decontaminate, language_id, line_dedup, minhash_dedup, mixture
from helixspark.llm.queries import MIXTURE
from helixspark.session import shared_dir, table
from helixspark.vector.store import Files


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; prototypes come from the labelled ones."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across them; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if {"text", "n_chars"} <= set(out.columns) else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8)."""
    return minhash_dedup.drop_near_duplicates(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=13, percent=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the production mixture, once for each epoch that takes them."""
    return mixture.mixed_documents(docs, MIXTURE)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
]

#: SQL can't express the learned language profiles and the sketches; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            Files(spark).remove(before)
        before = path
    return docs
