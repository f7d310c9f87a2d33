"""TF-IDF retrieval over tokenised documents."""

from __future__ import annotations

import json
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tokens with their document frequencies that may be broadcast; more are joined by a shuffle.
BROADCAST_TOKENS = 2_000_000


def token_counts(tokens: DataFrame) -> DataFrame:
    """``doc_ord, id, token, tf`` from ``doc_ord, id, tokens``. Rows that repeat an id are entries of their own."""
    return tokens.select("doc_ord", "id", F.explode("tokens").alias("token")).groupBy("doc_ord", "id", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def weight(n: int) -> Column:
    """A token's count in a document times ln(1 + n / (1 + df))."""
    return F.col("tf") * F.log(1 + F.lit(n) / (1 + F.col("df")))


def squared_norms(tf: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """``doc_ord, norm2``; the frequencies come to the counts, which stay where they are, if there are few enough."""
    side = F.broadcast(df) if df.count() <= BROADCAST_TOKENS else df
    return tf.join(side, "token").groupBy("doc_ord").agg(F.sum(weight(n) * weight(n)).alias("norm2"))


class TfidfIndex:
    """An index that is kept under a key, as three persisted tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.key: str | None = None
        self.tf = self.df = self.norms = None
        self.n = 0

    def ensure(self, key: str, tokens: DataFrame) -> int:
        """1 if an index is built from ``doc_ord, id, tokens``; 0 if one is there under this key, whatever its documents."""
        if self.key == key:
            return 0
        self.clear()
        self.n = tokens.count()
        self.tf = token_counts(tokens).persist(StorageLevel.MEMORY_AND_DISK)
        self.df = document_frequencies(self.tf).persist(StorageLevel.MEMORY_AND_DISK)
        self.norms = squared_norms(self.tf, self.df, self.n).persist(StorageLevel.MEMORY_AND_DISK)
        self.key = key
        return 1

    def ensure_json(self, key: str, docs_json: str) -> int:
        """The same from ``[{"id": ..., "tokens": [...]}]``; text that can't be parsed changes nothing."""
        try:
            docs = [(k, str(d["id"]), [str(t) for t in d["tokens"]]) for k, d in enumerate(json.loads(docs_json))]
        except (ValueError, TypeError, KeyError):
            return 0
        return self.ensure(key, self.spark.createDataFrame(docs, "doc_ord long, id string, tokens array<string>"))

    def score(self, query_tokens: list[str], k: int) -> DataFrame:
        """``doc_ord, id, base``: the ``k`` best documents with a score over 0, ties in corpus order.

        Query tokens that no document has count in the query's norm.
        """
        if self.key is None:
            return self.spark.createDataFrame([], "doc_ord long, id string, base double")
        return score_query(self.tf, self.df, self.norms, self.n, query_tokens, k)

    def score_json(self, query_json: str, k: int) -> str:
        try:
            tokens = [str(t) for t in json.loads(query_json)]
        except (ValueError, TypeError):
            return "[]"
        return json.dumps([{"id": r["id"], "base": r["base"]} for r in self.score(tokens, k).collect()])

    def clear(self) -> None:
        for table in (self.norms, self.df, self.tf):
            if table is not None:
                table.unpersist()
        self.key = self.tf = self.df = self.norms = None
        self.n = 0

    def info(self) -> str:
        if self.key is None:
            return json.dumps({"ok": False, "reason": "empty"})
        return json.dumps({"ok": True, "key": self.key, "n": self.n, "dfSize": self.df.count(), "entriesLen": self.n})


def score_query(tf: DataFrame, df: DataFrame, norms: DataFrame, n: int, query_tokens: list[str], k: int) -> DataFrame:
    """The ``k`` best documents; weights are made for the query's tokens only."""
    spark = tf.sparkSession
    counts: dict[str, int] = {}
    for t in query_tokens:
        counts[t] = counts.get(t, 0) + 1
    # At most the query's tokens.
    known = {r["token"]: r["df"] for r in df.join(F.broadcast(spark.createDataFrame([(t,) for t in counts] or [("",)], "token string")), "token", "left_semi").collect()}
    rows = [(t, known.get(t, 0), c * math.log(1 + n / (1 + known.get(t, 0)))) for t, c in counts.items()]
    q2 = sum(w * w for _, _, w in rows)
    query = spark.createDataFrame(rows or [("", 0, 0.0)], "token string, df long, qw double")
    dots = tf.join(F.broadcast(query), "token").groupBy("doc_ord", "id").agg(F.sum(weight(n) * F.col("qw")).alias("dot"))
    base = F.when((F.col("norm2") > 0) & F.lit(q2 > 0), F.col("dot") / F.sqrt(F.col("norm2") * F.lit(q2))).otherwise(F.lit(0.0))
    return dots.join(norms, "doc_ord").select("doc_ord", "id", base.alias("base")).where("base > 0").orderBy(F.desc("base"), "doc_ord").limit(k)
