"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import decontaminate, language_id, line_dedup, lm_score, minhash_dedup, mixture, oracle, quality_rules, secret_scan, toxicity, url_filter


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated(5).alias("contaminated"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), digest=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.held_out("doc_id", 5, 0)
    grammar = toxicity.learn_grammar(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~out))
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), grammar, keep={"held_out": out})


#: Production weights of the mixture's tree; sources weigh the same.
MIXTURE = mixture.Mixture(domains={"bulk": 2.0, "web": 5.0, "books": 3.0}, languages={"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, share=0.5, max_epochs=4, seed=7)


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), MIXTURE).drop("text_key")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=0.8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_texts(docs, lm_score.learn(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 4, 2)
    model = language_id.learn(docs.where(~out))
    return language_id.identify(docs, model, keep={"held_out": out})


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # A page shows the document whose number its path holds; that document's quality labels the page.
    shown = pages.select("page_id", F.regexp_extract("url", r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1).try_cast("long").alias("shown"))
    good = labels.select(F.col("doc_id").alias("shown"), F.col("quality").alias("good"))
    return url_filter.url_verdicts(pages, shown.join(good, "shown").select("page_id", "good")).withColumn("purity", F.round("purity", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": oracle.decontamination(),
        "op3_quality_rules": oracle.quality(),
        "op5_mixture": oracle.mixing(MIXTURE),
        "op6_minhash_dedup": oracle.near_duplicates(),
        "op8_line_dedup": oracle.lines(line_dedup.LineRules()),
        "op10_url_filter": oracle.urls(url_filter.Tree()),
    }
