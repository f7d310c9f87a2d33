"""Summaries of record tables of the genomics formats, and the variant filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import gc_content, percent
from ..sources import binary, text


def _ratio(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def fasta_stats(records: DataFrame) -> DataFrame:
    """``ordinal, id, description, length, gc`` of FASTA records."""
    return records.select("ordinal", "id", "description", F.octet_length("seq").cast("long").alias("length"), gc_content(F.col("seq")).alias("gc"))


def read_fasta_stats(spark: SparkSession, path: str) -> DataFrame:
    return fasta_stats(text.read_fasta(spark, path)).orderBy("ordinal")


def fastq_stats(reads: DataFrame) -> DataFrame:
    """One row over reads ``seq, qual`` (Phred+33). Qualities are shared over all bases; GC over A, C, G, T."""
    scores = F.transform(F.split("qual", ""), lambda c: F.when(c != "", F.ascii(c) - 33))
    gc = F.regexp_count("seq", F.lit("[GCgc]"))
    per = reads.select(
        F.length("seq").alias("n"),
        F.aggregate(F.filter(scores, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x).alias("q"),
        F.regexp_count("qual", F.lit(r"[\x35-\x7E]")).alias("q20"),
        F.regexp_count("qual", F.lit(r"[\x3F-\x7E]")).alias("q30"),
        gc.alias("gc"),
        (gc + F.regexp_count("seq", F.lit("[ATat]"))).alias("acgt"),
    )
    t = per.agg(F.count(F.lit(1)).alias("reads"), *[_sum(F.col(c)).alias(c) for c in per.columns])
    return t.select(F.col("reads").alias("read_count"), F.col("n").alias("total_bases"), _ratio(F.col("q").cast("double"), F.col("n")).alias("avg_quality"), percent(F.col("q20"), F.col("n")).alias("q20_percent"), percent(F.col("q30"), F.col("n")).alias("q30_percent"), percent(F.col("gc"), F.col("acgt")).alias("gc_percent"))


def read_fastq_stats(spark: SparkSession, path: str) -> DataFrame:
    return fastq_stats(binary.read_files(spark, "fastq", path))


def bam_stats(reads: DataFrame) -> DataFrame:
    """One row over alignments ``flag, mapq, seq``; mapping quality is summed over all reads and shared over the mapped."""

    def flagged(bit: int) -> Column:
        return F.count_if(F.col("flag").bitwiseAND(F.lit(bit)) != 0)

    gc = F.regexp_count("seq", F.lit("[GCgc]"))
    t = reads.agg(
        F.count(F.lit(1)).alias("read_count"),
        flagged(4).alias("unmapped_count"),
        flagged(1).alias("paired_count"),
        flagged(2).alias("proper_pair_count"),
        flagged(1024).alias("duplicate_count"),
        _sum(F.length("seq")).alias("total_bases"),
        _sum(F.col("mapq")).alias("_mapq"),
        _sum(gc).alias("_gc"),
        _sum(gc + F.regexp_count("seq", F.lit("[ATat]"))).alias("_acgt"),
    )
    mapped = F.col("read_count") - F.col("unmapped_count")
    return t.select("read_count", mapped.alias("mapped_count"), "unmapped_count", "paired_count", "proper_pair_count", "duplicate_count", "total_bases", _ratio(F.col("_mapq").cast("double"), mapped).alias("avg_mapq"), _ratio(F.col("total_bases").cast("double"), F.col("read_count")).alias("avg_length"), percent(F.col("_gc"), F.col("_acgt")).alias("gc_percent"))


def read_bam_stats(spark: SparkSession, path: str) -> DataFrame:
    return bam_stats(binary.read_files(spark, "bam", path))


def variant_stats(variants: DataFrame, samples: DataFrame) -> DataFrame:
    """One row over variants; ``samples`` is one row ``sample_count``. No ALT at all counts as SNP, unlike lengths as indel."""
    snp = (F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1)
    passed = (F.size("filters") == 1) & (F.get("filters", F.lit(0)) == "PASS")
    t = variants.agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.count_if(snp).alias("snp_count"),
        F.count_if(~snp).alias("indel_count"),
        F.count_if(F.size("alts") > 1).alias("multi_allelic_count"),
        F.count_if(passed).alias("pass_count"),
        F.coalesce(F.avg("qual"), F.lit(0.0)).alias("avg_qual"),
        F.countDistinct("chrom").alias("chromosome_count"),
    )
    return t.crossJoin(F.broadcast(samples))  # one row each


def vcf_stats(lines: DataFrame) -> DataFrame:
    return variant_stats(text.parse_vcf(lines), text.vcf_samples(lines))


def read_vcf_stats(spark: SparkSession, path: str) -> DataFrame:
    return vcf_stats(text.read_lines(spark, path))


def bcf_stats(records: DataFrame) -> DataFrame:
    return variant_stats(records.where("chrom is not null"), records.agg(F.coalesce(F.max("sample_count"), F.lit(0)).alias("sample_count")))


def read_bcf_stats(spark: SparkSession, path: str) -> DataFrame:
    return bcf_stats(binary.read_files(spark, "bcf", path))


def gff_stats(features: DataFrame) -> DataFrame:
    """One row over features. A span counts only where the end is beyond the start."""
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    return features.agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.countDistinct("source").alias("source_count"),
        F.countDistinct("seqid").alias("chromosome_count"),
        F.count_if(plus).alias("strand_plus"),
        F.count_if(minus).alias("strand_minus"),
        F.count_if(~F.coalesce(plus | minus, F.lit(False))).alias("strand_none"),
        _sum(F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start") + 1)).alias("total_span"),
    )


def gff_types(features: DataFrame) -> DataFrame:
    """``type, count``; by count, then type, when collected in order."""
    return features.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type")


def read_gff_stats(spark: SparkSession, path: str) -> DataFrame:
    features = text.parse_gff(text.read_lines(spark, path))
    kinds = features.groupBy("type").agg(F.count(F.lit(1)).alias("count")).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "type"))).alias("k"))
    kinds = kinds.select(F.transform("k", lambda x: F.struct(x["type"].alias("feature_type"), (-x["n"]).alias("count"))).alias("feature_types"))
    return gff_stats(features).crossJoin(F.broadcast(kinds))  # one row each


def bed_length() -> Column:
    return F.greatest(F.col("end") - F.col("start"), F.lit(0).cast("long"))


def bed_stats(features: DataFrame) -> DataFrame:
    rows = features.withColumn("len", bed_length())
    return rows.agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.countDistinct("chrom").alias("chromosome_count"),
        _sum(F.col("len")).alias("total_span"),
        F.coalesce(F.min("len"), F.lit(0)).cast("long").alias("min_length"),
        F.coalesce(F.max("len"), F.lit(0)).cast("long").alias("max_length"),
        F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_length"),
    )


def bed_chroms(features: DataFrame) -> DataFrame:
    """``chrom, count, span``; by count, then name, when collected in order."""
    rows = features.withColumn("len", bed_length())
    return rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("count"), _sum(F.col("len")).alias("span")).orderBy(F.desc("count"), "chrom")


def read_bed_stats(spark: SparkSession, path: str) -> DataFrame:
    features = text.parse_bed(text.read_lines(spark, path))
    chroms = features.withColumn("len", bed_length()).groupBy("chrom").agg(F.count(F.lit(1)).alias("count"), _sum(F.col("len")).alias("span"))
    chroms = chroms.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "chrom", "span"))).alias("k"))
    chroms = chroms.select(F.transform("k", lambda x: F.struct(x["chrom"].alias("chrom"), (-x["n"]).alias("count"), x["span"].alias("span"))).alias("chromosomes"))
    return bed_stats(features).crossJoin(F.broadcast(chroms))  # one row each


def filter_variants(variants: DataFrame, min_quality: float = math.nan, pass_only: bool = False, chromosome: str = "", region_start: int = 0, region_end: int = 0, max_variants: int = 0) -> tuple[DataFrame, DataFrame]:
    """Matching variants (with ``ordinal``), and one row ``total_count, filtered_count``.

    Only conditions that are set become part of the plan. A missing quality
    counts as 0. With a limit, ``total_count`` is the records up to the last one kept.
    """
    rows = variants
    if chromosome:
        rows = rows.where(F.col("chrom") == chromosome)
    if region_start > 0 and region_end > 0:
        rows = rows.where(F.col("pos").between(region_start, region_end))
    if not math.isnan(min_quality):
        rows = rows.where(F.coalesce("qual", F.lit(0.0)) >= min_quality)
    if pass_only:
        rows = rows.where((F.size("filters") == 1) & (F.get("filters", F.lit(0)) == "PASS"))
    shown = rows.select("ordinal", "chrom", "pos", F.array_join("ids", ";").alias("id"), "ref", F.array_join("alts", ",").alias("alt"), F.coalesce("qual", F.lit(0.0)).alias("qual"), F.array_join("filters", ";").alias("filter"), "info")
    every = variants.agg(F.count(F.lit(1)).alias("n"))
    if max_variants > 0:
        shown = shown.orderBy("ordinal").limit(max_variants)
    kept = shown.agg(F.count(F.lit(1)).alias("filtered_count"), F.max("ordinal").alias("last"))
    total = F.col("n") if max_variants <= 0 else F.when(F.col("filtered_count") >= max_variants, F.col("last") + 1).otherwise(F.col("n"))
    return shown, kept.crossJoin(F.broadcast(every)).select(total.cast("long").alias("total_count"), "filtered_count")  # one row each


def filter_vcf(spark: SparkSession, path: str, **conditions) -> tuple[DataFrame, DataFrame]:
    lines = text._in_order(text.read_lines(spark, path).where((~F.startswith("value", F.lit("#"))) & (F.trim("value") != "")))
    return filter_variants(text.parse_vcf(lines), **conditions)
