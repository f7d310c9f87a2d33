"""Inputs of the registered queries, derived from the driver's tables; SQL of the same derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_BASES = "ACGTAGCTATGCTGACGTCAGATCGT"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, seq``: the letters of a document, mapped to bases."""
    letters = F.regexp_replace(F.translate("text", UPPER, LOWER), "[^a-z]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.translate(letters, LOWER, TO_BASES).alias("seq"))


DNA_SQL = f"SELECT doc_id AS seq_id, translate(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z]', '', 'g'), '{LOWER}', '{TO_BASES}') AS seq FROM documents"


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.translate("text", LOWER, UPPER), "[^A-Z]", "").alias("seq"))


PROTEIN_SQL = f"SELECT doc_id AS seq_id, regexp_replace(translate(text, '{LOWER}', '{UPPER}'), '[^A-Z]', '', 'g') AS seq FROM documents"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_ord, id, tokens``."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("id"), words.alias("tokens"))


TOKEN_SQL = f"SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS tokens FROM documents"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id"), F.col("embedding").alias("vector"), "label")


def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.expr("concat_ws('\\t', concat('chr', l_suppkey % 22 + 1), l_partkey * 10, cast(l_partkey * 10 + l_quantity as bigint))").alias("value"))


BED_SQL = "SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey * 10 AS start, CAST(l_partkey * 10 + l_quantity AS BIGINT) AS stop FROM lineitem"


def gff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    strand = "case l_linenumber % 3 when 1 then '+' when 2 then '-' else '.' end"
    fields = f"concat('chr', l_suppkey % 22 + 1), l_linestatus, l_returnflag, l_partkey * 10 + 1, cast(l_partkey * 10 + l_quantity as bigint), '.', {strand}, '.', concat('ID=', l_orderkey)"
    return table(spark, sf_dir, "lineitem").select(F.expr(f"concat_ws('\\t', {fields})").alias("value"))


GFF_SQL = "SELECT 'chr' || (l_suppkey % 22 + 1) AS seqid, l_linestatus AS source, l_returnflag AS type, l_partkey * 10 + 1 AS start, CAST(l_partkey * 10 + l_quantity AS BIGINT) AS stop, CASE l_linenumber % 3 WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE '.' END AS strand FROM lineitem"

_REFS, _ALTS = ("A", "C", "GT", "T", "G"), ("G", "T", "A,C", "CA", ".", "*")


def _choice(expr: str, values: tuple[str, ...]) -> str:
    return f"CASE {expr} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: Fields of a variant line, in SQL that both engines read.
_VCF = {
    "chrom": "concat('chr', o_custkey % 22 + 1)",
    "pos": "o_orderkey + 1",
    "id": "CASE WHEN o_orderkey % 3 = 0 THEN concat('rs', o_orderkey) ELSE '.' END",
    "ref": _choice("o_orderkey", _REFS),
    "alt": _choice("o_orderkey", _ALTS),
    "qual": "CASE WHEN o_orderkey % 7 = 0 THEN '.' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) END",
    "filter": "CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'q10' ELSE '.' END",
    "info": "concat('DP=', o_custkey)",
}
VCF_SQL = "SELECT o_orderkey, " + ", ".join(f"{v} AS {k}" for k, v in _VCF.items()) + " FROM orders"


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ordinal`` (the order key) and ``value``; two sample columns, header lines at the front."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.expr("concat_ws('\\t', {}, 'GT', '0/1', '1/1')".format(", ".join(v.replace("VARCHAR(20)", "STRING") for v in _VCF.values()))).alias("value"))
    columns = "CHROM POS ID REF ALT QUAL FILTER INFO FORMAT S1 S2".split()
    head = spark.createDataFrame([(-2, "##fileformat=VCFv4.3"), (-1, "#" + "\t".join(columns))], "ordinal long, value string")
    return head.unionByName(rows)


def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, qual``: the printable characters of a turn are qualities, its bases repeat to that length."""
    t = table(spark, sf_dir, "conversations")
    qual = F.regexp_replace("text", "[^!-~]", "")
    bases = F.translate(F.regexp_replace(F.translate("text", UPPER, LOWER), "[^a-z]", ""), LOWER, TO_BASES)
    return t.select(qual.alias("qual"), F.rpad(bases, F.length(qual), F.lit("N")).alias("seq"))


FASTQ_SQL = f"SELECT qual, rpad(translate(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z]', '', 'g'), '{LOWER}', '{TO_BASES}'), CAST(length(qual) AS INTEGER), 'N') AS seq FROM (SELECT text, regexp_replace(text, '[^!-~]', '', 'g') AS qual FROM conversations)"


def bam_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.translate(F.regexp_replace(F.lower("event_type"), "[^a-z]", ""), LOWER, TO_BASES)
    mapq = F.when(F.col("user_id") % 256 == 255, F.lit(None)).otherwise(F.col("user_id") % 256)
    return table(spark, sf_dir, "events").select((F.col("event_id") % 4096).cast("int").alias("flag"), mapq.cast("int").alias("mapq"), seq.alias("seq"))


BAM_SQL = f"SELECT event_id % 4096 AS flag, CASE WHEN user_id % 256 = 255 THEN NULL ELSE user_id % 256 END AS mapq, translate(regexp_replace(lower(event_type), '[^a-z]', '', 'g'), '{LOWER}', '{TO_BASES}') AS seq FROM events"
