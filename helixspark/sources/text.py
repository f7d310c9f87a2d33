"""Text formats of genomics: FASTA, VCF, GFF and BED, as DataFrames of records.

Parsers take lines (column ``value``), so they serve files and derived lines
alike. Where the order of records matters, ``ordinal`` carries it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of a file."""
    return spark.read.text(path)


def _in_order(df: DataFrame) -> DataFrame:
    """``df`` with ``ordinal``: its rows' order over the files' splits, which Spark numbers in order.

    Two narrow passes, as for zipWithIndex: rows of each split, then an offset per split.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    split, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(split.alias("_split")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = sizes.select("_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = marked.withColumn("_split", split).join(offsets, "_split")
    return joined.withColumn("ordinal", F.col("_before") + place).drop("_split", "_before", "_id")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, id, description, seq``. Records are split at a ``>`` that begins a line."""
    return parse_fasta(_in_order(spark.read.option("lineSep", "\n>").text(path)))


def parse_fasta(records: DataFrame) -> DataFrame:
    """The same from rows ``ordinal, value`` that hold a record each."""
    body = F.regexp_replace("value", r"^>", "")
    head = F.rtrim(F.regexp_replace(F.substring_index(body, "\n", 1), "\r", ""))
    seq = F.when(F.contains(body, F.lit("\n")), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n", ""), r"\s", "")).otherwise(F.lit(""))
    rows = records.where(F.trim(body) != "").select("ordinal", head.alias("head"), seq.alias("seq"))
    return rows.select("ordinal", F.regexp_extract("head", r"^(\S*)", 1).alias("id"), F.regexp_extract("head", r"^\S*\s+(.*)$", 1).alias("description"), "seq")


def parse_vcf(lines: DataFrame) -> DataFrame:
    """``chrom, pos, ids, ref, alts, qual, filters, info`` of each record line (and ``ordinal`` if given); missing values are empty or null."""
    own = [c for c in ("ordinal",) if c in lines.columns]
    f = F.split("value", "\t")
    rows = lines.where((~F.startswith("value", F.lit("#"))) & (F.trim("value") != "")).select(*own, f.alias("f"))

    def parts(k: int, sep: str) -> Column:
        x = F.get("f", F.lit(k))
        return F.when(x == ".", F.array().cast("array<string>")).otherwise(F.split(x, sep))

    qual = F.get("f", F.lit(5))
    return rows.select(
        *own,
        F.get("f", F.lit(0)).alias("chrom"),
        F.get("f", F.lit(1)).cast("long").alias("pos"),
        parts(2, ";").alias("ids"),
        F.get("f", F.lit(3)).alias("ref"),
        parts(4, ",").alias("alts"),
        F.when(qual != ".", qual.cast("float").cast("double")).alias("qual"),
        parts(6, ";").alias("filters"),
        F.when(F.get("f", F.lit(7)) == ".", F.lit("")).otherwise(F.get("f", F.lit(7))).alias("info"),
    )


def vcf_samples(lines: DataFrame) -> DataFrame:
    """One row ``sample_count``, from the header line."""
    n = F.greatest(F.size(F.split("value", "\t")) - 9, F.lit(0)).cast("long")
    return lines.where(F.startswith("value", F.lit("#CHROM"))).agg(F.coalesce(F.max(n), F.lit(0)).alias("sample_count"))


def parse_gff(lines: DataFrame) -> DataFrame:
    """``seqid, source, type, start, end, strand`` of the feature lines."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.where((~F.startswith("value", F.lit("#"))) & (F.trim("value") != "")).select(f.alias("f"))
    names = {"seqid": 0, "source": 1, "type": 2, "start": 3, "end": 4, "strand": 6}
    return rows.select(*[(F.get("f", F.lit(k)).cast("long") if n in ("start", "end") else F.get("f", F.lit(k))).alias(n) for n, k in names.items()])


def parse_bed(lines: DataFrame) -> DataFrame:
    """``chrom, start, end``: lines of three fields or more that are no comment, track or browser line.

    Only plain digits, with a plus or not, are numbers; all else is 0.
    """
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    f = F.split(line, "\t")
    rows = lines.where((line != "") & ~line.rlike("^(#|track|browser)")).select(f.alias("f")).where(F.size("f") >= 3)

    def number(k: int) -> Column:
        x = F.get("f", F.lit(k))
        return F.when(x.rlike(r"^\+?[0-9]+$"), F.coalesce(x.try_cast("decimal(38,0)").try_cast("long"), F.lit(0))).otherwise(F.lit(0).cast("long"))

    return rows.select(F.get("f", F.lit(0)).alias("chrom"), number(1).alias("start"), number(2).alias("end"))
