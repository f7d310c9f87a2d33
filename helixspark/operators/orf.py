"""Open reading frames on both strands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ascii import as_bytes, ascii_upper
from ..functions.sequence import codons, sums_before, translate_codons

STOP = "(?:TAA|TAG|TGA)"
#: Codons up to and with the next stop, from where the last piece ended.
PIECE = rf"\G(?:(?!{STOP})[ACGTN]{{3}})*+{STOP}"
#: From a piece's first start codon on.
FRAME = r"^(?:(?!ATG)[ACGTN]{3})*+(ATG.*)$"


def find_orfs(sequences: DataFrame, min_length: int = 30, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """``seq_id, start, end, length, strand, frame, start_codon, stop_codon, protein``.

    U counts as T, and what is not A, C, G, T or N is deleted first; positions
    are those of what remains, on the plus strand. A frame is cut after each stop
    codon; a piece's first ATG, if it has one, opens its reading frame. So rows
    are pieces, not codons, and only reading frames are translated.
    ``min_length`` of 0 or less means 30; lengths include the stop.
    """
    least = min_length if min_length > 0 else 30
    rows = sequences.select(F.col(id_col).alias("seq_id"), F.regexp_replace(F.translate(ascii_upper(as_bytes(F.col(seq_col))), "U", "T"), "[^ACGTN]", "").alias("fwd"))
    rows = rows.withColumn("n", F.length("fwd").cast("long"))
    turned = F.reverse(F.translate("fwd", "ACGT", "TGCA"))
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("fwd").alias("s")), F.struct(F.lit("-").alias("strand"), turned.alias("s")))
    rows = rows.select("seq_id", "n", F.explode(strands).alias("x")).select("seq_id", "n", "x.*")
    frames = F.array(*[F.struct(F.lit(f).alias("frame"), F.regexp_extract_all(F.substring("s", f + 1, 2147483647), F.lit(PIECE), F.lit(0)).alias("pieces")) for f in range(3)])
    rows = rows.select("seq_id", "n", "strand", F.explode(frames).alias("x")).select("seq_id", "n", "strand", "x.*")
    before = sums_before(F.transform("pieces", lambda x: F.length(x)))
    rows = rows.withColumn("before", before).select("seq_id", "n", "strand", "frame", F.explode(F.arrays_zip("pieces", "before")).alias("x"))
    rows = rows.select("seq_id", "n", "strand", "frame", "x.before", F.length("x.pieces").alias("size"), F.regexp_extract("x.pieces", FRAME, 1).alias("orf"))
    rows = rows.withColumn("length", F.length("orf").cast("long")).where(F.col("length") >= least)
    rows = rows.withColumn("at", F.col("frame") + F.col("before") + F.col("size") - F.col("length"))
    start = F.when(F.col("strand") == "+", F.col("at")).otherwise(F.col("n") - F.col("at") - F.col("length")).cast("long")
    protein = translate_codons(codons(F.substr("orf", F.lit(1), F.length("orf") - 3)))
    return rows.select("seq_id", start.alias("start"), (start + F.col("length")).alias("end"), "length", "strand", "frame", F.lit("ATG").alias("start_codon"), F.right("orf", F.lit(3)).alias("stop_codon"), protein.alias("protein"))


def orfs_in_order(orfs: DataFrame) -> DataFrame:
    """``orfs`` with ``ordinal`` in each sequence: longest first, then plus before minus, frame, place on the strand."""
    place = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("end"))
    order = Window.partitionBy("seq_id").orderBy(F.desc("length"), F.col("strand") == "-", "frame", place)
    return orfs.withColumn("ordinal", F.row_number().over(order))
