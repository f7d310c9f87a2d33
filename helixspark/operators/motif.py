"""Motif search with ambiguity codes, and restriction sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ascii import as_bytes, ascii_upper
from ..functions.sequence import sums_before

# Bases that a code stands for, as bits A=1 C=2 G=4 T=8; others are any base.
MASKS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}

# Recognition sites and cut offsets.
ENZYMES = {
    "EcoRI": ("GAATTC", 1), "BamHI": ("GGATCC", 1), "HindIII": ("AAGCTT", 1), "XhoI": ("CTCGAG", 1), "XbaI": ("TCTAGA", 1),
    "SalI": ("GTCGAC", 1), "PstI": ("CTGCAG", 5), "KpnI": ("GGTACC", 5), "SmaI": ("CCCGGG", 3), "SacI": ("GAGCTC", 5),
    "NotI": ("GCGGCCGC", 2), "EcoRV": ("GATATC", 3), "NdeI": ("CATATG", 2), "NheI": ("GCTAGC", 1), "SpeI": ("ACTAGT", 1),
}


def motif_masks(motif: str) -> list[int]:
    return [MASKS.get(c, 15) for c in motif.encode().upper().decode("latin-1")]


def complement_masks(masks: list[int]) -> list[int]:
    """Masks of the reverse complement: reversed, with A and T, C and G changed over."""
    return [int(f"{m:04b}"[::-1], 2) for m in reversed(masks)]


def mask_pattern(masks: list[int]) -> str:
    """A pattern that fits where every base of the sequence is allowed; what is no base fits everywhere."""
    def one(mask: int) -> str:
        barred = "".join(b for b, bit in (("A", 1), ("C", 2), ("G", 4), ("TU", 8)) if not mask & bit)
        return f"[^{barred}{barred.lower()}]" if barred else "."

    return "".join(map(one, masks))


def matches(sequences: DataFrame, pattern: str) -> DataFrame:
    """``seq_id, start, matched`` of every place, overlapping ones too, where ``pattern`` fits a row's ``seq``.

    The sequence is cut at each place; a place's position is the sum of the
    pieces before it, so rows are matches and not positions of the sequence.
    """
    rows = sequences.select("seq_id", F.regexp_extract_all("seq", F.lit(f"(?s)(?=({pattern}))"), F.lit(1)).alias("found"), F.transform(F.split("seq", f"(?s)(?={pattern})"), lambda x: F.length(x)).alias("sizes"))
    rows = rows.where(F.size("found") > 0)
    n = F.size("found")
    # The first piece leads up to the first match, unless that is at the very start.
    steps = F.when(F.size("sizes") > n, F.slice("sizes", F.lit(1), n)).otherwise(F.concat(F.array(F.lit(0)), F.slice("sizes", F.lit(1), n - 1)))
    rows = rows.withColumn("steps", steps).withColumn("before", sums_before(F.col("steps")))
    rows = rows.select("seq_id", F.explode(F.arrays_zip("before", "steps", F.col("found").alias("matched"))).alias("x"))
    return rows.select("seq_id", (F.col("x.before") + F.col("x.steps")).alias("start"), F.col("x.matched").alias("matched"))


def find_motifs(sequences: DataFrame, motif: str, strand: str = "both", id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """``seq_id, start, end, matched, strand``: 0-based, half-open, overlapping; ``+`` and ``-`` choose one strand."""
    masks = motif_masks(motif)
    rows = sequences.select(F.col(id_col).alias("seq_id"), as_bytes(F.col(seq_col)).alias("seq"))
    rows = rows if masks else rows.where("false")
    strands = [("+", masks)] * (strand != "-") + [("-", complement_masks(masks))] * (strand != "+")
    found = None
    for name, own in strands:
        some = matches(rows, mask_pattern(own)).withColumn("strand", F.lit(name))
        found = some if found is None else found.unionByName(some)
    return found.select("seq_id", "start", (F.col("start") + len(masks)).alias("end"), "matched", "strand")


def find_restriction_sites(sequences: DataFrame, enzyme_names: list[str] | None = None, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """``seq_id, enzyme_name, position, cut_position, recognition_site, strand``; no names mean all enzymes.

    One pass looks for all sites at once (none begins another) and the few
    matches meet the table of enzymes.
    """
    named = {n.lower() for n in enzyme_names or []}
    chosen = {n: e for n, e in ENZYMES.items() if not named or n.lower() in named}
    spark: SparkSession = sequences.sparkSession
    sites = spark.createDataFrame([(n, s, c) for n, (s, c) in chosen.items()] or [("", "", 0)], "enzyme_name string, recognition_site string, offset int")
    rows = sequences.select(F.col(id_col).alias("seq_id"), ascii_upper(as_bytes(F.col(seq_col))).alias("seq"))
    rows = rows if chosen else rows.where("false")
    found = matches(rows, "|".join(s for s, _ in chosen.values()) or "A").withColumnsRenamed({"matched": "recognition_site", "start": "position"})
    found = found.join(F.broadcast(sites), "recognition_site")  # at most the built-in enzymes
    return found.select("seq_id", "enzyme_name", "position", (F.col("position") + F.col("offset")).alias("cut_position"), "recognition_site", F.lit("+").alias("strand"))
