"""Protein properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ascii import ascii_upper

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Masses, hydropathies and instability weights of the formulas.
WATER = 18.015
MASS = {"A": 89.09, "R": 174.20, "N": 132.12, "D": 133.10, "C": 121.16, "E": 147.13, "Q": 146.15, "G": 75.07, "H": 155.16, "I": 131.17, "L": 131.17, "K": 146.19, "M": 149.21, "F": 165.19, "P": 115.13, "S": 105.09, "T": 119.12, "W": 204.23, "Y": 181.19, "V": 117.15}
HYDROPATHY = {"I": 4.5, "V": 4.2, "L": 3.8, "F": 2.8, "C": 2.5, "M": 1.9, "A": 1.8, "G": -0.4, "T": -0.7, "S": -0.8, "W": -0.9, "Y": -1.3, "P": -1.6, "H": -3.2, "E": -3.5, "Q": -3.5, "D": -3.5, "N": -3.5, "K": -3.9, "R": -4.5}
INSTABILITY = {"AE": 10.0, "EA": 10.0, "DE": 20.0, "ED": 20.0, "KR": 25.0, "RK": 25.0, "QQ": 20.0, "WW": 10.0, "YY": 10.0, "FF": 10.0}
POSITIVE, NEGATIVE, AROMATIC = "KRH", "DE", "FWY"


def clean_protein(sequence: Column) -> Column:
    """Upper-case letters A-Z only."""
    return F.regexp_replace(ascii_upper(sequence), "[^A-Z]", "")


def letter_counts(protein: Column) -> list[Column]:
    """Count of each letter A-Z, by how much shorter the text is without it."""
    size = F.length(protein)
    return [(size - F.length(F.translate(protein, x, ""))).alias(f"_{x}") for x in LETTERS]


def _weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for letter, weight in weights.items():
        out = out + F.col(f"_{letter}") * weight
    return out


def _some(letters: str) -> Column:
    out = F.lit(0)
    for letter in letters:
        out = out + F.col(f"_{letter}")
    return out


def protein_properties(proteins: DataFrame, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """One row per protein; an empty one has zeros, pI 7 and an empty composition."""
    rows = proteins.select(F.col(id_col).alias("seq_id"), clean_protein(F.col(seq_col)).alias("p"))
    pairs = F.lit(0.0)
    for pair, weight in INSTABILITY.items():
        pairs = pairs + F.regexp_count("p", F.lit(f"(?={pair})")) * weight
    rows = rows.select("seq_id", F.length("p").cast("long").alias("n"), pairs.alias("pairs"), *letter_counts(F.col("p")))
    n, full = F.col("n"), F.col("n") > 0
    plus, minus = _some(POSITIVE), _some(NEGATIVE)
    charged = plus + minus
    point = F.when(charged > 0, F.least(F.greatest(7.0 + 0.3 * (plus - minus) / charged * 10.0, F.lit(2.0)), F.lit(13.0))).otherwise(F.lit(7.0))
    share = [F.when(F.col(f"_{x}") > 0, F.struct(F.lit(x).alias("k"), (F.col(f"_{x}") * 100.0 / n).alias("v"))) for x in LETTERS]

    def mean(total: Column) -> Column:
        return F.when(full, total / n).otherwise(F.lit(0.0))

    return rows.select(
        "seq_id",
        n.alias("length"),
        F.when(full, _weighted(MASS) + WATER).otherwise(F.lit(0.0)).alias("molecular_weight"),
        point.alias("isoelectric_point"),
        (plus - minus).cast("double").alias("net_charge_ph7"),
        mean(_some(AROMATIC)).alias("aromaticity"),
        mean(10.0 * F.col("pairs")).alias("instability_index"),
        mean(_weighted(HYDROPATHY)).alias("gravy"),
        F.map_from_entries(F.filter(F.array(*share), lambda x: x.isNotNull())).alias("aa_composition"),
    )


def aa_composition(proteins: DataFrame, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """``seq_id, aa, percent`` in long form."""
    rows = proteins.select(F.col(id_col).alias("seq_id"), clean_protein(F.col(seq_col)).alias("p"))
    letters = rows.select("seq_id", F.length("p").alias("n"), F.explode(F.split("p", "")).alias("aa")).where("aa != ''")
    return letters.groupBy("seq_id", "n", "aa").agg(F.count(F.lit(1)).alias("c")).select("seq_id", "aa", (F.col("c") * 100.0 / F.col("n")).alias("percent"))
