"""Nucleotide functions of one sequence: GC content, reverse complement, translation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ascii import as_bytes, ascii_upper

# Nucleotide codes and their complements, place by place (U pairs with A, unknown with N).
BASES = "ATGCNURYSWKMBDHV"
COMPLEMENTS = "TACGNAYRSWMKVHDB"

# The standard genetic code, codons in TCAG x TCAG x TCAG order.
CODE_ORDER = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

CODONS = [a + b + c for a in CODE_ORDER for b in CODE_ORDER for c in CODE_ORDER]


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def gc_content(sequence: Column) -> Column:
    """GC in percent of A, C, G, T and U; 0.0 without any of them."""
    gc = F.regexp_count(sequence, F.lit("[GCgc]"))
    return percent(gc, gc + F.regexp_count(sequence, F.lit("[ATUatu]")))


def reverse_complement(sequence: Column) -> Column:
    """Upper-case reverse complement; every byte that is no nucleotide code becomes N."""
    known = F.regexp_replace(ascii_upper(as_bytes(sequence)), f"[^{BASES}]", "N")
    return F.reverse(F.translate(known, BASES, COMPLEMENTS))


def codons(sequence: Column, frame: int = 0) -> Column:
    """Whole codons from ``frame`` on, as an array."""
    tail = F.substring(sequence, frame + 1, 2147483647) if frame else sequence
    return F.regexp_extract_all(tail, F.lit("(?s)..."), F.lit(0))


def codon_letter(codon: Column, code: str = CODE) -> Column:
    """The letter of a codon, X for one that isn't four-letter DNA.

    The codons stand in one string, four places apart; no codon holds a blank,
    so a codon is found only at its own place.
    """
    place = F.position(codon, F.lit(" ".join(CODONS)))
    return F.when(place > 0, F.substr(F.lit(code), ((place + 3) / 4).cast("int"), F.lit(1))).otherwise("X")


def translate_codons(codon_array: Column, code: str = CODE) -> Column:
    return F.array_join(F.transform(codon_array, lambda c: codon_letter(c, code)), "")


def translate_dna(sequence: Column) -> Column:
    """Protein of frame 0. Stops are ``*`` and don't end it; codons with U or other letters are X."""
    return translate_codons(codons(ascii_upper(as_bytes(sequence))))


def sums_before(sizes: Column) -> Column:
    """For each place of an array of numbers, the sum of those before it; linear time, and no shuffle as a window would need."""

    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int64) - x)

    return F.pandas_udf(run, "array<long>")(sizes)
