"""Token estimate of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of code points that count as one token each.
CJK_RANGES = ((0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
CJK_CLASS = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in CJK_RANGES) + "]"


def estimate_tokens(text: Column) -> Column:
    """One token for each CJK character, one for each started four of the others."""
    cjk = F.regexp_count(text, F.lit(CJK_CLASS))
    return (cjk + F.floor((F.length(text) - cjk + 3) / 4)).cast("long")
