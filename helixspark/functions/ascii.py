"""Byte-wise text helpers. The sequence functions see bytes, Spark's see characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()


def ascii_upper(text: Column) -> Column:
    """a-z upper-cased, all else untouched."""
    return F.when(F.octet_length(text) == F.length(text), F.upper(text)).otherwise(F.translate(text, LOWER, UPPER))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def as_bytes(text: Column) -> Column:
    """One character for each UTF-8 byte, so that lengths and positions count bytes."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
