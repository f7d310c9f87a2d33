"""Where a space's tables live: 256 shards by a hash of the space's name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 256
# The low bytes of the 64-bit FNV-1a start and prime; only the low byte of the hash is used, and it depends on nothing else.
START, PRIME = 0x25, 0xB3


def shard_of(space_id: str) -> str:
    h = START
    for b in space_id.encode():
        h = (h ^ b) * PRIME & 255
    return f"shard_{h:02x}"


def shard_column(space_id: Column) -> Column:
    """The same of a column."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(space_id, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    h = F.aggregate(codes, F.lit(START), lambda a, b: (a.bitwiseXOR(b) * PRIME).bitwiseAND(F.lit(255)))
    return F.concat(F.lit("shard_"), F.lpad(F.lower(F.hex(h.cast("long"))), 2, "0"))


def space_path(base: str, space_id: str) -> str:
    """The folder of a space. Names are letters, digits, ``.``, ``_`` and ``-``, not dots alone."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", space_id) or set(space_id) <= {"."}:
        raise ValueError(f"not a space id: {space_id!r}")
    return f"{base.rstrip('/')}/{shard_of(space_id)}/space_{space_id}"
