"""Reproducible random draws from hashes: the same keys give the same draw on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts) -> Column:
    """First 32 bits of md5 over the parts joined by '|'."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mix(a: Column, b: Column) -> Column:
    """Scramble two non-negative integers below 2**31 into one; cheap enough for inner loops."""
    x = a.bitwiseXOR(b)
    x = (x * 48271 + 11) % 2147483647
    x = x.bitwiseXOR(F.shiftright(x, 13))
    x = (x * 69621 + b) % 2147483647
    return x.bitwiseXOR(F.shiftright(x, 16))
