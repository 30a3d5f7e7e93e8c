"""64-bit perceptual hashes: parsing and Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import trim_lower


def hash64(c: Column) -> Column:
    """A 64-bit hash as bigint from 16 hex digits or 64 binary digits.

    Case, outer white space and a ``0x`` prefix are ignored; null, blank and any other
    text give null.
    """
    t = F.regexp_replace(trim_lower(c), "^0x", "")
    hexed = (
        F.when(t.rlike("^[01]{64}$"), F.lpad(F.conv(t, 2, 16), 16, "0"))
        .when(t.rlike("^[0-9a-f]{16}$"), F.upper(t))
    )
    return F.conv(hexed, 16, -10).cast("bigint")


def hamming64(a: Column, b: Column) -> Column:
    """Number of bits in which two bigints differ."""
    return F.bit_count(a.bitwiseXOR(b))
