"""Label, identifier and split normalisation as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = r"(?U)^\s+|\s+$"

# Spellings of the split names after normalisation.
SPLIT_NAMES = {
    "train": "train",
    "validation": "validation",
    "known_validation": "validation",
    "test": "test",
    "known_test": "test",
    "unknown_test": "test",
}


def strip(c: Column) -> Column:
    """White space, tabs included, dropped at both ends."""
    return F.regexp_replace(c, _ENDS, "")


def trim_lower(c: Column) -> Column:
    """T(x): ends stripped, lower case; null stays null."""
    return F.lower(strip(c))


def normalize_label(c: Column) -> Column:
    """N(x): T(x) with space ``- / \\ .`` as ``_``, runs made one, outer ones dropped."""
    return F.regexp_replace(F.regexp_replace(trim_lower(c), r"[ \-/\\._]+", "_"), "^_|_$", "")


def present(c: Column) -> Column:
    """True where a text is neither null nor blank."""
    return c.isNotNull() & (strip(c) != "")


def split_name(c: Column) -> Column:
    """The split of a row; null for null, blank and foreign names."""
    n = normalize_label(c)
    out = F.lit(None).cast("string")
    for raw, split in SPLIT_NAMES.items():
        out = F.when(n == raw, split).otherwise(out)
    return out
