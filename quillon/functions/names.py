"""Names derived from other names: methods, groups, split names, class numbers, cell labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import strip

# Groups of unknown classes, class of each cell label, and cell labels that name no cell.
UNKNOWN_GROUPS = {
    "immature_related_myeloid": ("myeloblast", "promyelocyte", "promyelocyte_atypical", "myelocyte", "metamyelocyte", "neutrophil_band"),
    "lymphoid_related": ("lymphocyte_large_granular", "lymphocyte_neoplastic", "lymphocyte_reactive", "hairy_cell", "plasma_cell"),
    "other": ("normoblast", "smudge_cell"),
}
CELL_CLASSES = {
    "basophil": "basophil", "eosinophil": "eosinophil", "small lymph": "lymphocyte", "lymphocyte": "lymphocyte", "lymph": "lymphocyte",
    "monocyte": "monocyte", "neutrophil": "neutrophil_segmented",
}
NO_CELL = ("artifact", "artefact", "burst", "")


def case_of(c: Column, values: Mapping[str, str], default: Column) -> Column:
    """The value of the key that ``c`` equals, else ``default``."""
    out = default
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def method_id(method: Column, variant: Column) -> Column:
    """``method_variant`` in lower case without ``=``, with ``.``, ``-`` and spaces as ``_``."""
    return F.lower(F.translate(F.concat_ws("_", method, variant), ".- =", "___"))


def unknown_group(label: Column, groups: Mapping[str, Sequence[str]] = UNKNOWN_GROUPS) -> Column:
    """The group that lists the label, ``unassigned`` if none does or the label is null."""
    out = F.lit("unassigned")
    for name, members in groups.items():
        out = F.when(label.isin(*members), name).otherwise(out)
    return out


def named_split(split: Column, status: Column) -> Column:
    """The split's name with the status it holds: known_validation, known_test, unknown_test; others as they are."""
    known = F.coalesce(status == "known", F.lit(False))
    return F.when((split == "validation") & known, "known_validation").when((split == "test") & known, "known_test").when(split == "test", "unknown_test").otherwise(split)


def label_index(label: Column, classes: Sequence[str]) -> Column:
    """Place of the label in ``classes``, -1 for any other and for null."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), label).cast("int") - 1, F.lit(-1))


def leading_size(size: Column) -> Column:
    """The number before ``x`` in a size such as ``14x14``; null where there is none."""
    return F.split(size, "x")[0].try_cast("int")


def cell_class(label: Column) -> Column:
    """Struct (morphology, status, eligible, reason) of a raw cell label.

    Spaces, ``_`` and ``-`` are alike and case does not count. Labels of no cell, null ones
    among them, are excluded for that reason; labels of no known class are unknown.
    """
    text = strip(F.regexp_replace(F.translate(F.lower(F.coalesce(label, F.lit(""))), "_-", "  "), r"\s+", " "))
    named = case_of(text, CELL_CLASSES, F.lit("unknown"))
    none = text.isin(*NO_CELL)
    return F.struct(
        F.when(none, "").otherwise(named).alias("morphology"),
        F.when(none, "excluded").when(named == "unknown", "unknown").otherwise("known").alias("status"),
        (~none).alias("eligible"), F.when(none, F.when(text == "", "empty_label").otherwise(text)).otherwise("").alias("reason"),
    )


def hamming_text(a: Column, b: Column) -> Column:
    """Places in which two texts of binary digits differ; texts of different lengths raise."""
    wrong = F.raise_error(F.concat(F.lit("hashes of different lengths: "), F.length(a).cast("string"), F.lit(" and "), F.length(b).cast("string"))).cast("int")
    same = F.length(a) == F.length(b)
    places = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.coalesce(same, F.lit(True)), F.aggregate(places, F.lit(0), lambda s, x: s + x)).otherwise(wrong)
