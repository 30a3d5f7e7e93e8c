"""Rules over measured fields: quality of crops, status of masks, choice of a layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of a usable crop, what each flag costs, and bounds of a usable mask.
CROP = {"side": 32, "focus": 12.0, "dark": 20.0, "bright": 235.0, "clipped": 0.20}
PENALTY = {"invalid_crop": 1.0, "too_small": 0.35, "clipped_at_image_border": 0.25, "blur": 0.25, "underexposed": 0.30, "overexposed": 0.30}
MASK = {"least_cell": 0.03, "most_cell": 0.985, "least_nucleus": 0.005, "most_nucleus_of_cell": 0.85, "least_cytoplasm": 0.01, "most_parts": 8}


def _named(hits: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in hits.items()]))


def crop_quality(width: Column, height: Column, focus: Column, light: Column, clipped: Column, at_border: Column) -> Column:
    """Struct (flags, quality) of a crop: its size, focus, mean light, share of clipped pixels and place.

    A crop without a size is invalid and nothing else. Much clipping counts as too dark or
    too bright, by the mean light. Each flag costs its penalty once.
    """
    no = F.coalesce((width <= 0) | (height <= 0), F.lit(True))
    burnt = clipped > CROP["clipped"]
    hits = {
        "too_small": (width < CROP["side"]) | (height < CROP["side"]), "clipped_at_image_border": F.coalesce(at_border, F.lit(False)), "blur": focus < CROP["focus"],
        "underexposed": (light < CROP["dark"]) | (burnt & (light <= 127.5)), "overexposed": (light > CROP["bright"]) | (burnt & (light > 127.5)),
    }
    flags = F.when(no, F.array(F.lit("invalid_crop"))).otherwise(_named(hits))
    cost = sum((F.when(F.coalesce(h, F.lit(False)), PENALTY[k]).otherwise(0.0) for k, h in hits.items()), F.lit(0.0))
    return F.struct(flags.alias("flags"), F.when(no, 0.0).otherwise(1 - F.least(F.lit(1.0), cost)).alias("quality"))


def mask_status(cell: Column, nucleus: Column, cytoplasm: Column, parts: Column) -> Column:
    """Struct (status, warnings) of a mask from its fractions of the image and its number of parts.

    Impossible cells and nuclei are invalid; a tiny cytoplasm or many parts only warn.
    """
    ratio = F.when(cell > 0, nucleus / cell).otherwise(0.0)
    invalid = {
        "empty_or_tiny_cell": cell < MASK["least_cell"], "cell_covers_nearly_entire_image": cell > MASK["most_cell"], "empty_or_tiny_nucleus_candidate": nucleus < MASK["least_nucleus"],
        "nucleus_candidate_larger_than_expected_cell_fraction": ratio > MASK["most_nucleus_of_cell"],
    }
    mild = {"cytoplasm_candidate_tiny_or_impossible": cytoplasm < MASK["least_cytoplasm"], "extreme_component_fragmentation": parts > MASK["most_parts"]}
    bad = F.coalesce(F.greatest(*invalid.values()), F.lit(True))
    warnings = _named(invalid | mild)
    return F.struct(F.when(bad, "invalid").when(F.size(warnings) > 0, "warning").otherwise("valid").alias("status"), warnings.alias("warnings"))


def best_feasible(df: DataFrame, name: str, feasible: Column, degenerate: str, runtime: str, height: str) -> DataFrame:
    """``df``, a row a candidate, with feasible, score and chosen.

    The score adds the degenerate share, the run time against the longest feasible one and
    a small credit for height, to seven digits; the least wins, then the least name. If
    nothing is feasible, everything is. Candidates are a handful of settings, not data.
    """
    every = Window.partitionBy(F.lit(0))
    f = df.withColumn("feasible", F.coalesce(feasible, F.lit(False)))
    f = f.withColumn("feasible", F.when(F.max("feasible").over(every), F.col("feasible")).otherwise(True))
    longest = F.greatest(F.max(F.when(F.col("feasible"), F.col(runtime))).over(every), F.lit(1e-9))
    score = F.col(degenerate) / 100 + F.col(runtime) / longest - F.log(1 + F.col(height)) * 0.05
    f = f.withColumn("score", F.when(F.col("feasible"), F.round(score, 7)))
    best = F.min(F.when(F.col("feasible"), F.struct("score", F.col(name).alias("name")))).over(every)
    return f.withColumn("chosen", F.col(name) == best["name"])
