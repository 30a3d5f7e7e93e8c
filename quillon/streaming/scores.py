"""Streams of scored records: first arrivals, windowed counts and threshold flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normalize_label, trim_lower


def flagged(stream: DataFrame, threshold: float) -> DataFrame:
    """Records with ``flag``: unknown_score strictly above a frozen threshold. Stateless."""
    return stream.withColumn("flag", F.col("unknown_score") > threshold)


def first_arrivals(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each (sample_id, scored_at) once; state older than the watermark is dropped."""
    return stream.withWatermark("scored_at", late).dropDuplicatesWithinWatermark(["sample_id"])


def windowed_rates(stream: DataFrame, threshold: float, width: str = "30 days", late: str = "30 days") -> DataFrame:
    """(window start, dataset, status, n, n_flagged) by event time, late rows within the watermark counted."""
    rows = flagged(stream, threshold).withWatermark("scored_at", late)
    keys = [F.window("scored_at", width).alias("w"), trim_lower(F.col("dataset")).alias("dataset"), normalize_label(F.col("known_or_unknown")).alias("status")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("flag").alias("n_flagged")).select(F.col("w.start").alias("start"), "dataset", "status", "n", "n_flagged")
