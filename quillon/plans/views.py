"""Logical tables over the stored ones: normalised, usable, each sample once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.functions.text import normalize_label, split_name
from quillon.operators.splits import per_class_sample
from quillon.sources.tables import table

CLOUD_POINTS = 192


def archive(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, label, status, split, e, z): usable rows of the embedding archive.

    Repeated rows are dropped, as stored floats, before they become doubles; rows without id, label, status, split, or with a vector
    that is not 96 finite numbers or logits that are not 5, are not usable.
    """
    rows = table(spark, d, "embedding_archive")
    return (
        rows.where(F.col("sample_id").isNotNull() & F.col("true_label").isNotNull())
        .where((F.size("embedding") == 96) & vec.finite(F.col("embedding")) & (F.size("logits") == 5) & vec.finite(F.col("logits")))
        .select(
            "sample_id", normalize_label(F.col("true_label")).alias("label"), normalize_label(F.col("known_status")).alias("status"),
            split_name(F.col("split")).alias("split"), F.col("embedding").alias("e"), F.col("logits").alias("z"),
        )
        .where(F.col("status").isin("known", "unknown") & F.col("split").isNotNull())
        .distinct()
        .withColumn("e", vec.doubles(F.col("e"))).withColumn("z", vec.doubles(F.col("z")))
    )


def class_clouds(spark: SparkSession, d: str) -> DataFrame:
    """(label, n_points, c): vectors of at most 192 test samples of each class, first in the hash order."""
    s = per_class_sample(archive(spark, d).where("split = 'test'").select("sample_id", "label", "e"), "sample_id", "label", CLOUD_POINTS)
    return s.groupBy("label").agg(F.count("*").alias("n_points"), F.collect_list("e").alias("c"))
