"""Class means and nearest-centroid scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.functions import vec


def class_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, mean, n): the mean vector of each class, combined map-side.

    Rows with a null label or vector are left out; vectors must have one length.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    return rows.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("mean"), F.count("*").alias("n")
    )


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


_NEAR = StructType([StructField("label", StringType()), StructField("first", DoubleType()), StructField("second", DoubleType())])


def with_nearest(df: DataFrame, means: DataFrame, label: str, vector: str, measure: str = "euclidean") -> DataFrame:
    """``df`` with nearest_label, nearest, second and margin (second less nearest).

    ``measure`` is ``euclidean`` or ``cosine`` (one less the dot product of both directions,
    zero vectors keeping zero). ``vector`` must be a stored column or a cast of one: Spark
    cannot feed a Python function from an expression with lambdas. The class means,
    classes x d numbers, are gathered and scored against Arrow batches as matrices, which
    is faster than interpreted array functions and needs no join. Ties go to the smaller
    label. A null vector and a table without classes give nulls.
    """
    if measure not in ("euclidean", "cosine"):
        raise ValueError("measure must be euclidean or cosine")
    rows = sorted((r[0], r[1]) for r in means.select(label, "mean").collect())
    names, bank = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)

    @F.pandas_udf(_NEAR)
    def near(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"label": [None] * len(v), "first": [None] * len(v), "second": [None] * len(v)})
        there = v.notna().to_numpy()
        if not len(names) or not there.any():
            return out
        x = np.stack(v[there].to_numpy()).astype(float)
        if measure == "euclidean":
            d = np.stack([np.sqrt(((x - m) ** 2).sum(axis=1)) for m in bank], axis=1)
        else:
            d = 1 - _directions(x) @ _directions(bank).T
        best = d.argmin(axis=1)
        out.loc[there, "label"] = np.array(names, dtype=object)[best]
        out.loc[there, "first"] = d[np.arange(len(x)), best]
        if len(names) > 1:
            out.loc[there, "second"] = np.partition(d, 1, axis=1)[:, 1]
        return out

    one = df.withColumn("__near", near(F.col(vector)))
    gap = F.col("__near.second") - F.col("__near.first")
    return (
        one.withColumn("nearest_label", F.col("__near.label")).withColumn("nearest", F.col("__near.first"))
        .withColumn("second", F.col("__near.second")).withColumn("margin", gap).drop("__near")
    )


def mean_distances(means: DataFrame, label: str, measure=vec.distance) -> DataFrame:
    """(label_a, label_b, distance) for every ordered pair of classes, zero on the diagonal."""
    a = means.select(F.col(label).alias("label_a"), F.col("mean").alias("__a"))
    b = means.select(F.col(label).alias("label_b"), F.col("mean").alias("__b"))
    d = F.when(F.col("label_a") == F.col("label_b"), 0.0).otherwise(measure(F.col("__a"), F.col("__b")))
    return a.crossJoin(F.broadcast(b)).select("label_a", "label_b", d.alias("distance"))


def moments(df: DataFrame, vector: str) -> Column:
    """Population mean and variance of a vector column as one struct of arrays."""
    v = array_to_vector(F.col(vector))
    return F.struct(
        vector_to_array(Summarizer.mean(v)).alias("mean"), vector_to_array(Summarizer.variance(v)).alias("var"), F.count(vector).alias("n")
    )


def standardized(df: DataFrame, fit: DataFrame, vector: str, out: str) -> DataFrame:
    """``df`` with ``out``: the vector less the mean of ``fit``, over its population deviation.

    A column that does not vary is divided by 1. With a single fitted row nothing varies.
    """
    stats = fit.agg(moments(fit, vector).alias("__s"))
    n = F.col("__s.n")
    sd = F.transform(F.col("__s.var"), lambda v: F.when(v * (n - 1) <= 0, 1.0).otherwise(F.sqrt(v * (n - 1) / n)))
    scaled = F.zip_with(F.zip_with(F.col(vector), F.col("__s.mean"), lambda x, m: x - m), sd, lambda x, s: x / s)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, scaled).drop("__s")
