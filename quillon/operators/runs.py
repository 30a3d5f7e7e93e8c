"""Statistics over repeated runs: matched deltas, intervals and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_CRITICAL = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
NORMAL_CRITICAL = 1.959964


def t_critical(n: Column) -> Column:
    """Critical value for n observations; the normal one above 30 degrees of freedom."""
    table = F.array(*[F.lit(x) for x in T_CRITICAL])
    return F.coalesce(F.get(table, (n - 2).cast("int")), F.lit(NORMAL_CRITICAL))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, sd, median, low, high, least, most): t interval of the finite values.

    One value has itself as interval and no deviation; groups without values have none.
    """
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    s = df.select(*by, v.cast("double").alias("__v")).groupBy(*by).agg(
        F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"), F.median("__v").alias("median"), F.min("__v").alias("least"), F.max("__v").alias("most")
    )
    half = F.when(F.col("n") > 1, t_critical(F.col("n")) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return s.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def matched_deltas(df: DataFrame, by: list[str], side: str, a: str, b: str, value: str) -> DataFrame:
    """(by, a_value, b_value, delta = b - a): groups that hold both sides, from one aggregation."""
    pick = lambda x: F.avg(F.when(F.col(side) == x, F.col(value)))
    both = df.where(F.col(side).isin(a, b)).groupBy(*by).agg(pick(a).alias("a_value"), pick(b).alias("b_value"))
    return both.where("a_value is not null and b_value is not null").withColumn("delta", F.col("b_value") - F.col("a_value"))


def pairs_within(df: DataFrame, by: list[str], member: str) -> DataFrame:
    """Every two rows of a group, the smaller ``member`` first; other columns get ``_a`` and ``_b``.

    For tables with one row a run, where a group has as many rows as there are seeds.
    """
    side = lambda s: df.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in by])
    return side("a").join(side("b"), by).where(F.col(f"{member}_a") < F.col(f"{member}_b"))


def average_rank(by: list[str], value: str) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ties = Window.partitionBy(*by, value)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0


def correlations(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, n, pearson, spearman) of groups with at least ``least`` complete rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumn("__x", average_rank(by, x)).withColumn("__y", average_rank(by, y))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("__x", "__y").alias("spearman")).where(F.col("n") >= least)


def stability(df: DataFrame, by: list[str], delta: str, votes: int = 4) -> DataFrame:
    """(by, favorable, adverse, label): how many deltas are above and below zero."""
    s = df.groupBy(*by).agg(F.count_if(F.col(delta) > 0).alias("favorable"), F.count_if(F.col(delta) < 0).alias("adverse"))
    return s.withColumn("label", F.when(F.col("favorable") >= votes, "improved").when(F.col("adverse") >= votes, "degraded").otherwise("mixed"))


def min_max_total(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``df`` with the sum of its columns scaled to 0..1; a column of width under 1e-12 counts 0."""
    every = Window.partitionBy(F.lit(0))
    total = F.lit(0.0)
    for c in columns:
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        total = total + F.when(hi - lo <= 1e-12, 0.0).otherwise((F.col(c) - lo) / (hi - lo))
    return df.withColumn(out, total)
