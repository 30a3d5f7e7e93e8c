"""Ranking and calibration metrics from one frame of counts by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.prefix import by_range, linear_quantiles, running_total
from quillon.session import cut, small_side


def score_counts(df: DataFrame, by: list[str], positive: Column, score: Column) -> DataFrame:
    """(by, score, pos, neg): rows counted by score, combined map-side; ties become one row.

    Rows whose label or score is null or whose score is NaN are left out. Everything below
    runs on these counts, so rounding a score bounds what one task has to order.
    """
    rows = df.select(*by, positive.cast("int").alias("__y"), score.cast("double").alias("score"))
    rows = rows.where(F.col("__y").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return cut(rows.groupBy(*by, "score").agg(F.sum("__y").alias("pos"), F.sum(1 - F.col("__y")).alias("neg")))


def _group(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _with_totals(run: DataFrame, counts: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """``run`` with sums of ``counts`` over each group, one row a group."""
    every = counts.groupBy(*by).agg(*[F.sum(c).alias(name) for c, name in columns.items()])
    return run.join(small_side(every), by) if by else run.crossJoin(F.broadcast(every))


def auroc(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, auroc): chance that a positive outranks a negative, ties half; null if a side is empty.

    The negatives below a score are summed piece by piece of the scores in order, so no
    task orders all scores. ``by`` must hold no nulls.
    """
    below = running_total(by_range(counts, ["score"]), by, "piece", ["score"], F.col("neg"), "__below")
    won = below.withColumn("__won", F.col("pos") * (F.col("__below") + F.col("neg") / 2))
    sides = F.sum("pos") * F.sum("neg")
    return won.groupBy(*by).agg(F.when(sides > 0, F.sum("__won") / sides).alias("auroc"))


def average_precision(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, aupr): precision summed over the steps in recall, scores falling; piece by piece as ``auroc``."""
    run = falling(counts, by, {"pos": "__p", "neg": "__n"})
    p, n = F.col("__p") + F.col("pos"), F.col("__n") + F.col("neg")
    return run.groupBy(*by).agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * p / (p + n)) / F.sum("pos")).alias("aupr"))


def falling(counts: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """``counts`` with the sums of ``columns`` over all larger scores of the group."""
    run = by_range(counts.withColumn("__down", -F.col("score")), ["__down"])
    for c, name in columns.items():
        run = running_total(run, by, "piece", ["__down"], F.col(c), name)
    return run.drop("piece", "__down")


def fpr_at_tpr(df: DataFrame, by: list[str], positive: Column, score: Column, tpr: float = 0.95) -> DataFrame:
    """(by, fpr): share of negatives strictly above the (1 - tpr) linear quantile of positives; no row if a side is empty."""
    return fpr_of_counts(score_counts(df, by, positive, score), by, tpr)


def fpr_of_counts(counts: DataFrame, by: list[str], tpr: float = 0.95) -> DataFrame:
    """``fpr_at_tpr`` of rows counted by score."""
    bound = linear_quantiles(counts.where("pos > 0"), by, "score", "pos", {"__t": 1 - tpr})
    neg = counts.where("neg > 0")
    joined = neg.join(small_side(bound), by) if by else neg.crossJoin(F.broadcast(bound))
    above = F.sum(F.when(F.col("score") > F.col("__t"), F.col("neg")).otherwise(0))
    return joined.groupBy(*by).agg((above / F.sum("neg")).alias("fpr"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column a share): exact linear quantiles of the values that are neither null nor NaN."""
    v = F.col(value).cast("double")
    counts = cut(df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n")))
    return linear_quantiles(counts, by, "__v", "__n", shares)


def medians(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    return quantiles(df, by, value, {out: 0.5})


def roc_points(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, tpr, fpr): the operating point that accepts scores of at least ``score``;
    the rate of a side without rows is null."""
    run = _with_totals(falling(counts, by, {"pos": "__p", "neg": "__n"}), counts, by, {"pos": "__np", "neg": "__nn"})
    rate = lambda above, own, all_: F.try_divide(F.col(above) + F.col(own), F.col(all_))
    return run.select(*by, "score", rate("__p", "pos", "__np").alias("tpr"), rate("__n", "neg", "__nn").alias("fpr"))


def oscr(df: DataFrame, by: list[str], known: Column, correct: Column, confidence: Column) -> DataFrame:
    """(by, oscr): area under correct classification rate against false positive rate.

    One point a distinct confidence, which accepts rows of at least it. Both rates rise as
    the confidence falls, so the points in that order are joined by trapezoids, each from
    the sums before it; there is no point at the origin.
    """
    rows = df.select(*by, known.cast("int").alias("__k"), (known & correct).cast("int").alias("__c"), confidence.alias("score"))
    counts = cut(rows.where("score is not null").groupBy(*by, "score").agg(
        F.sum("__c").alias("__right"), F.sum("__k").alias("__known"), F.sum(1 - F.col("__k")).alias("__unknown")
    ))
    run = falling(counts, by, {"__right": "__r", "__known": "__seen", "__unknown": "__u"})
    run = _with_totals(run, counts, by, {"__known": "__nk", "__unknown": "__nu"})
    one = F.lit(1)
    ccr = lambda c: c / F.greatest(one, F.col("__nk"))
    fpr = lambda c: c / F.greatest(one, F.col("__nu"))
    step = (fpr(F.col("__u") + F.col("__unknown")) - fpr(F.col("__u"))) * (ccr(F.col("__r") + F.col("__right")) + ccr(F.col("__r"))) / 2
    later = F.col("__seen") + F.col("__u") > 0
    return run.groupBy(*by).agg(F.coalesce(F.sum(F.when(later, step)), F.lit(0.0)).alias("oscr"))


def expected_calibration_error(df: DataFrame, by: list[str], confidence: Column, correct: Column, bins: int = 15) -> DataFrame:
    """(by, ece): bins (lo, hi] of equal width; a confidence of 0 falls into none but counts in n."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    at = F.size(F.filter(edges, lambda e: e < F.col("__c")))
    rows = df.select(*by, confidence.alias("__c"), correct.cast("double").alias("__r")).withColumn("__b", at)
    each = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"), F.sum("__r").alias("__right"), F.sum("__c").alias("__conf"))
    gap = F.when((F.col("__b") >= 1) & (F.col("__b") <= bins), F.abs(F.col("__right") - F.col("__conf"))).otherwise(0.0)
    return each.groupBy(*by).agg((F.sum(gap) / F.sum("__n")).alias("ece"))


def trapezoid(df: DataFrame, by: list[str], x: str, y: str, out: str) -> DataFrame:
    """(by, out): area under y over x, points in the order of x; null with under two points."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    w = _group(by).orderBy(x, y)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return rows.withColumn("__a", part).groupBy(*by).agg(F.when(F.count("*") > 1, F.sum("__a")).alias(out))


def class_report(df: DataFrame, truth: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) for every label of ``classes``; empty ratios are 0."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("tp"))
    p = df.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("given"))
    rows = classes.join(t, "label", "left").join(p, "label", "left").fillna(0, ["support", "tp", "given"])
    pr = F.when(F.col("given") > 0, F.col("tp") / F.col("given")).otherwise(0.0)
    rc = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    return rows.select("label", pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), "support")
