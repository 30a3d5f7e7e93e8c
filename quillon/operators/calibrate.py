"""Thresholds, percentile calibration, fusion and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.prefix import by_range, linear_quantiles, running_total
from quillon.session import cut, small_side


def strict_threshold(scores: DataFrame, score: str, target: float = 0.95) -> DataFrame:
    """One row (threshold): the linear ``target`` quantile of known validation scores; null without rows."""
    counts = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    return linear_quantiles(cut(counts), [], score, "n", {"threshold": target})


def development_threshold(known: DataFrame, unknown: DataFrame, score: str, target: float = 0.95, label: str | None = None) -> DataFrame:
    """One row (threshold, known_recall, unknown_recall): the best mean of both recalls among
    the occurring scores whose known recall reaches the target; the smallest on a tie.

    Scores are counted by value before they are ordered, range by range. Without known or
    unknown rows the result is empty. With ``label``, a class on both sides raises.
    """
    if label:
        check_disjoint(known, unknown, label)
    rows = known.select(F.col(score).alias("s"), F.lit(1).alias("k")).unionByName(unknown.select(F.col(score).alias("s"), F.lit(0).alias("k")))
    counts = cut(rows.where("s is not null and not isnan(s)").groupBy("s").agg(F.sum("k").alias("k"), F.sum(1 - F.col("k")).alias("u")))
    run = by_range(counts, ["s"])
    for c in ("k", "u"):
        run = running_total(run, [], "piece", ["s"], F.col(c), f"{c}_below")
    every = counts.agg(F.sum("k").alias("nk"), F.sum("u").alias("nu"))
    share = lambda c: F.try_divide(F.col(f"{c}_below") + F.col(c), F.col(f"n{c}"))
    r = run.crossJoin(F.broadcast(every)).select("s", share("k").alias("known_recall"), (1 - share("u")).alias("unknown_recall")).where("unknown_recall is not null")
    allowed = r.where(F.col("known_recall") + 1e-12 >= target)
    best = allowed.agg(F.max_by(F.struct("s", "known_recall", "unknown_recall"), F.struct((0.5 * (F.col("known_recall") + F.col("unknown_recall"))).alias("b"), (-F.col("s")).alias("n"))).alias("b"))
    return best.where("b is not null").select(F.col("b.s").alias("threshold"), "b.known_recall", "b.unknown_recall")


def overlapping_classes(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Labels that both sides hold."""
    return a.select(label).intersect(b.select(label))


def check_disjoint(a: DataFrame, b: DataFrame, label: str) -> None:
    """Raises if a label is on both sides; names the first ten."""
    both = [r[0] for r in overlapping_classes(a, b, label).orderBy(label).limit(10).collect()]
    if both:
        raise ValueError(f"classes on both sides: {', '.join(map(str, both))}")


def empirical_percentile(rows: DataFrame, reference: DataFrame, score: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the share of reference scores at or below the row's score.

    Reference and rows are counted by distinct score, ordered range by range, then joined
    back, so no range join is needed. With an empty reference the share is null.
    """
    counts = rows.select(F.col(score).alias("__s"), F.lit(0).alias("__r")).unionByName(reference.select(F.col(score).alias("__s"), F.lit(1).alias("__r")))
    by = cut(counts.where("__s is not null").groupBy("__s").agg(F.sum("__r").alias("__n")))
    run = running_total(by_range(by, ["__s"]), [], "piece", ["__s"], F.col("__n"), "__below")
    every = by.agg(F.sum("__n").alias("__all"))
    share = run.crossJoin(F.broadcast(every)).select("__s", F.try_divide(F.col("__below") + F.col("__n"), F.col("__all")).alias(out))
    return rows.join(share, rows[score] == share["__s"], "left").drop("__s")


def late_fusion(a: Column, b: Column, alpha: float = 0.5) -> Column:
    return alpha * a + (1 - alpha) * b


def max_fusion(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def representatives(df: DataFrame, label: str, score: str, key: str, quantiles: list[float]) -> DataFrame:
    """Rows of each label at the given score quantiles: rank half-even round of q (n - 1), each once."""
    at = [F.bround(F.lit(q) * (F.col("__n") - 1)).cast("bigint") for q in quantiles]
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    ranked = running_total(by_range(df, [score, key], "__range"), [label], "__range", [score, key], F.lit(1), "__i").join(small_side(sizes), label)
    return ranked.where(F.array_contains(F.array(*at), F.col("__i").cast("bigint"))).select(*df.columns)


def accepted(strategy: str, confidence: Column, margin: Column, unknown: Column, quality: Column, c: Column, m: Column, u: Column) -> Column:
    """Whether a record is accepted under thresholds of one of the three strategies."""
    if strategy == "confidence_only":
        return confidence >= c
    if strategy == "confidence_margin":
        return (confidence >= c) & (margin >= m)
    return quality & (unknown < u) & (confidence >= c) & (margin >= m)


def accepted_by(strategy: Column, confidence: Column, margin: Column, unknown: Column, quality: Column, c: Column, m: Column, u: Column) -> Column:
    """``accepted`` with the strategy in a column; a foreign strategy accepts nothing."""
    hit = F.lit(False)
    for name in ("confidence_only", "confidence_margin", "confidence_margin_msp_qc"):
        hit = F.when(strategy == name, accepted(name, confidence, margin, unknown, quality, c, m, u)).otherwise(hit)
    return hit


def threshold_grids(df: DataFrame, columns: list[str], steps: int = 20) -> DataFrame:
    """One row, an array a column: its distinct linear quantiles at 0, 1/steps, .., 1 in order.

    They have nine digits, so that the noise of interpolation does not set a threshold just
    above the value it should equal. All columns are counted and ordered in one pass.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "v").where("v is not null and not isnan(v)")
    counts = cut(long.groupBy("column", "v").agg(F.count("*").alias("n")))
    names = {f"q{i}": i / steps for i in range(steps + 1)}
    q = linear_quantiles(counts, ["column"], "v", "n", names)
    tidy = F.array_sort(F.array_distinct(F.transform(F.array(*names), lambda x: F.round(x, 9))))
    one = q.select("column", tidy.alias("g"))
    pick = lambda c: F.coalesce(F.max(F.when(F.col("column") == c, F.col("g"))), F.array().cast("array<double>"))
    return cut(one.agg(*[pick(c).alias(c) for c in columns]))


def operating_points(records: DataFrame, targets: list[float], steps: int = 20) -> DataFrame:
    """(strategy, target, coverage, n_records, confidence, margin, unknown): for each strategy and
    target the grid thresholds with coverage nearest the target, larger thresholds on a tie.

    ``records`` has confidence, margin, unknown_score, quality_pass. A record is placed on
    the quantile grid once and counted by grid cell, so the grid's coverages come from at
    most (steps + 1)^3 cells whatever the number of records, and are shared by all targets.
    """
    columns = ["confidence", "margin", "unknown_score"]
    one = threshold_grids(records, columns, steps).select(*[F.col(c).alias(f"g_{c}") for c in columns])
    n = records.agg(F.count("*").alias("n_records"))
    below = lambda c: F.size(F.filter(f"g_{c}", lambda t: t <= F.col(c)))
    cells = records.crossJoin(F.broadcast(one)).groupBy(
        below("confidence").alias("ic"), below("margin").alias("im"), below("unknown_score").alias("iu"), F.coalesce("quality_pass", F.lit(False)).alias("q")
    ).agg(F.count("*").alias("k"))
    cells, n = cut(cells), cut(n)
    parts = []
    at = lambda c, i: F.posexplode(F.col(f"g_{c}")).alias(i, f"t_{c}")
    for strategy in ("confidence_only", "confidence_margin", "confidence_margin_msp_qc"):
        grid = one.select(at("confidence", "jc"), "g_margin", "g_unknown_score")
        hit = F.col("ic") > F.col("jc")
        if strategy == "confidence_only":
            grid = grid.select("jc", "t_confidence", F.lit(None).cast("double").alias("t_margin"), F.lit(None).cast("double").alias("t_unknown_score"), F.lit(0).alias("jm"), F.lit(0).alias("ju"))
        else:
            grid = grid.select("jc", "t_confidence", "g_unknown_score", at("margin", "jm"))
            hit = hit & (F.col("im") > F.col("jm"))
            if strategy == "confidence_margin":
                grid = grid.select("jc", "t_confidence", "t_margin", F.lit(None).cast("double").alias("t_unknown_score"), "jm", F.lit(0).alias("ju"))
            else:
                grid = grid.select("jc", "t_confidence", "t_margin", "jm", at("unknown_score", "ju"))
                hit = hit & (F.col("iu") <= F.col("ju")) & F.col("q")
        covered = grid.join(F.broadcast(cells), hit, "left").groupBy("t_confidence", "t_margin", "t_unknown_score").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
        covered = covered.crossJoin(F.broadcast(n)).withColumn("coverage", F.col("k") / F.col("n_records"))
        goal = covered.select("*", F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target"))
        low = lambda c: -F.coalesce(c, F.lit(-1.0))
        rank = F.struct(F.abs(F.col("coverage") - F.col("target")).alias("a"), low("t_confidence").alias("b"), low("t_margin").alias("c"), low("t_unknown_score").alias("d"))
        best = goal.groupBy("target").agg(F.min_by(F.struct("coverage", "n_records", "t_confidence", "t_margin", "t_unknown_score"), rank).alias("p"))
        parts.append(best.select(F.lit(strategy).alias("strategy"), "target", "p.coverage", "p.n_records", F.col("p.t_confidence").alias("confidence"), F.col("p.t_margin").alias("margin"), F.col("p.t_unknown_score").alias("unknown")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
