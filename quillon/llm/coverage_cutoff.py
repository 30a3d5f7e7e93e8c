"""Score cutoffs by source that keep a target share: sketches first, exact counts second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normalize_label, split_name, trim_lower
from quillon.operators.prefix import running_total
from quillon.session import cut, small_side

SKETCH_K = 400
RANK_MARGIN = 0.02
GRID = 200
PIECES = 64

# The strategies that have one score, and which end of it is kept.
STRATEGIES = {"confidence_only": ("confidence", "high"), "confidence_margin_msp_qc": ("unknown_score", "low")}


def known_validation_scores(signals: DataFrame) -> DataFrame:
    """(dataset, strategy, x) of the known validation records; small x is kept first.

    A sample counts with its latest scored_at; rows that tie there are copies. Rows
    without a sample_id are no records. Scores that are null, NaN or outside 0 to 1 are
    left out; a high-is-kept score is negated. Null datasets form a source named ''.
    """
    row = F.struct(
        F.col("scored_at"),
        F.coalesce(trim_lower(F.col("dataset")), F.lit("")).alias("dataset"),
        split_name(F.col("split")).alias("split"),
        normalize_label(F.col("known_or_unknown")).alias("status"),
        F.col("confidence"),
        F.col("unknown_score"),
    )
    latest = (
        signals.where("sample_id is not null")
        .groupBy("sample_id")
        .agg(F.max(row).alias("r"))
        .where("r.split = 'validation' and r.status = 'known'")
    )
    both = F.array(
        *[
            F.struct(F.lit(name).alias("strategy"), F.col(f"r.{score}").alias("score"), F.lit(keep == "high").alias("high"))
            for name, (score, keep) in STRATEGIES.items()
        ]
    )
    return (
        latest.select("r.dataset", F.inline(both))
        .where("score >= 0 and score <= 1")
        .select("dataset", "strategy", (F.when(F.col("high"), -F.col("score")).otherwise(F.col("score")) + F.lit(0.0)).alias("x"))
    )


def target_points(points: DataFrame) -> DataFrame:
    """(point_id, strategy, target) of the usable operating points, each once."""
    return (
        points.select("point_id", normalize_label(F.col("strategy")).alias("strategy"), F.col("target_coverage").alias("target"))
        .where(F.col("strategy").isin(*STRATEGIES) & (F.col("target") > 0) & (F.col("target") <= 1))
        .distinct()
    )


def coverage_cutoffs(scores: DataFrame, points: DataFrame, k: int = SKETCH_K, margin: float = RANK_MARGIN) -> DataFrame:
    """(point_id, strategy, target, dataset, x, n_kept, n_ties, n_records), one a point and source.

    One pass builds a mergeable quantile sketch a source and strategy. Its quantiles at the
    target share less and plus ``margin`` bracket the cutoff; a second pass counts the rows
    below the bracket as one number and those inside it by value, so that only the values
    of the bracket are shuffled, whole rows never. The cutoff is the first value at which
    the kept share, ties included, reaches the target. Where the counts show that a bracket
    missed (the sketch's bound holds with high probability only), the bracket is widened
    and counted again, at last to everything, so the result is exact. A source without
    records has no row.
    """
    scores = cut(scores)
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketches = (
        scores.groupBy("dataset", "strategy")
        .agg(
            F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"), F.count("*").alias("n_records"),
            F.min("x").alias("least"), F.max("x").alias("most"),
        )
        .withColumn("quantiles", F.kll_sketch_get_quantile_double("sketch", ranks))
        .drop("sketch")
    )
    todo = cut(small_side(points).join(sketches, "strategy"))
    done: list[DataFrame] = []
    while True:
        low, high = F.col("target") - margin, F.col("target") + margin
        brackets = todo.select(
            "point_id", "strategy", "target", "dataset", "n_records",
            F.when(low <= 0, F.col("least")).otherwise(F.get("quantiles", F.greatest(F.floor(low * GRID), F.lit(0)).cast("int"))).alias("lo"),
            F.when(high >= 1, F.col("most")).otherwise(F.get("quantiles", F.least(F.ceil(high * GRID), F.lit(GRID)).cast("int"))).alias("hi"),
        )
        counted = (
            scores.join(small_side(brackets), ["dataset", "strategy"])
            .where("x <= hi")
            .withColumn("v", F.when(F.col("x") >= F.col("lo"), F.col("x")))
            .groupBy("point_id", "strategy", "target", "dataset", "n_records", "lo", "hi", "v")
            .agg(F.count("*").alias("n_ties"))
        )
        at = F.when(F.col("v").isNull(), -1).when(F.col("hi") <= F.col("lo"), 0).otherwise(
            F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PIECES)
        )
        totals = running_total(counted.withColumn("piece", at), ["point_id", "target", "dataset", "strategy"], "piece", ["v"], F.col("n_ties"), "before")
        reached = totals.withColumn("n_kept", F.col("before") + F.col("n_ties")).where(F.col("n_kept") / F.col("n_records") >= F.col("target"))
        first = cut(
            reached.groupBy("point_id", "strategy", "target", "dataset", "n_records")
            .agg(F.min(F.struct("n_kept", "v", "n_ties")).alias("f"))
            .select("point_id", "strategy", "target", "dataset", F.col("f.v").alias("x"), "f.n_kept", "f.n_ties", "n_records")
        )
        done.append(first.where("x is not null"))
        if margin >= 1:
            break
        todo = cut(todo.join(done[-1].select("point_id", "target", "dataset", "strategy"), ["point_id", "target", "dataset", "strategy"], "left_anti"))
        if todo.isEmpty():
            break
        margin = 1.0 if margin >= 0.25 else margin * 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def dataset_cutoffs(signals: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, strategy, target, dataset, cutoff, n_kept, n_ties, n_records) in the score's own sense."""
    high = [s for s, (_, keep) in STRATEGIES.items() if keep == "high"]
    cuts = coverage_cutoffs(known_validation_scores(signals), target_points(points))
    return cuts.withColumn("cutoff", F.when(F.col("strategy").isin(*high), -F.col("x")).otherwise(F.col("x")) + F.lit(0.0)).drop("x")
