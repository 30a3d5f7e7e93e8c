"""Boxes (x_min, y_min, x_max, y_max): geometry, matching and average precision."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.prefix import by_range, running_most, running_total


def area(b: Column) -> Column:
    return F.greatest(b["x_max"] - b["x_min"], F.lit(0.0)) * F.greatest(b["y_max"] - b["y_min"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Overlap over union; 0 where the union is empty."""
    w = F.greatest(F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]), F.lit(0.0))
    h = F.greatest(F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def clip(b: Column, width: Column, height: Column) -> Column:
    """The box within the image; null where nothing is left."""
    keep = lambda x, top: F.least(F.greatest(x, F.lit(0.0)), top.cast("double"))
    c = F.struct(keep(b["x_min"], width).alias("x_min"), keep(b["y_min"], height).alias("y_min"), keep(b["x_max"], width).alias("x_max"), keep(b["y_max"], height).alias("y_max"))
    return F.when(area(c) > 0, c)


def expand(b: Column, margin: float) -> Column:
    """The box grown by a share of its own sides on every side."""
    dx, dy = (b["x_max"] - b["x_min"]) * margin, (b["y_max"] - b["y_min"]) * margin
    return F.struct((b["x_min"] - dx).alias("x_min"), (b["y_min"] - dy).alias("y_min"), (b["x_max"] + dx).alias("x_max"), (b["y_max"] + dy).alias("y_max"))


def touches_border(b: Column, width: Column, height: Column) -> Column:
    return (b["x_min"] <= 0) | (b["y_min"] <= 0) | (b["x_max"] >= width) | (b["y_max"] >= height)


_MATCH = "bound double, image_id string, detection_id string, gt_id string, iou double, confidence double, status string"


def _overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def _greedy(bounds: list[float]):
    def one(image: str, found: list, truth: list) -> Iterator[tuple]:
        over = [[_overlap(box, other) for _, other in truth] for _, box, _ in found]
        for bound in bounds:
            free = [True] * len(truth)
            for (name, _, confidence), row in zip(found, over, strict=True):
                best, value = -1, 0.0
                for k, v in enumerate(row):
                    if free[k] and v > value:
                        best, value = k, v
                if best >= 0 and value >= bound:
                    free[best] = False
                    yield bound, image, name, truth[best][0], value, confidence, "TP"
                else:
                    yield bound, image, name, None, 0.0, confidence, "FP"
            for (g, _), left in zip(truth, free, strict=True):
                if left:
                    yield bound, image, None, g, 0.0, None, "MISSED"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image, found, truth, out = None, [], [], []
        for pdf in batches:
            for name, side, key, conf, *box in pdf.itertuples(index=False):
                if name != image:
                    out += one(image, found, truth) if image is not None else ()
                    image, found, truth = name, [], []
                if side == 0:
                    truth.append((key, tuple(box)))
                else:
                    found.append((key, tuple(box), conf))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        out += one(image, found, truth) if image is not None else ()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return rows


_COLUMNS = [part.split()[0] for part in _MATCH.split(", ")]


def match_boxes(detections: DataFrame, truths: DataFrame, bound: float | list[float] = 0.5) -> DataFrame:
    """(bound, image_id, detection_id, gt_id, iou, confidence, status): greedy one-to-one matching.

    Within an image detections go by falling confidence and take the unused truth of the
    largest overlap if it reaches ``bound``; ties go to the smaller id. Several bounds are
    matched in one pass, the overlaps of an image computed once. Both sides are
    brought together by image and sorted in one exchange, and images stream through a task
    one after the other, so what it holds is the boxes of one image. Rows without an image
    or id are left out; boxes that share an id are boxes of their own.
    """
    box = ["x_min", "y_min", "x_max", "y_max"]
    g = truths.where("gt_id is not null").select("image_id", F.lit(0).alias("side"), F.col("gt_id").alias("key"), F.lit(None).cast("double").alias("confidence"), *box)
    d = detections.where("detection_id is not null").select("image_id", F.lit(1).alias("side"), F.col("detection_id").alias("key"), "confidence", *box)
    both = g.unionByName(d).where("image_id is not null")
    ordered = both.repartition("image_id").sortWithinPartitions("image_id", "side", F.desc_nulls_last("confidence"), "key")
    return ordered.mapInPandas(_greedy([float(b) for b in bound] if isinstance(bound, list) else [float(bound)]), _MATCH)


def precision_recall(matches: DataFrame) -> DataFrame:
    """One row (tp, fp, missed, precision, recall)."""
    c = matches.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("TP", "tp"), ("FP", "fp"), ("MISSED", "missed"))])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("missed")))


def average_precision(matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap): area under the envelope of precision over recall, detections of one confidence together.

    Counts by confidence are summed downwards, and the envelope is taken upwards, range by
    range of the confidences, so no task orders them all.
    """
    truth = matches.where("status != 'FP'").groupBy(*by).agg(F.count("*").alias("n_truth"))
    counts = matches.where("status != 'MISSED'").groupBy(*by, "confidence").agg(F.count_if(F.col("status") == "TP").alias("tp"), F.count("*").alias("n"))
    run = by_range(counts.withColumn("down", -F.col("confidence")), ["down"])
    for c in ("tp", "n"):
        run = running_total(run, by, "piece", ["down"], F.col(c), f"{c}_above")
    run = run.join(F.broadcast(truth), by) if by else run.crossJoin(F.broadcast(truth))
    p = (F.col("tp_above") + F.col("tp")) / (F.col("n_above") + F.col("n"))
    run = running_most(run.withColumn("up", -F.col("piece")), by, "up", ["confidence"], p, "env")
    return run.groupBy(*by).agg(F.sum(F.col("tp") / F.col("n_truth") * F.col("env")).alias("ap"))


def threshold_sweep(detections: DataFrame, truths: DataFrame, bounds: list[float], overlap: float = 0.5) -> DataFrame:
    """(score_bound, tp, fp, missed, precision, recall, f1, best): detections at or above each score bound.

    Greedy matching takes detections by falling confidence, so what a bound leaves out comes
    last and changes no earlier match: one matching serves all bounds. The best bound is
    that of the largest F1, then recall, then the smallest.
    """
    m = match_boxes(detections, truths, overlap)
    counts = m.where("status != 'MISSED'").select(F.explode(F.array(*[F.lit(float(b)) for b in bounds])).alias("score_bound"), "confidence", "status")
    kept = F.coalesce(F.col("confidence") >= F.col("score_bound"), F.lit(False))
    c = counts.groupBy("score_bound").agg(F.count_if(kept & (F.col("status") == "TP")).alias("tp"), F.count_if(kept & (F.col("status") == "FP")).alias("fp"))
    c = c.crossJoin(F.broadcast(truths.where("gt_id is not null and image_id is not null").agg(F.count("*").alias("n")))).withColumn("missed", F.col("n") - F.col("tp")).drop("n")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("missed")))
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    top = c.agg(F.max(F.struct("f1", "recall", (-F.col("score_bound")).alias("b"))).alias("t")).select((-F.col("t.b")).alias("top"))
    return c.crossJoin(F.broadcast(top)).withColumn("best", F.col("score_bound") == F.col("top")).drop("top")
