"""Samples with given category shares by the cube method, flown per block and merged upward."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import normalize_label
from quillon.session import cut, small_side

BLOCK_ROWS = 20_000
FAN_IN = 32
SEED = 13
_EPS = 1e-9
_UNIT = "plan_id int, category long, block long, sample_id string, pi double"


def null_vector(a: np.ndarray) -> np.ndarray | None:
    """A vector u != 0 with a @ u = 0, or None if the columns of ``a`` are independent."""
    _, s, vt = np.linalg.svd(a, full_matrices=True)
    rank = int((s > 1e-10 * max(1.0, s[0] if len(s) else 0.0)).sum())
    return vt[-1] if rank < a.shape[1] else None


def _step(pi: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """One move of the cube along ``u`` to a face; expectations stay as they were."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - pi) / u, np.where(u < 0, -pi / u, np.inf)).min()
        down = np.where(u > 0, pi / u, np.where(u < 0, (pi - 1) / u, np.inf)).min()
    moved = pi + up * u if draw * (up + down) < down else pi - down * u
    return np.where(moved < _EPS, 0.0, np.where(moved > 1 - _EPS, 1.0, moved))


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: probabilities moved to 0 or 1 while every ``x.T @ pi`` is kept.

    Records enter a window one by one. Two records with equal rows in ``x`` have the null
    vector (1, -1) between them and are moved at once; a window with more records than
    balancing variables has some null vector, found by decomposition. What remains cannot
    move without changing a balance: at most one record a distinct row, and no more
    records than variables.
    """
    pi = pi.astype(float).copy()
    keys = [r.tobytes() for r in np.ascontiguousarray(x)]
    waiting: dict[bytes, int] = {}
    draws = rng.random(2 * len(pi) + 8)
    used = 0
    p = x.shape[1]
    for i in range(len(pi)):
        b = pi[i]
        if b <= _EPS or b >= 1 - _EPS:
            pi[i] = 0.0 if b <= _EPS else 1.0
            continue
        key = keys[i]
        j = waiting.pop(key, None)
        if j is None:
            waiting[key] = i
        else:
            a = pi[j]
            total = a + b
            draw = draws[used % len(draws)]
            used += 1
            if total <= 1:
                win = draw * total < a
                a, b = (total, 0.0) if win else (0.0, total)
            else:
                win = draw * (2 - total) < 1 - b
                a, b = (1.0, total - 1) if win else (total - 1, 1.0)
            pi[j], pi[i] = a, b
            left = j if _EPS < a < 1 - _EPS else i if _EPS < b < 1 - _EPS else None
            for k in (j, i):
                if k != left:
                    pi[k] = round(pi[k])
            if left is not None:
                waiting[key] = left
        while len(waiting) > p:
            window = list(waiting.values())
            u = null_vector(x[window].T.astype(float))
            pi[window] = _step(pi[window], u, rng.random())
            for k in window:
                if pi[k] in (0.0, 1.0):
                    waiting.pop(keys[k], None)
    window = list(waiting.values())
    while window:
        u = null_vector(x[window].T.astype(float))
        if u is None:
            break
        pi[window] = _step(pi[window], u, rng.random())
        window = [k for k in window if 0.0 < pi[k] < 1.0]
    return pi


def landing(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Resolve what a flight left by dropping balancing variables, the last one first."""
    pi = pi.astype(float).copy()
    for p in range(x.shape[1], -1, -1):
        open_ = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))
        while len(open_):
            u = null_vector(x[open_, :p].T.astype(float)) if p else np.eye(1, len(open_)).ravel()
            if u is None:
                break
            pi[open_] = _step(pi[open_], u, rng.random())
            open_ = open_[(pi[open_] > _EPS) & (pi[open_] < 1 - _EPS)]
    return np.round(pi)


def category_flight(pi: np.ndarray, category: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase on the indicators of ``category``, given as numbers.

    Two open records of one category have the null vector (1, -1) between them. In each
    round the open records of every category are paired in order and all pairs move at
    once, each to a face of its square, so at least one of the two is resolved; when no
    category has two open records, nothing can move without changing a balance. The
    indicators themselves are never built.
    """
    pi = np.where(pi <= _EPS, 0.0, np.where(pi >= 1 - _EPS, 1.0, pi.astype(float)))
    order = np.argsort(category, kind="stable")
    while True:
        open_ = order[(pi[order] > 0) & (pi[order] < 1)]
        c = category[open_]
        new = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, dtype=bool)
        place = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0)) if len(c) else np.zeros(0, dtype=int)
        at = np.flatnonzero((place[1:] % 2 == 1) & ~new[1:]) if len(c) else []
        if not len(at):
            return pi
        i, j = open_[at], open_[at + 1]
        a, b = pi[i], pi[j]
        total = a + b
        low = total <= 1
        first = rng.random(len(at)) * np.where(low, total, 2 - total) < np.where(low, a, 1 - b)
        more, less = np.where(low, total, 1.0), np.where(low, 0.0, total - 1)
        for k, v in ((i, np.where(first, more, less)), (j, np.where(first, less, more))):
            pi[k] = np.where(v <= _EPS, 0.0, np.where(v >= 1 - _EPS, 1.0, v))


def category_landing(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Resolve what a category flight left: the indicators are dropped, the constant is kept.

    So the size of the sample stays as planned up to the last open record, which is drawn.
    """
    pi = category_flight(pi, np.zeros(len(pi), dtype=int), rng)
    return np.where((pi > 0) & (pi < 1), (rng.random(len(pi)) < pi).astype(float), pi)


def _rng(seed: int, plan: int, level: int, block: int) -> np.random.Generator:
    return np.random.default_rng([seed & 0xFFFFFFFF, plan & 0xFFFFFFFF, level, block & 0xFFFFFFFFFFFF])


def _fly(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id", kind="stable", ignore_index=True)
        plan, number = int(pdf["plan_id"].iloc[0]), int(pdf["block"].iloc[0])
        rng = _rng(seed, plan, level, number)
        pdf = pdf.iloc[rng.permutation(len(pdf))].reset_index(drop=True)
        pi = category_flight(pdf["pi"].to_numpy(), pdf["category"].to_numpy(), rng)
        pdf["pi"] = category_landing(pi, rng) if last else pi
        return pdf[pdf["pi"] > 0]

    return block


def sample_quotas(sized: DataFrame) -> DataFrame:
    """``sized`` with ``quota``: how many records of each category a plan draws.

    A category gives ``needed`` records, or all it has (``n``) where those are fewer. What
    a plan then lacks because of such shortages, up to its sample_size, is handed on to the
    categories with records to spare, in proportion to their fractions and never beyond
    what they have. The parts are made whole numbers by rounding their running sum, so the
    plan's total is kept. Only targets are ordered here, never records.
    """
    plan = Window.partitionBy("plan_id")
    names = Window.partitionBy("plan_id").orderBy("label", "status")
    base = F.least("n", "needed")
    short = F.sum(F.col("needed") - F.col("base")).over(plan)
    q = sized.withColumn("base", base).withColumn("spare", F.when(F.col("fraction") > 0, F.col("n") - F.col("base")).otherwise(0))
    q = q.withColumn("open", F.greatest(F.lit(0).cast("bigint"), F.least(short, F.max("sample_size").over(plan) - F.sum("base").over(plan))))
    order = plan.orderBy(F.col("spare") / F.col("fraction"), "label", "status")
    giving = q.where("spare > 0")
    level = (F.col("open") - F.coalesce(F.sum("spare").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("fraction").over(order.rowsBetween(0, Window.unboundedFollowing))
    giving = giving.withColumn("level", level).withColumn("full", F.col("spare") < F.col("fraction") * F.col("level"))
    met = F.max(F.when(~F.col("full"), F.col("level"))).over(plan)
    giving = giving.withColumn("met", met)
    more = F.when(F.col("full") | F.col("met").isNull(), F.col("spare").cast("double")).otherwise(F.col("fraction") * F.col("met"))
    giving = giving.withColumn("more", more).withColumn("upto", F.sum("more").over(names.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.floor(F.col("upto") + 1e-6) - F.floor(F.coalesce(F.lag("upto").over(names), F.lit(0.0)) + 1e-6)
    added = giving.select("plan_id", "category", whole.alias("added"))
    out = q.join(added, ["plan_id", "category"], "left")
    return out.withColumn("quota", F.col("base") + F.coalesce("added", F.lit(0))).drop("base", "spare", "open", "added")


def resolved_targets(targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Targets with labels after N and alias, statuses after N, a category number and needs.

    ``needed`` is the larger of min_rows and target_fraction times sample_size rounded up
    (products within 1e-9 above a whole number count as it); ``desired`` is the larger of
    min_rows and the product itself. Nulls in min_rows, the fraction or the size are 0.
    Targets with the same plan, label and status become one with the largest numbers.
    """
    named = canonical(targets, aliases).where("plan_id is not null")
    share = F.coalesce(F.col("target_fraction"), F.lit(0.0)) * F.coalesce(F.col("sample_size"), F.lit(0))
    least = F.coalesce(F.col("min_rows"), F.lit(0))
    return (
        named.groupBy("plan_id", "label", "status")
        .agg(
            F.max(F.greatest(least, F.ceil(share - F.lit(_EPS)))).alias("needed"), F.max(F.greatest(least.cast("double"), share)).alias("desired"),
            F.max(F.coalesce(F.col("target_fraction"), F.lit(0.0))).alias("fraction"), F.max(F.coalesce(F.col("sample_size"), F.lit(0))).alias("sample_size"),
        )
        .withColumn("category", F.xxhash64("label", "status"))
    )


def canonical(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` with ``label`` (canonical_label after N, then alias) and ``status`` (N)."""
    names = (
        aliases.select(normalize_label(F.col("alias")).alias("__alias"), normalize_label(F.col("canonical_label")).alias("__name"))
        .groupBy("__alias")
        .agg(F.min("__name").alias("__name"))
    )
    raw = df.withColumn("__raw", normalize_label(F.col("canonical_label")))
    return (
        raw.join(small_side(names), F.col("__raw") == F.col("__alias"), "left")
        .withColumn("label", F.coalesce("__name", "__raw"))
        .withColumn("status", normalize_label(F.col("known_status")))
        .drop("__raw", "__alias", "__name")
    )


def balanced_sample(
    manifest: DataFrame, targets: DataFrame, aliases: DataFrame, seed: int = SEED, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every plan of ``targets``.

    ``sample`` is (plan_id, label, status, sample_id); ``report`` has one row a target with
    available, needed, desired, selected, residual (selected less desired) and short: the
    draw fell under needed and, checked exactly, available is under needed. A sample_id
    with contradictory rows is available to each of its categories but is drawn at most
    once a plan: for a category that could miss its needs by losing such records, else for
    the one with the least to spare.

    Inclusion probabilities are a category's quota (``sample_quotas``) over its records.
    Units are hashed into blocks of about ``block_rows``, whatever their category, so no
    category forms a task of its own; a flight balanced on the category indicators runs in
    each block and leaves at most one unresolved unit a category. Those merge upward,
    FAN_IN blocks into one, until a plan has one block, where the landing resolves the
    rest. Nothing but resolved units leaves a block, and the same seed gives the same
    sample.

    Labels after N and alias and statuses after N are compared; rows with null or blank
    sample_id or without a wanted label are left out. Targets nobody has appear in the
    report with zeros. Empty tables give empty results.
    """
    wanted = cut(resolved_targets(targets, aliases))
    have = (
        canonical(manifest.select("sample_id", "canonical_label", "known_status"), aliases)
        .where("trim(sample_id) != ''")
        .select("sample_id", "label", "status")
        .distinct()
    )
    units = cut(have.join(small_side(wanted.select("plan_id", "category", "label", "status")), ["label", "status"]))
    available = units.groupBy("plan_id", "label", "status").agg(F.count("*").alias("available"))
    counted = cut(wanted.join(available, ["plan_id", "label", "status"], "left").fillna(0, ["available"]))
    grouped = cut(units.groupBy("plan_id", "sample_id").agg(F.collect_list("category").alias("of")))
    several = grouped.where(F.size("of") > 1).select("plan_id", "sample_id", F.explode("of").alias("category"))
    shared = several.groupBy("plan_id", "category").agg(F.count("*").alias("shared"))
    slack = F.col("available") - F.col("needed")
    at_risk = (slack >= 0) & (slack < F.coalesce("shared", F.lit(0)))
    wants = counted.join(shared, ["plan_id", "category"], "left").select(
        "plan_id", "category", F.struct(F.when(at_risk, 0).otherwise(1).alias("last"), slack.alias("slack"), "label", "status", "category").alias("want")
    )
    picked = several.join(small_side(wants), ["plan_id", "category"]).groupBy("plan_id", "sample_id").agg(F.min("want").alias("w"))
    alone = grouped.where(F.size("of") == 1).select("plan_id", "sample_id", F.get("of", 0).alias("category"))
    drawable = cut(alone.union(picked.select("plan_id", "sample_id", "w.category")))
    left = drawable.groupBy("plan_id", "category").agg(F.count("*").alias("n"))
    sized = cut(sample_quotas(counted.join(left, ["plan_id", "category"], "left").fillna(0, ["n"])))
    sizes = drawable.groupBy("plan_id").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    most = sizes.agg(F.max("blocks")).first()[0] or 1
    block = F.pmod(F.xxhash64("sample_id", "plan_id", F.lit(seed)), F.col("blocks"))
    flying = (
        drawable.join(small_side(sized.where("quota > 0").select("plan_id", "category", "quota", "n")), ["plan_id", "category"])
        .join(small_side(sizes), "plan_id")
        .select("plan_id", "category", block.alias("block"), "sample_id", (F.col("quota") / F.col("n")).alias("pi"))
    )
    level, chosen = 0, None
    while True:
        flown = cut(flying.groupBy("plan_id", "block").applyInPandas(_fly(seed, level, most <= 1), _UNIT))
        sure = flown.where("pi >= 1").select("plan_id", "category", "sample_id")
        chosen = sure if chosen is None else chosen.unionByName(sure)
        if most <= 1:
            break
        most = -(-most // FAN_IN)
        flying = flown.where("pi < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
        level += 1
    names = wanted.select("plan_id", "category", "label", "status")
    sample = chosen.join(small_side(names), ["plan_id", "category"]).select("plan_id", "label", "status", "sample_id")
    taken = chosen.groupBy("plan_id", "category").agg(F.count("*").alias("selected"))
    report = (
        sized.join(taken, ["plan_id", "category"], "left")
        .fillna(0, ["selected"])
        .select(
            "plan_id", "label", "status", "available", "needed", "desired", "selected",
            (F.col("selected") - F.col("desired")).alias("residual"), ((F.col("selected") < F.col("needed")) & (F.col("available") < F.col("needed"))).alias("short"),
        )
    )
    return sample, report
