"""Bootstrap intervals, drawn where the rows lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import metrics
from quillon.operators.prefix import by_range
from quillon.session import cut

REPLICATES = 200
SEED = 37
_ROWS_AT_ONCE = 2_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(13)])


def poisson_weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row is drawn in each replicate, rows x replicates: Poisson(1) by a hash of row and replicate.

    A row has the same weights wherever and whenever they are drawn, so two scores of one
    row stay paired without moving together.
    """
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(replicates) + np.arange(replicates, dtype=np.uint64)[None, :]
        x = (x + np.uint64(seed)) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(float) / 2.0**53, side="right").astype(np.int64)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), _ROWS_AT_ONCE):
            yield pdf.iloc[at : at + _ROWS_AT_ONCE]


def _sums(replicates: int, seed: int):
    """One row a partition sorted by score: weights of both sides, and pairs a positive wins in it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, n, won = (np.zeros(replicates) for _ in range(3))
        tie, last, piece = np.zeros((2, replicates)), None, None
        for pdf in _slices(batches):
            piece = int(pdf["piece"].iloc[0])
            w, y, s = poisson_weights(pdf["id"].to_numpy(), replicates, seed), pdf["y"].to_numpy(), pdf["s"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            pos, neg = (np.add.reduceat(w * (y == k)[:, None], start, axis=0).astype(float) for k in (1, 0))
            if last is not None and s[0] == last:
                pos[0] += tie[0]
                neg[0] += tie[1]
            elif last is not None:
                pos, neg = np.vstack([tie[:1], pos]), np.vstack([tie[1:], neg])
            tie, last = np.stack([pos[-1], neg[-1]]), s[-1]
            pos, neg = pos[:-1], neg[:-1]
            below = n + np.cumsum(neg, axis=0) - neg
            won += (pos * (below + neg / 2)).sum(axis=0)
            p, n = p + pos.sum(axis=0), n + neg.sum(axis=0)
        if last is not None:
            won += tie[0] * (n + tie[1] / 2)
            yield pd.DataFrame({"piece": [piece], "p": [p + tie[0]], "n": [n + tie[1]], "won": [won]})

    return rows


def _at_ranks(replicates: int, seed: int, before: dict[int, np.ndarray], ranks: np.ndarray):
    """One row a partition: the positive scores at the wanted ranks that lie in it, else NaN."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, seen = np.full(ranks.shape, np.nan), None
        for pdf in _slices(batches):
            if seen is None:
                seen = before[int(pdf["piece"].iloc[0])].copy()
            pdf = pdf[pdf["y"] == 1]
            if not len(pdf):
                continue
            upto = seen + np.cumsum(poisson_weights(pdf["id"].to_numpy(), replicates, seed), axis=0)
            for k, rank in enumerate(ranks):
                here = (seen <= rank) & (rank < upto[-1])
                if here.any():
                    found[k, here] = pdf["s"].to_numpy()[(upto[:, here] > rank[here]).argmax(axis=0)]
            seen = upto[-1]
        yield pd.DataFrame({"found": [found.ravel()]})

    return rows


def _above(replicates: int, seed: int, bound: np.ndarray):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(replicates)
        for pdf in _slices(batches):
            pdf = pdf[pdf["y"] == 0]
            n += (poisson_weights(pdf["id"].to_numpy(), replicates, seed) * (pdf["s"].to_numpy()[:, None] > bound)).sum(axis=0)
        yield pd.DataFrame({"n": [n]})

    return rows


def replicated_metrics(rows: DataFrame, replicates: int = REPLICATES, seed: int = SEED, tpr: float = 0.95) -> dict[str, np.ndarray]:
    """AUROC and FPR at ``tpr`` of every replicate of ``rows`` (id, y, s); NaN where a side is empty.

    Rows are ordered range by range and weighted where they lie, in three passes: sums of
    the pairs won, scores at the quantile of the positives, negatives above it. A partition
    returns a few numbers a replicate, whatever its size; rows never reach the driver.
    """
    placed = by_range(rows.where("y is not null and s is not null and not isnan(s)"), ["s"]).sortWithinPartitions("s")
    parts = sorted(placed.mapInPandas(_sums(replicates, seed), "piece int, p array<double>, n array<double>, won array<double>").collect(), key=lambda r: r["piece"])
    p, n, won = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
    before = {}
    for r in parts:
        before[r["piece"]] = p.copy()
        won += np.array(r["won"]) + np.array(r["p"]) * n
        p, n = p + np.array(r["p"]), n + np.array(r["n"])
    with np.errstate(divide="ignore", invalid="ignore"):
        auroc = np.where(p * n > 0, won / (p * n), np.nan)
    place = (1 - tpr) * np.maximum(p - 1, 0)
    ranks = np.stack([np.floor(place), np.ceil(place)])
    got = placed.mapInPandas(_at_ranks(replicates, seed, before, ranks), "found array<double>").collect()
    ends = np.full(ranks.shape, np.nan)
    for r in got:
        one = np.array(r["found"], dtype=float).reshape(ranks.shape)  # NaN comes back from Arrow as null
        ends = np.where(np.isnan(one), ends, one)
    bound = ends[0] + (ends[1] - ends[0]) * (place - ranks[0])
    above = sum((np.array(r["n"]) for r in placed.mapInPandas(_above(replicates, seed, bound), "n array<double>").collect()), np.zeros(replicates))
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"auroc": auroc, "fpr95": np.where(p * n > 0, above / n, np.nan)}


def _interval(name: str, estimate: float | None, drawn: np.ndarray) -> tuple:
    kept = drawn[np.isfinite(drawn)]
    low, high = (float(np.quantile(kept, q)) for q in (0.025, 0.975)) if len(kept) else (None, None)
    return name, estimate, low, high, int(len(kept))


_RESULT = "metric string, estimate double, lower double, upper double, n_replicates bigint"


def _estimates(rows: DataFrame) -> dict[str, float | None]:
    counts = metrics.score_counts(rows, [], F.col("y") == 1, F.col("s"))
    first = lambda df, c: (df.first() or {c: None})[c]
    return {"auroc": first(metrics.auroc(counts, []), "auroc"), "fpr95": first(metrics.fpr_of_counts(counts, []), "fpr")}


def bootstrap_open(rows: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(metric, estimate, lower, upper, n_replicates) of AUROC and FPR at 95 % over ``rows`` (y, s).

    Rows are drawn by Poisson weights, the form of the bootstrap that needs no row count.
    Replicates with one class only are skipped. Quantiles are linear at 2.5 and 97.5 %.
    """
    kept = cut(rows.select("y", "s").withColumn("id", F.monotonically_increasing_id()))
    drawn, estimate = replicated_metrics(kept, replicates, seed), _estimates(kept)
    return rows.sparkSession.createDataFrame([_interval(k, estimate[k], v) for k, v in drawn.items()], _RESULT)


def bootstrap_deltas(rows: DataFrame, base: str, candidates: list[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(candidate, metric, estimate, lower, upper, n_replicates) of each candidate score less the base.

    ``rows`` holds y, 1 for unknown, and the scores. All scores of a row carry the same
    weights, so the differences are paired; each score is replicated once, the base for all
    candidates. See ``bootstrap_open``.
    """
    kept = cut(rows.select("y", base, *candidates).withColumn("id", F.monotonically_increasing_id()))

    def side(c: str) -> tuple[dict, dict]:
        s = kept.select("id", "y", F.col(c).alias("s"))
        return replicated_metrics(s, replicates, seed), _estimates(s)

    drawn, at = side(base)
    less = lambda x, y: None if x is None or y is None else y - x
    out = []
    for c in candidates:
        other, there = side(c)
        out += [(c, *_interval(k, less(at[k], there[k]), other[k] - drawn[k])) for k in drawn]
    return rows.sparkSession.createDataFrame(out, "candidate string, " + _RESULT)


def bootstrap_delta(rows: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(metric, estimate, lower, upper, n_replicates) of ``b`` less ``a`` over ``rows`` (y, a, b)."""
    return bootstrap_deltas(rows, "a", ["b"], replicates, seed).drop("candidate")


def bootstrap_macro_f1(rows: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(metric, estimate, lower, upper, n_replicates) of the macro-F1 of (truth, given) over the labels of ``truth``.

    Drawing n of n rows draws the cells of the confusion matrix multinomially, so only the
    cells, at most one a pair of labels, are gathered.
    """
    cells = rows.where("truth is not null").groupBy("truth", "given").agg(F.count("*").alias("n")).collect()
    labels = sorted({r["truth"] for r in cells})
    place = {x: i for i, x in enumerate(labels)}
    t, g = np.array([place[r["truth"]] for r in cells], dtype=int), np.array([place.get(r["given"], len(labels)) for r in cells], dtype=int)
    k, counts = len(labels), np.array([r["n"] for r in cells], dtype=float)

    def f1(c: np.ndarray) -> float:
        support, given, right = np.bincount(t, c, k), np.bincount(g, c, k + 1)[:k], np.bincount(t[t == g], c[t == g], k)
        return float(np.mean(np.where(support + given > 0, 2 * right / np.maximum(support + given, 1), 0.0)))

    spark = rows.sparkSession
    if not cells:
        return spark.createDataFrame([("closed_macro_f1", None, None, None, 0)], _RESULT)
    rng = np.random.default_rng(seed)
    drawn = rng.multinomial(int(counts.sum()), counts / counts.sum(), size=replicates)
    return spark.createDataFrame([_interval("closed_macro_f1", f1(counts), np.array([f1(c.astype(float)) for c in drawn]))], _RESULT)
