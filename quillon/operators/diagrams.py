"""Persistence diagrams as arrays of (birth, death): vectors, curves and summaries.

An essential bar has an infinite death. Finite bars are those with finite ends and death
at or after birth; other bars are left out of everything that needs a length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillon.functions.vec import let, total

INF = float("inf")
DENSE_CELLS = 250_000
CELLS_AT_ONCE = 2_000_000
STEPS_AT_ONCE = 200_000


def finite_bars(bars: Column) -> Column:
    ok = lambda b: ~F.isnan(b["birth"]) & ~F.isnan(b["death"]) & (F.abs(b["birth"]) != INF) & (b["death"] != INF) & (b["death"] >= b["birth"])
    return F.filter(bars, ok)


def essential_count(bars: Column) -> Column:
    return F.size(F.filter(bars, lambda b: b["death"] == INF))


def lengths(bars: Column) -> Column:
    return F.transform(finite_bars(bars), lambda b: b["death"] - b["birth"])


def entropy(bars: Column) -> Column:
    """Entropy of the bar lengths as shares of their sum; 0 without bars of positive length."""
    share = lambda v, s: F.transform(F.filter(v, lambda x: x > 0), lambda x: -(x / s) * F.log(F.greatest(x / s, F.lit(1e-12))))
    return let(lengths(bars), lambda v: let(total(v), lambda s: F.when(s > 0, total(share(v, s))).otherwise(0.0)))


def betti_curve(bars: Column, grid: Column) -> Column:
    """Bars alive at each grid point: birth <= t < death; essential bars never die."""
    return F.transform(grid, lambda t: F.size(F.filter(bars, lambda b: (b["birth"] <= t) & (t < b["death"]))))


def fitted_grid(df: DataFrame, bars: str, points: int = 16) -> DataFrame:
    """One row (grid): ``points`` even steps from the least to the largest end of the finite bars of ``df``.

    The ends are two aggregates; without bars the grid spans 0 to 1, and a grid of no width gets width 1.
    """
    ends = df.select(F.explode(finite_bars(F.col(bars))).alias("x")).agg(F.coalesce(F.min("x.birth"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("x.death"), F.lit(1.0)).alias("hi"))
    wide = ends.withColumn("hi", F.when(F.col("hi") - F.col("lo") < 1e-12, F.col("lo") + 1.0).otherwise(F.col("hi")))
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    return wide.select(F.transform(steps, lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / (points - 1))).alias("grid"))


def landscape(bars: Column, grid: Column, levels: int = 3) -> Column:
    """The ``levels`` highest tents at each grid point, level by level, padded with zeros."""
    tent = lambda b, t: F.greatest(F.lit(0.0), F.least(t - b["birth"], b["death"] - t))
    at = lambda v, t: F.sort_array(F.transform(v, lambda b: tent(b, t)), asc=False)
    rows = let(finite_bars(bars), lambda v: F.transform(grid, lambda t: at(v, t)))

    def level(k: int) -> Column:
        return F.transform(rows, lambda r: F.coalesce(F.get(r, k), F.lit(0.0)))

    return F.flatten(F.array(*[level(k) for k in range(levels)]))


def weighted_histogram(bars: Column, low: Column, high: Column, tall: Column, size: int = 8, short: Column | None = None) -> Column:
    """Sums of length over ``size`` x ``size`` cells of (birth, length), row by birth.

    Cells are half-open, the last of each axis closed; bars outside the bounds are dropped.
    """
    cell = lambda x, lo, hi: F.when((x < lo) | (x > hi) | (hi <= lo), -1).otherwise(F.least(F.floor((x - lo) / (hi - lo) * size), F.lit(size - 1)))
    placed = F.transform(finite_bars(bars), lambda b: F.struct(cell(b["birth"], low, high).alias("i"), cell(b["death"] - b["birth"], F.lit(0.0) if short is None else short, tall).alias("j"), (b["death"] - b["birth"]).alias("w")))
    cells = F.array(*[F.lit(k) for k in range(size * size)])
    here = lambda p, k: (p["i"] >= 0) & (p["j"] >= 0) & (p["i"] * size + p["j"] == k)
    return let(placed, lambda v: F.transform(cells, lambda k: total(F.transform(F.filter(v, lambda p: here(p, k)), lambda p: p["w"]))))


@dataclass(frozen=True)
class Vectorizers:
    """What ``fit_vectorizers`` learnt, one row of it, and where each component lies in the features."""

    fitted: DataFrame
    slices: dict[str, tuple[int, int]]


def fit_vectorizers(train: DataFrame, bars: str, points: int = 16, levels: int = 3, size: int = 8) -> Vectorizers:
    """Grid and bounds of entropy, Betti curve, landscape and image from the finite bars of ``train``.

    Both are aggregates over the bars, one row in all; nothing else is learnt.
    """
    flat = train.select(F.explode(finite_bars(F.col(bars))).alias("x")).select("x.birth", (F.col("x.death") - F.col("x.birth")).alias("length"))
    ends = flat.agg(*[f(c).alias(f"{c}_{n}") for c in ("birth", "length") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    for c in ("birth", "length"):
        ends = ends.withColumn(f"{c}_lo", F.coalesce(f"{c}_lo", F.lit(0.0))).withColumn(f"{c}_hi", F.coalesce(f"{c}_hi", F.lit(1.0)))
        ends = ends.withColumn(f"{c}_hi", F.when(F.col(f"{c}_hi") - F.col(f"{c}_lo") < 1e-12, F.col(f"{c}_lo") + 1.0).otherwise(F.col(f"{c}_hi")))
    sizes = {"entropy": 1, "betti_curve": points, "landscape": levels * points, "image": size * size}
    slices, start = {}, 0
    for name, n in sizes.items():
        slices[name], start = (start, start + n), start + n
    return Vectorizers(fitted_grid(train, bars, points).crossJoin(ends), slices)


def vectorized(df: DataFrame, bars: str, v: Vectorizers) -> DataFrame:
    """``df`` with ``features``: the components one after the other, as ``v.slices`` says."""
    b, both = F.col(bars), df.crossJoin(F.broadcast(v.fitted))
    size = int((v.slices["image"][1] - v.slices["image"][0]) ** 0.5)
    levels = (v.slices["landscape"][1] - v.slices["landscape"][0]) // (v.slices["betti_curve"][1] - v.slices["betti_curve"][0])
    image = weighted_histogram(b, F.col("birth_lo"), F.col("birth_hi"), F.col("length_hi"), size, F.col("length_lo"))
    parts = [F.array(entropy(b)), betti_curve(finite_bars(b), F.col("grid")).cast("array<double>"), landscape(b, F.col("grid"), levels), image]
    return both.withColumn("features", F.concat(*parts)).drop(*v.fitted.columns)


def summary(bars: Column) -> Column:
    """Struct (n, total, mean, longest, entropy, n_long): long bars reach a tenth of the longest."""
    v = lengths(bars)
    return let(
        v,
        lambda x: F.struct(
            F.size(x).alias("n"), total(x).alias("total"), F.when(F.size(x) > 0, total(x) / F.size(x)).otherwise(0.0).alias("mean"), F.coalesce(F.array_max(x), F.lit(0.0)).alias("longest"),
            entropy(bars).alias("entropy"), F.size(F.filter(x, lambda y: y >= 0.1 * F.array_max(x))).alias("n_long"),
        ),
    )


@F.pandas_udf(ArrayType(DoubleType()))
def tree_deaths(points: pd.Series) -> pd.Series:
    """Deaths of the zero-dimensional bars of a point cloud under cosine distance.

    They are the edge lengths of a minimum spanning tree, grown point by point; a cloud of
    n points has n - 1 of them, ascending. Null and single clouds have none.
    """

    def one(cloud) -> list[float]:
        if cloud is None or len(cloud) < 2:
            return []
        x = np.stack([np.asarray(p, dtype=float) for p in cloud])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, seen, out = np.full(len(x), np.inf), np.zeros(len(x), dtype=bool), []
        k = 0
        for _ in range(len(x) - 1):
            seen[k] = True
            near = np.minimum(near, np.clip(1 - x @ x[k], 0, 2))
            near[seen] = np.inf
            k = int(near.argmin())
            out.append(float(near[k]))
        return sorted(out)

    return points.map(one)


@F.pandas_udf(DoubleType())
def bottleneck(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bottleneck distance of two diagrams given as arrays of (birth, death) pairs; 0 if both are empty."""
    points = lambda v: np.array([tuple(x) for x in (v if v is not None else [])], dtype=float).reshape(-1, 2)
    return pd.Series([bottleneck_of(points(x), points(y)) for x, y in zip(a, b, strict=True)], dtype=float)


def bottleneck_of(p: np.ndarray, q: np.ndarray) -> float:
    """Least t at which the bars whose half length exceeds t can be matched within t.

    Shorter bars may end at the diagonal. A matching that covers the long bars of both sides
    exists if each side's long bars can be matched to some bars of the other side
    (Mendelsohn and Dulmage), so two small one-sided matchings decide a step. Diagrams with
    more than DENSE_CELLS pairs of bars are decided without a table of all pairs.
    """
    if not len(p) + len(q):
        return 0.0
    half_p, half_q = (p[:, 1] - p[:, 0]) / 2, (q[:, 1] - q[:, 0]) / 2
    if len(p) * len(q) > DENSE_CELLS:
        return _bottleneck_of_many(p, q, half_p, half_q)
    cost = np.maximum(np.abs(p[:, None, 0] - q[None, :, 0]), np.abs(p[:, None, 1] - q[None, :, 1]))
    halves = np.concatenate([half_p, half_q])
    steps = np.unique(np.concatenate([halves, cost[cost < halves.max()]]))
    lo, hi = 0, len(steps) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        near = cost <= steps[mid]
        fits = _perfect(near[half_p > steps[mid]]) and _perfect(near.T[half_q > steps[mid]])
        lo, hi = (lo, mid) if fits else (mid + 1, hi)
    return float(steps[lo])


def _perfect(allowed: np.ndarray) -> bool:
    """Whether every row can have its own column: Hopcroft-Karp, layers by breadth, then disjoint paths."""
    near = [np.flatnonzero(r).tolist() for r in allowed]
    if len(allowed) > allowed.shape[1] or not all(near):
        return False
    mine, owner = [-1] * len(near), [-1] * allowed.shape[1]
    while True:
        layer = [0 if c < 0 else -1 for c in mine]
        free = [r for r, c in enumerate(mine) if c < 0]
        if not free:
            return True
        queue, found = list(free), False
        for r in queue:
            for c in near[r]:
                o = owner[c]
                if o < 0:
                    found = True
                elif layer[o] < 0:
                    layer[o] = layer[r] + 1
                    queue.append(o)
        if not found:
            return False
        rest = [iter(x) for x in near]
        for root in free:
            rows, columns = [root], []
            while rows:
                r = rows[-1]
                c = next((c for c in rest[r] if owner[c] < 0 or layer[owner[c]] == layer[r] + 1), None)
                if c is None:
                    rows.pop()
                    if columns:
                        columns.pop()
                    continue
                columns.append(c)
                if owner[c] >= 0:
                    rows.append(owner[c])
                    continue
                for x, y in zip(rows, columns, strict=True):
                    mine[x], owner[y] = y, x
                break


def _bottleneck_of_many(p: np.ndarray, q: np.ndarray, half_p: np.ndarray, half_q: np.ndarray) -> float:
    """``bottleneck_of`` with room for the bars, not for their pairs.

    The distance is a half length or a difference of two births or two deaths. A bisection
    by value runs until few of these lie between its ends, which are then tried themselves.
    """
    p, half_p, q, half_q = *_by_death(p, half_p), *_by_death(q, half_q)
    sides = _Side(p, q, half_p), _Side(q, p, half_q)
    ends = [(np.unique(p[:, i]), np.unique(q[:, i])) for i in (0, 1)]
    halves = np.unique(np.concatenate([half_p, half_q]))
    lo, hi = -1.0, float(halves[-1])
    while (steps := _steps(ends, halves, lo, hi)) is None:
        mid = lo + (hi - lo) / 2
        if not lo < mid < hi:
            return hi
        lo, hi = (lo, mid) if all(s.fits(mid) for s in sides) else (mid, hi)
    lo, hi = 0, len(steps) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if all(s.fits(steps[mid]) for s in sides) else (mid + 1, hi)
    return float(steps[lo])


def _by_death(p: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((p[:, 0], -p[:, 1]))
    return p[order], half[order]


def _steps(ends: list, halves: np.ndarray, lo: float, hi: float) -> np.ndarray | None:
    """The possible distances above ``lo`` and up to ``hi``, ascending; None if they are too many to list."""
    spans, slack = [], 1e-9 * (1 + max(abs(x).max() for e in ends for x in e))
    for a, b in ends:
        for one, other in ((-hi, hi),) if lo < 0 else ((-hi, -lo), (lo, hi)):
            spans.append((a, b, np.searchsorted(b, a + one - slack), np.searchsorted(b, a + other + slack, side="right")))
    if sum(int((to - at).sum()) for _, _, at, to in spans) > max(STEPS_AT_ONCE, 8 * sum(len(x) for e in ends for x in e)):
        return None
    found = [halves]
    for a, b, at, to in spans:
        n = to - at
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
        found.append(np.abs(np.repeat(a, n) - b[j]))
    v = np.concatenate(found)
    return np.unique(v[(lo < v) & (v <= hi)])


class _Side:
    """Matches the long bars of ``rows`` to bars of ``columns``, both by falling death; what was matched is kept for the next try."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, half: np.ndarray):
        self.rows, self.columns, self.half = rows, columns, half
        self.mine = np.where(np.arange(len(rows)) < len(columns), np.arange(len(rows)), -1)

    def fits(self, t: float) -> bool:
        """Whether every bar of half length above ``t`` can have its own column within ``t``."""
        long, have = self.half > t, self.mine >= 0
        if self._too_few(self.rows[long], t):
            return False
        have[have] = np.abs(self.rows[have] - self.columns[self.mine[have]]).max(axis=1) <= t
        mine = np.where(long & have, self.mine, -1)
        owner = np.full(len(self.columns), -1)
        owner[mine[mine >= 0]] = np.flatnonzero(mine >= 0)
        for r in np.flatnonzero(long & (mine < 0)):
            free = np.flatnonzero(owner < 0)
            near = (np.abs(self.columns[free] - self.rows[r]) <= t).all(axis=1)
            if near.any():
                c = free[near.argmax()]
                mine[r], owner[c] = c, r
        good = True
        while good and len(left := np.flatnonzero(long & (mine < 0))):
            good = self._augment(left, mine, owner, t)
        self.mine = mine
        return good

    def _too_few(self, rows: np.ndarray, t: float) -> bool:
        """Whether more rows lie beyond some birth or death than columns within ``t`` of there: then no matching is sought."""
        for i in (0, 1):
            x, y, n = np.sort(rows[:, i]), np.sort(self.columns[:, i]), np.arange(len(rows))
            wide = t + 1e-9 * (1 + np.abs(x))
            above, below = len(y) - np.searchsorted(y, x - wide), np.searchsorted(y, x + wide, side="right")
            if (above < len(rows) - n).any() or (below < n + 1).any():
                return True
        return False

    def _augment(self, left: np.ndarray, mine: np.ndarray, owner: np.ndarray, t: float) -> bool:
        """One search by breadth from all rows in ``left``, a tree each; every tree that finds a free column gives it to its root's path."""
        root = np.full(len(self.rows), -1)
        root[left] = left
        via, open_, ends = np.full(len(self.columns), -1), np.arange(len(self.columns)), {}
        front = left
        while len(front) and len(open_):
            reached, open_ = self._reach(front, open_, via, t)
            if not len(reached):
                break
            own = root[via[reached]]
            for c, r in zip(reached[owner[reached] < 0], own[owner[reached] < 0], strict=True):
                ends.setdefault(int(r), int(c))
            taken = owner[reached] >= 0
            front, own = owner[reached[taken]], own[taken]
            root[front] = own
            if ends:
                front = front[~np.isin(own, list(ends))]
        for c in ends.values():
            while c >= 0:
                r = via[c]
                owner[c] = r
                mine[r], c = c, mine[r]
        return bool(ends)

    def _reach(self, front: np.ndarray, open_: np.ndarray, via: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Columns of ``open_`` within ``t`` of a row in ``front``, which ``via`` then names, and the columns left."""
        front, found, at = np.sort(front), [], 0
        while at < len(front) and len(open_):
            here = front[at : at + max(1, CELLS_AT_ONCE // len(open_))]
            at += len(here)
            x, y = self.rows[here], self.columns[open_]
            near = (np.abs(x[:, None, 0] - y[None, :, 0]) <= t) & (np.abs(x[:, None, 1] - y[None, :, 1]) <= t)
            hit = near.any(axis=0)
            via[open_[hit]] = here[near.argmax(axis=0)[hit]]
            found.append(open_[hit])
            open_ = open_[~hit]
        return np.concatenate(found) if found else open_[:0], open_
