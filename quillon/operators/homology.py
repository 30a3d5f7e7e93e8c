"""Persistence of scalar fields and point clouds, computed in Arrow batches."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

BARS = ArrayType(StructType([StructField("dim", IntegerType()), StructField("birth", DoubleType()), StructField("death", DoubleType())]))


def _joins(values: np.ndarray, neighbours, order: np.ndarray, outside: float | None = None) -> list[tuple[float, float]]:
    """Bars of merging components when cells enter in ``order``; the younger component ends.

    ``outside`` adds a component that is there from the start and that border cells touch.
    """
    n = len(values)
    root, birth = np.full(n + 1, -1), np.full(n + 1, np.inf)
    if outside is not None:
        root[n], birth[n] = n, outside

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for rank, i in enumerate(order):
        root[i], birth[i] = i, rank
        for j in neighbours(i):
            if root[j] < 0:
                continue
            a, b = find(i), find(j)
            if a == b:
                continue
            old, young = (a, b) if birth[a] <= birth[b] else (b, a)
            start = values[order[int(birth[young])]]
            if start != values[i]:
                out.append((float(start), float(values[i])))
            root[young] = old
    return out


def field_bars(field: np.ndarray) -> list[tuple[int, float, float]]:
    """Sublevel bars of a 2-D field whose pixels are the top cells.

    Dimension 0 merges pixels that touch at a side or corner as the level rises, with one
    essential bar. Dimension 1 uses duality: the holes of a sublevel set are the components
    of its complement, whose pixels touch at sides only, the outside counted as one; they
    merge as the level falls, and each hole's bar runs from its merger to its deepest pixel.
    """
    if field.ndim != 2 or not field.size or not np.isfinite(field).all():
        raise ValueError("a field is two-dimensional, not empty and finite")
    h, w = field.shape
    flat = field.ravel().astype(float)

    def around(steps, border):
        def of(i: int):
            y, x = divmod(int(i), w)
            for dy, dx in steps:
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    yield (y + dy) * w + x + dx
            if border and (y in (0, h - 1) or x in (0, w - 1)):
                yield h * w

        return of

    sides = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    corners = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    up = np.argsort(flat, kind="stable")
    bars = [(0, float(flat.min()), float("inf"))]
    bars += [(0, b, d) for b, d in _joins(flat, around(sides + corners, False), up)]
    bars += [(1, d, b) for b, d in _joins(flat, around(sides, True), up[::-1], -1)]
    return sorted(bars)


def cloud_bars(points: np.ndarray, longest: float = 2.0) -> list[tuple[int, float, float]]:
    """Rips bars of dimensions 0 and 1 under cosine distance, edges up to ``longest``.

    Edges are ordered by length, triangles by their three edges from the last one down. Edges
    that merge components end bars of dimension 0. Of the others, an edge that is the last of
    some triangle pairs with the first such triangle at no length. The edges left are reduced
    as columns of the coboundary matrix over two elements, last edge first: a column's first
    triangle ends the loop that the edge began, an empty column's loop is essential.
    """
    n = len(points)
    if n == 0:
        return []
    x = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    d = np.clip(1 - x @ x.T, 0, 2)
    a, b = np.triu_indices(n, 1)
    a, b = a[d[a, b] <= longest], b[d[a, b] <= longest]
    order = np.argsort(d[a, b], kind="stable")
    a, b = a[order], b[order]
    length, m = d[a, b], len(order)
    rank = np.full((n, n), m)
    rank[a, b] = rank[b, a] = np.arange(m)
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    bars, loops = [], []
    for k in range(m):
        u, v = find(a[k]), find(b[k])
        if u == v:
            loops.append(k)
        else:
            root[u] = v
            bars.append((0, 0.0, float(length[k])))
    bars += [(0, 0.0, float("inf"))] * len({find(v) for v in range(n)})

    def triangles(k: int) -> list[int]:
        """Those with edge ``k``, each as one number that sorts by last, middle and first edge."""
        s, t = rank[a[k]], rank[b[k]]
        here = (s < m) & (t < m)
        e = np.sort(np.stack([s[here], t[here], np.full(int(here.sum()), k)]), axis=0)
        return ((e[2] * m + e[1]) * m + e[0]).tolist()

    def is_last(k: int) -> bool:
        return bool((np.maximum(rank[a[k]], rank[b[k]]) < k).any())

    reduced: dict[int, list[int]] = {}
    for k in reversed(loops):
        if is_last(k):
            continue
        column = triangles(k)
        heapify(column)
        while (first := _pop_odd(column)) is not None:
            if first in reduced:
                other = reduced[first]
            else:
                last = first // (m * m)
                other = triangles(last)
                if min(other) != first:
                    left = [first]
                    while (t := _pop_odd(column)) is not None:
                        left.append(t)
                    reduced[first] = left
                    if length[last] > length[k]:
                        bars.append((1, float(length[k]), float(length[last])))
                    break
            for t in other:
                if t != first:
                    heappush(column, t)
        else:
            bars.append((1, float(length[k]), float("inf")))
    return sorted(bars)


def _pop_odd(heap: list[int]) -> int | None:
    """Takes the least number that the heap holds an odd number of times; equal pairs vanish."""
    while heap:
        t = heappop(heap)
        if not heap or heap[0] != t:
            return t
        heappop(heap)
    return None


DIAGRAM = StructType([StructField("bars", BARS), StructField("error", StringType())])


def field_diagrams(fields: Column, superlevel: bool = False, unit: bool = False) -> Column:
    """Struct (bars, error) of each 2-D field (array of rows).

    Superlevel bars are those of one less the field. With ``unit`` values must lie within 0
    to 1. A null, ragged, empty or not finite field has no bars and says why in ``error``;
    a good one has a null error. Nothing is made up for a field that fails.
    """

    def one(f) -> dict:
        try:
            if f is None:
                raise ValueError("no field")
            x = np.stack([np.asarray(r, dtype=float) for r in f])
            if unit and x.size and not ((x >= 0) & (x <= 1)).all():
                raise ValueError("values outside 0 to 1")
            return {"bars": [{"dim": k, "birth": b, "death": d} for k, b, d in field_bars(1 - x if superlevel else x)], "error": None}
        except (ValueError, TypeError) as e:
            return {"bars": [], "error": str(e)}

    @F.pandas_udf(DIAGRAM)
    def each(f: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(f.map(one).tolist(), columns=["bars", "error"])

    return each(fields)


def field_persistence(fields) -> Column:
    """Sublevel bars of each 2-D field; a null or unusable field has none, see ``field_diagrams`` for why."""
    return field_diagrams(F.col(fields) if isinstance(fields, str) else fields)["bars"]


@F.pandas_udf(BARS)
def cloud_persistence(clouds: pd.Series) -> pd.Series:
    """Bars of each point cloud (array of vectors) under cosine distance; null clouds have none."""
    return clouds.map(lambda c: [{"dim": k, "birth": b, "death": d} for k, b, d in cloud_bars(np.stack([np.asarray(p, dtype=float) for p in c]))] if c is not None and len(c) else [])
