"""Numeric arrays as column expressions: norms, distances, softmax, moments, matrix products.

Elements are cast to double before arithmetic. A null array or element gives null; arrays
of different lengths are padded with nulls by ``zip_with`` and so give null as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda it would be computed for
    every element, since expressions are not moved out of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    """Sum of the elements in order; 0 for an empty array."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    """The array over its norm, or over ``eps`` where the norm is smaller."""
    return let(F.greatest(norm(a), F.lit(eps)), lambda n: F.transform(a, lambda x: x / n))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, kept within 0 to 2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(l2_normalize(a), l2_normalize(b))))


def log_sum_exp(z: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(z) / temperature
    return let(top, lambda m: m + F.log(total(F.transform(z, lambda x: F.exp(x / temperature - m)))))


def softmax(z: Column) -> Column:
    powers = let(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp(x - m)))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(a: Column) -> Column:
    """Zero-based place of the first largest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def clip_above(a: Column, cap: Column) -> Column:
    return F.transform(a, lambda x: F.least(x, cap))


def affine(a: Column, weights: Column, bias: Column) -> Column:
    """Rows of ``weights`` (array of arrays) times ``a``, plus ``bias``."""
    return F.zip_with(F.transform(weights, lambda w: dot(w, a)), bias, lambda x, y: x + y)


def mean(a: Column) -> Column:
    """Mean of the elements; null for an empty array."""
    return F.try_divide(total(a), F.size(a))


def _centred(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def structural_similarity(a: Column, b: Column, c1: float = 1e-4, c2: float = 9e-4) -> Column:
    """Similarity of two fields over one window, with population moments."""
    n = F.size(a)

    def from_parts(p: Column) -> Column:
        ma, mb, da, db = p["ma"], p["mb"], p["da"], p["db"]
        spread = F.try_divide(dot(da, da) + dot(db, db), n)
        return ((2 * ma * mb + c1) * (F.try_divide(2 * dot(da, db), n) + c2)) / ((ma * ma + mb * mb + c1) * (spread + c2))

    parts = F.struct(mean(a).alias("ma"), mean(b).alias("mb"), _centred(a).alias("da"), _centred(b).alias("db"))
    return let(parts, from_parts)


def normalized_correlation(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """Correlation of two fields; where one is constant, 1 if they agree, else 0."""
    same = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance + 1e-5 * F.abs(y)), lambda ok: ok)

    def from_parts(p: Column) -> Column:
        d = norm(p["da"]) * norm(p["db"])
        return F.when(d == 0, F.when(same, 1.0).otherwise(0.0)).otherwise(dot(p["da"], p["db"]) / d)

    return let(F.struct(_centred(a).alias("da"), _centred(b).alias("db")), from_parts)


def average_hash(pixels: Column) -> Column:
    """One character an element: 1 where it is at least the mean, else 0."""
    return let(mean(pixels), lambda m: F.array_join(F.transform(pixels, lambda x: F.when(x >= m, "1").otherwise("0")), ""))


def finite(a: Column) -> Column:
    """True where every element is a finite number."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def linear_quantile(a: Column, q: float) -> Column:
    """The linear quantile of the elements of one array; null for an empty array."""

    def pick(v: Column) -> Column:
        place = (F.size(v) - 1) * F.lit(q)
        low, high = F.get(v, F.floor(place).cast("int")), F.get(v, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return F.when(F.size(a) > 0, let(F.array_sort(a), pick))


def percentile_scaled(a: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """The array scaled to 0..1 between two of its quantiles and clipped; all 0 where they agree."""

    def scaled(p: Column) -> Column:
        width = p["hi"] - p["lo"]
        return F.transform(a, lambda x: F.when(width <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - p["lo"]) / width))))

    return let(F.struct(linear_quantile(a, low).alias("lo"), linear_quantile(a, high).alias("hi")), scaled)
