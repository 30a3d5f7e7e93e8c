"""Two-sided p-values of Student's t as column expressions, by the finite sums for whole degrees of freedom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.vec import let


def _series(terms: Column, first: Column, ratio) -> Column:
    """first + first r(1) + first r(1) r(2) + .. with ``terms`` terms."""
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    step = lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * ratio(i)).alias("term"))
    return F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1)).cast("int")), start, step)["sum"]).otherwise(0.0)


def t_two_sided(t: Column, df: Column) -> Column:
    """Chance of a Student's t with ``df`` whole degrees of freedom at least as far from 0 as ``t``.

    An infinite t has chance 0; null or fewer than 1 degree give null.
    """

    def chance(a: Column) -> Column:
        sin, cos2 = F.sin(a), F.cos(a) * F.cos(a)
        even = sin * _series(df / 2, F.lit(1.0), lambda i: cos2 * (2 * i - 1) / (2 * i))
        odd = 2 / F.lit(3.141592653589793) * (a + sin * F.cos(a) * _series((df - 1) / 2, F.lit(1.0), lambda i: cos2 * (2 * i) / (2 * i + 1)))
        return 1 - F.when(df % 2 == 0, even).otherwise(odd)

    return F.when(df >= 1, F.greatest(F.lit(0.0), let(F.atan(F.abs(t) / F.sqrt(df)), chance)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of ``n`` pairs against none; 0 for a perfect one, null under 3 pairs."""
    df = n - 2
    t = r * F.sqrt(df / (1 - r * r))
    return F.when((n >= 3) & (F.abs(r) >= 1), 0.0).when(n >= 3, t_two_sided(t, df))
