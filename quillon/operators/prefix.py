"""Running totals and ranks that never put one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut, small_side


def running_total(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str
) -> DataFrame:
    """``out`` = the sum of ``value`` over earlier rows of the same ``keys``, the row excluded.

    ``bucket`` is a column that never decreases along ``order`` within ``keys``; it cuts
    each group, however large, into pieces. Piece sums are combined map-side, their
    prefix runs over pieces only, and the inner prefix runs within one piece. Rows that
    tie in ``order`` get some fixed place only if ``order`` is total. ``keys`` must hold no
    nulls (map them first); an empty table stays empty.
    """
    by = [*keys, bucket]
    v = f"__{out}_v"
    base = df.withColumn(v, value)
    sums = base.groupBy(*by).agg(F.sum(v).alias("__sum"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(
        *[F.col(k).alias(f"__h_{k}") for k in by],
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__head"),
    )
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(k) == F.col(f"__h_{k}") for k in by]
    joined = base.join(heads, on, "inner")
    return joined.withColumn(
        out, F.col("__head") + F.coalesce(F.sum(v).over(inner), F.lit(0))
    ).drop(v, "__head", *[f"__h_{k}" for k in by])


def by_range(df: DataFrame, order: list, piece: str = "piece") -> DataFrame:
    """``df`` with ``piece``, a number that never decreases along ``order``.

    The rows are partitioned by ranges of ``order``, whose borders are quantiles of a
    sample, so pieces are about equal however crowded the values are; rows that tie in
    ``order`` share a piece. The frame is materialised, since the borders of a second run
    could differ.
    """
    return cut(df.repartitionByRange(*order).withColumn(piece, F.spark_partition_id()))


def running_most(df: DataFrame, keys: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """``out`` = the largest ``value`` up to and with a row of the same ``keys``, piece by piece as ``running_total``."""
    by = [*keys, bucket]
    base = df.withColumn(f"__{out}_v", value)
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = base.groupBy(*by).agg(F.max(f"__{out}_v").alias("__top"))
    heads = tops.select(*[F.col(k).alias(f"__h_{k}") for k in by], F.max("__top").over(before).alias("__head"))
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = base.join(heads, [F.col(k) == F.col(f"__h_{k}") for k in by])
    return joined.withColumn(out, F.greatest("__head", F.max(f"__{out}_v").over(inner))).drop(f"__{out}_v", "__head", *[f"__h_{k}" for k in by])


def global_rank(df: DataFrame, order: list, out: str) -> DataFrame:
    """``df`` with ``out``: the place of each row in the total ``order``, from 0; no task orders more than a range."""
    return running_total(by_range(df, order, "__range"), [], "__range", order, F.lit(1), out).drop("__range")


def linear_quantiles(counts: DataFrame, keys: list[str], value: str, n: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column a share): exact linear quantiles from ``counts`` of distinct values.

    The q-quantile of N values lies at place q (N - 1) of their order, between the two
    nearest values. Values are counted before they are ordered and ordered range by range,
    so no buffer holds the values of a group. ``keys`` must hold no nulls.
    """
    placed = running_total(by_range(counts, [value], "__range"), keys, "__range", [value], F.col(n), "__at")
    total = counts.groupBy(*keys).agg(F.sum(n).alias("__total"))
    sized = placed.join(small_side(total), keys) if keys else placed.crossJoin(F.broadcast(total))
    end = F.col("__at") + F.col(n)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()])
    place = lambda q: q * (F.col("__total") - 1)
    here = lambda k: (F.col("__at") <= k) & (k < end)
    touched = F.filter(wanted, lambda w: here(F.floor(place(w["q"]))) | here(F.ceil(place(w["q"]))))
    hit = sized.select(*keys, F.col(value).alias("__v"), "__at", end.alias("__end"), "__total", F.inline(touched))
    at = lambda k: F.max(F.when((F.col("__at") <= k) & (k < F.col("__end")), F.col("__v")))
    p = place(F.col("q"))
    ends = hit.groupBy(*keys, "name").agg(at(F.floor(p)).alias("lo"), at(F.ceil(p)).alias("hi"), F.max(p - F.floor(p)).alias("f"))
    found = F.map_from_entries(F.collect_list(F.struct("name", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f"))))
    got = ends.groupBy(*keys).agg(found.alias("__found"))
    return got.select(*keys, *[F.try_element_at("__found", F.lit(name)).alias(name) for name in shares])
