"""Deterministic splits and samples ordered by hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.prefix import running_total
from quillon.session import cut, small_side

PIECE_DIGITS = 3


def order_key(seed: int, key: Column) -> Column:
    """SHA-256 of "seed:key", an order that every engine shares."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def stratified_split(df: DataFrame, key: str, stratum: str, known: Column, seed: int = 13, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``df`` with ``split``: known rows cut per stratum at the rounded shares of the hash order, others test.

    Counts are rounded half-even. Sizes must sum to at most 1; see ``check_sizes``. Ranks
    are taken piece by piece of the hash range, so a stratum with a third of the rows is
    spread over many tasks. Known rows must have a stratum; a null one raises.
    """
    check_sizes(train, validation, 1 - train - validation)
    checked = F.when(F.col(stratum).isNull(), F.raise_error(F.lit("a stratified split needs a stratum on every known row"))).otherwise(F.col(stratum))
    hashed = df.where(known).withColumn(stratum, checked).withColumn("__h", order_key(seed, F.col(key)))
    ranked = running_total(hashed.withColumn("__p", F.substring("__h", 1, PIECE_DIGITS)), [stratum], "__p", ["__h", key], F.lit(1), "__r")
    sizes = df.where(known).groupBy(stratum).agg(F.count("*").alias("__n"))
    a, b = F.bround(F.col("__n") * train), F.bround(F.col("__n") * validation)
    split = F.when(F.col("__r") < a, "train").when(F.col("__r") < a + b, "validation").otherwise("test")
    placed = ranked.join(small_side(sizes), stratum).withColumn("split", split)
    return placed.select(*df.columns, "split").unionByName(df.where(~known).withColumn("split", F.lit("test")))


def group_split(df: DataFrame, group: str, seed: int = 13, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """(group, split): distinct groups cut at the rounded shares of the hash order; nulls and '' raise.

    Groups are ranked piece by piece of the hash range.
    """
    check_sizes(train, validation, 1 - train - validation)
    checked = F.when(F.coalesce(F.trim(group), F.lit("")) == "", F.raise_error(F.lit("a group split needs a group on every row"))).otherwise(F.col(group))
    groups = cut(df.select(checked.alias(group)).distinct().withColumn("__h", order_key(seed, F.col(group))))
    pieces = groups.withColumn("__p", F.substring("__h", 1, PIECE_DIGITS))
    ranked = running_total(pieces, [], "__p", ["__h", group], F.lit(1), "__r").crossJoin(F.broadcast(groups.agg(F.count("*").alias("__n"))))
    a, b = F.bround(F.col("__n") * train), F.bround(F.col("__n") * validation)
    return ranked.select(group, F.when(F.col("__r") < a, "train").when(F.col("__r") < a + b, "validation").otherwise("test").alias("split"))


def check_sizes(train: float, validation: float, test: float) -> None:
    if abs(train + validation + test - 1) > 1e-6 or min(train, validation, test) < -1e-9:
        raise ValueError("split sizes must be positive and sum to 1")


def per_class_sample(df: DataFrame, key: str, label: str, k: int, seed: int = 13) -> DataFrame:
    """``df`` with ``available_n``: at most ``k`` rows of each class, first in the hash order.

    Ranks are taken piece by piece of the hash range, so a class of any size is spread over
    many tasks. Rows without a class are left out.
    """
    hashed = df.where(F.col(label).isNotNull()).withColumn("__h", order_key(seed, F.col(key))).withColumn("__p", F.substring("__h", 1, PIECE_DIGITS))
    ranked = running_total(hashed, [label], "__p", ["__h", key], F.lit(1), "__r")
    sizes = df.groupBy(label).agg(F.count("*").alias("available_n"))
    return ranked.where(F.col("__r") < k).select(*df.columns).join(small_side(sizes), label)


def balanced_fill(df: DataFrame, key: str, label: str, n: int, seed: int = 13) -> DataFrame:
    """``n`` rows: the same number of each class, then the first of the rest in the hash order."""
    h = order_key(seed, F.col(key))
    classes = df.select(label).distinct().count()
    base = per_class_sample(df, key, label, n // max(1, classes), seed).drop("available_n")
    rest = df.join(base.select(key), key, "left_anti").orderBy(h, key).limit(max(0, n - base.count()))
    return base.unionByName(rest)


def spanning_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits): non-blank keys found in more than one split."""
    rows = df.where((F.trim(key) != "") & (F.trim(split) != ""))
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def conservative_resplit(df: DataFrame, components: DataFrame, key: str, label: str, split: str, train: float = 0.7, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """(component, old splits, new split) for components found in several splits.

    The component takes the split that leaves the label counts nearest their targets (sum
    of squares, to six digits); ties go to the majority split, then by name. Components are
    handled one after the other in the order of their name with the counts carried along,
    so they stream, sorted, through one task that holds the counts by split and label and
    one component's labels; rows never reach it, only counts of conflicting components.
    """
    check_sizes(train, validation, test)
    counts = {(r[0], r[1]): float(r[2]) for r in df.groupBy(split, label).count().collect()}
    labels = sorted({k[1] for k in counts})
    sizes = {"train": train, "validation": validation, "test": test}
    total = {x: sum(v for (_, y), v in counts.items() if y == x) for x in labels}
    goal = {(s, x): total[x] * sizes[s] for s in sizes for x in labels}
    start = {(s, x): counts.get((s, x), 0.0) for s in sizes for x in labels}
    per = cut(df.join(components, key).groupBy("component", split, label).agg(F.count("*").alias("n")))
    bad = per.groupBy("component").agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a != b").select("component")
    rows = per.join(bad, "component", "left_semi").select("component", F.col(split).alias("s"), F.col(label).alias("x"), "n")

    def settle_all(batches):
        now = dict(start)

        def settle(name, held):
            by_split, by_label = {}, {}
            for s, x, c in held:
                by_split[s] = by_split.get(s, 0) + c
                by_label[x] = by_label.get(x, 0) + c
                now[(s, x)] -= c
            major = max(sorted(by_split), key=lambda s: by_split[s])

            def cost(s):
                return round(sum((now[(t, x)] + (by_label.get(x, 0) if t == s else 0) - goal[(t, x)]) ** 2 for t in sizes for x in labels), 6)

            best = min(sizes, key=lambda s: (cost(s), s != major, s))
            for x, c in by_label.items():
                now[(best, x)] += c
            return name, ",".join(sorted(by_split)), best

        current, held = None, []
        for pdf in batches:
            out = []
            for name, s, x, n in pdf.itertuples(index=False):
                if name != current and held:
                    out.append(settle(current, held))
                    held = []
                current = name
                held.append((s, x, n))
            yield pd.DataFrame(out, columns=["component", "old_splits", "new_split"])
        if held:
            yield pd.DataFrame([settle(current, held)], columns=["component", "old_splits", "new_split"])

    ordered = rows.repartition(1).sortWithinPartitions("component", "s", "x")
    return ordered.mapInPandas(settle_all, "component string, old_splits string, new_split string")
