"""Joins and frames that are checked: one-to-one keys, lookups without gaps, usable splits and scores."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import small_side


def _refuse(bad: DataFrame, what: str) -> None:
    rows = bad.limit(10).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(", ".join(str(x) for x in r) for r in rows))


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, after a check that no key occurs twice; the check counts keys map-side."""
    _refuse(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), f"repeated {', '.join(keys)}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """A join of two frames with unique keys; other columns that both have get a suffix. Repeated keys raise."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    renamed = lambda df, s: df.select(*[F.col(c).alias(c + s) if c in shared else F.col(c) for c in df.columns])
    return renamed(unique_on(left, keys), suffixes[0]).join(renamed(unique_on(right, keys), suffixes[1]), keys, how)


def full_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``table`` by ``key``; a value that the table lacks raises."""
    side = small_side(table)
    _refuse(df.where(F.col(key).isNotNull()).select(key).distinct().join(side.select(key), key, "left_anti"), f"no entry for {key}")
    return df.join(side, key)


def exactly_one(df: DataFrame, **wanted: str) -> DataFrame:
    """The one row whose columns equal the wanted texts, whatever their case; none or several raise."""
    hit = F.lit(True)
    for c, v in wanted.items():
        hit = hit & (F.lower(F.col(c).cast("string")) == str(v).lower())
    rows = df.where(hit)
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} row for {wanted}")
    return rows


def predefined_split(df: DataFrame, split: str, allowed: tuple[str, ...] = ("train", "validation", "test", "")) -> DataFrame:
    """``df`` as it is split, null as ''; a name that is not allowed raises."""
    named = df.withColumn(split, F.coalesce(split, F.lit("")))
    _refuse(named.where(~F.col(split).isin(*allowed)).select(split).distinct(), "unknown split")
    return named


def test_only(df: DataFrame, split: str = "split") -> DataFrame:
    """``df``, after a check that it holds test rows only, so that nothing is fitted on it."""
    _refuse(df.where(~F.coalesce(F.col(split) == "test", F.lit(False))).select(split).distinct(), "rows outside the test split")
    return df


test_only.__test__ = False


def finite_scores(df: DataFrame, score: str) -> DataFrame:
    """``df`` whose scores raise where they are null, NaN or infinite, at the row that is read."""
    s = F.col(score)
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return df.withColumn(score, F.when(bad, F.raise_error(F.lit(f"{score} is not finite")).cast("double")).otherwise(s))


def checksum_state(expected: Column, content: Column) -> Column:
    """Struct (exists, matches) of a file's bytes against a SHA-256 in any case; null bytes are no file."""
    there = content.isNotNull()
    return F.struct(there.alias("exists"), (there & F.coalesce(F.sha2(content, 256) == F.lower(expected), F.lit(False))).alias("matches"))


def config_hash(config) -> str:
    """16 hex digits that name a configuration: SHA-256 of its JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def run_id(name: str, seed: int, config) -> str:
    """A name for a run that the same name, seed and configuration always get."""
    return f"{name}-s{seed}-{config_hash(config)[:8]}"
