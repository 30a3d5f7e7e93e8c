"""Similarity self-join of 64-bit hashes by pieces, exact for any distance bound."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.bits import hamming64
from quillon.session import cut


def piece_widths(n: int, most: int) -> list[int]:
    """Widths of the pieces of a hash for ``n`` distinct hashes, low bits first.

    Hashes at most ``most`` bits apart agree on all but ``most`` pieces. There are so many
    pieces that the ones they agree on hold at least log2 n + 1 bits, where 64 bits allow;
    so unrelated hashes rarely meet, and candidates grow about as n.
    """
    for m in range(most + 1, min(64, most + 8) + 1):
        if (64 // m) * (m - most) >= math.log2(max(2, n)) + 1:
            break
    return [64 // m + (i < 64 % m) for i in range(m)]


def hamming_pairs(df: DataFrame, key: str, hash_: str, most: int) -> DataFrame:
    """(key_a, key_b, hamming), key_a < key_b: rows whose hashes differ in at most ``most`` bits.

    Hashes are compared once a distinct value. A hash is cut into pieces (``piece_widths``);
    each choice of all but ``most`` of them is a key, so an equi-join by choice and pieces
    finds all pairs, and the first choice on which a pair agrees reports it. Null hashes
    match nothing.
    """
    if not 0 <= most < 64:
        raise ValueError("most must be within 0 and 63")
    values = cut(df.where(F.col(hash_).isNotNull()).select(F.col(hash_).alias("h")).distinct())
    widths = piece_widths(values.count(), most)
    choices = list(combinations(range(len(widths)), len(widths) - most))
    lows = [sum(widths[:i]) for i in range(len(widths))]
    mask = lambda c: sum(((1 << widths[i]) - 1) << lows[i] for i in c)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in map(mask, choices)]
    kept = lambda h: [h.bitwiseAND(F.lit(m).cast("bigint")) for m in signed]
    keyed = values.select("h", F.posexplode(F.array(*kept(F.col("h")))).alias("choice", "value"))
    a, b = keyed.withColumnRenamed("h", "ha"), keyed.withColumnRenamed("h", "hb")
    met = a.join(b, ["choice", "value"]).where((F.col("ha") <= F.col("hb")) & (hamming64(F.col("ha"), F.col("hb")) <= most))
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.array_position(F.array(*[k == 0 for k in kept(differ)]), True) - 1
    pairs = met.where(first == F.col("choice")).select("ha", "hb", hamming64(F.col("ha"), F.col("hb")).alias("hamming"))
    left = df.select(F.col(key).alias("ka"), F.col(hash_).alias("ha"))
    right = df.select(F.col(key).alias("kb"), F.col(hash_).alias("hb"))
    found = pairs.join(left, "ha").join(right, "hb").where(F.col("ka") != F.col("kb"))
    named = found.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "hamming")
    return named.distinct()
