"""Near-duplicate evidence of pairs with close hashes, and the groups that strong evidence forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.operators.groups import numbered, star_components
from quillon.operators.hashjoin import hamming_pairs

# Evidence levels, strongest first, with the strength an edge of each has;
# most differing bits, least structural similarity and least correlation of the two middle ones.
STRENGTH = {"confirmed": 3, "probable_level1": 2, "probable_level2": 1, "candidate_level3": 0}
LEVEL_BOUNDS = {"probable_level1": (1, 0.985, 0.985), "probable_level2": (4, 0.95, 0.95)}
STRONG = ("confirmed", "probable_level1")


def evidence_level(same: Column, bits: Column, similarity: Column, correlation: Column) -> Column:
    """The strongest level that a pair reaches: equal checksums, or few bits with like fields.

    A pair without fields to compare (null similarity) is confirmed or a mere candidate.
    """
    level = F.lit("candidate_level3")
    for name, (most, least_similarity, least_correlation) in reversed(LEVEL_BOUNDS.items()):
        level = F.when((bits <= most) & (similarity >= least_similarity) & (correlation >= least_correlation), name).otherwise(level)
    return F.when(F.coalesce(same, F.lit(False)), "confirmed").otherwise(level)


def strength(level: Column) -> Column:
    out = F.lit(0)
    for name, value in STRENGTH.items():
        out = F.when(level == name, value).otherwise(out)
    return out


def candidate_pairs(rows: DataFrame, most: int = 4) -> DataFrame:
    """(key_a, key_b, bits, same, similarity, correlation, level) of rows whose hashes are close.

    ``rows`` is (id, h, checksum, field): a 64-bit hash, a checksum or null, a field of
    numbers or null, each id once. Pairs come from the banded hash join; fields travel only
    for pairs that it finds. Similarity and correlation have nine digits.
    """
    pairs = hamming_pairs(rows, "id", "h", most)
    side = lambda k: rows.select(F.col("id").alias(f"key_{k}"), F.col("checksum").alias(f"sum_{k}"), F.col("field").alias(f"field_{k}"))
    both = pairs.join(side("a"), "key_a").join(side("b"), "key_b")
    a, b = F.col("field_a"), F.col("field_b")
    out = both.select(
        "key_a", "key_b", F.col("hamming").alias("bits"), F.coalesce(F.col("sum_a") == F.col("sum_b"), F.lit(False)).alias("same"),
        F.round(vec.structural_similarity(a, b), 9).alias("similarity"), F.round(vec.normalized_correlation(a, b), 9).alias("correlation"),
    )
    return out.withColumn("level", evidence_level(F.col("same"), F.col("bits"), F.col("similarity"), F.col("correlation")))


def duplicate_components(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(component_id, node, component_size, evidence_strength) of every row of ``ids`` (id).

    Only pairs of a level in STRONG link rows. Components are numbered by size falling,
    then by their least member; a row's strength is that of its strongest link, 0 without.
    """
    links = pairs.where(F.col("level").isin(*STRONG)).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), strength(F.col("level")).alias("s"))
    grouped = star_components(links)
    nodes = ids.select(F.col("id").alias("node")).distinct().join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = links.select("a", "s").union(links.select("b", "s")).groupBy(F.col("a").alias("node")).agg(F.max("s").alias("best"))
    return numbered(nodes).join(best, "node", "left").select("component_id", "node", "component_size", F.coalesce("best", F.lit(0)).alias("evidence_strength"))
