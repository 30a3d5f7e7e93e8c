"""Connected components by alternating stars, and their numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.prefix import global_rank
from quillon.session import cut, release


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b); component is the smallest node.

    Large stars link every larger neighbour of a node to its smallest neighbour, small stars
    the smaller ones; alternated until the edges stop changing, every edge ends at the
    smallest node. Both steps are one aggregation and one join on distinct edges.
    Null ends and loops link nothing; nodes that only loop have no row. Two rounds' edges are
    compared by their number and two sums over their hashes.
    """
    tidy = lambda e: e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
    now = cut(tidy(edges))
    seen = mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.where("a != b").distinct())
        marked = mark(after)
        release(now)
        now = after
        if marked == seen:
            break
        seen = marked
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)


def numbered(components: DataFrame, prefix: str = "ndc_") -> DataFrame:
    """(component_id, node, component_size): ids in the order of size falling, then least node.

    Only the components are ordered, not their members, and range by range.
    """
    sizes = components.groupBy("component").agg((-F.count("*")).alias("__less"))
    ranked = global_rank(sizes, ["__less", "component"], "__at")
    ids = ranked.select("component", (-F.col("__less")).alias("component_size"), F.format_string(f"{prefix}%06d", F.col("__at").cast("bigint")).alias("component_id"))
    return components.join(ids, "component").select("component_id", "node", "component_size")
