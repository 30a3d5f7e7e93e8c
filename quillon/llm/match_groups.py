"""Groups from pairwise matches: minimum labels, pointer jumping, a checkpoint a round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import present, trim_lower
from quillon.session import cut, release

MAX_HAMMING = 4


def matching_pairs(audit: DataFrame, max_hamming: int = MAX_HAMMING) -> DataFrame:
    """The audit rows that are matches, as (left_id, right_id) after T.

    A row counts if both ids are present, differ after T, and hamming is not null and at
    most ``max_hamming``. Repeated and mirrored rows stay; other columns are dropped.
    """
    left, right = trim_lower(F.col("left_image_id")), trim_lower(F.col("right_image_id"))
    return audit.where(
        present(F.col("left_image_id"))
        & present(F.col("right_image_id"))
        & (left != right)
        & (F.col("hamming") <= max_hamming)
    ).select(left.alias("left_id"), right.alias("right_id"))


def connected_groups(pairs: DataFrame, left: Column | str, right: Column | str) -> DataFrame:
    """(id, group_id) for every id in a pair; group_id is the smallest id of its group.

    Each round works on the graph of the labels that are left: every label hooks to its
    smallest neighbour, the hooks are followed to their ends by pointer jumping, and the
    pairs are rewritten with the labels so found. Pairs inside one label vanish, so a round
    sees at most the labels that no neighbour undercut. Rounds end when no pair links two
    labels. The tables of hooks, each smaller than the one before, are composed at the end.

    Every round and jump is checkpointed, so a lost executor costs one step and plans stay
    short; its predecessor's files are deleted once it stands. Minima and distinct pairs are combined map-side; the joins are many-to-one on
    the label, where adaptive execution splits the partition of a hub.

    Pairs with a null end or equal ends link nothing and name no id. Repeated and mirrored
    pairs change nothing. An empty table gives an empty result.
    """
    left = F.col(left) if isinstance(left, str) else left
    right = F.col(right) if isinstance(right, str) else right
    one_way = pairs.select(left.alias("a"), right.alias("b")).where(F.col("a") != F.col("b"))
    edges = cut(one_way.union(one_way.select("b", "a")).distinct())
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        ends = _jump(cut(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("root"))))
        hooks.append(ends)
        to_a = ends.select(F.col("a").alias("ka"), F.col("root").alias("ra"))
        to_b = ends.select(F.col("a").alias("kb"), F.col("root").alias("rb"))
        linked = edges.join(to_a, edges["a"] == F.col("ka")).join(to_b, F.col("b") == F.col("kb"))
        left_over = cut(linked.where(F.col("ra") != F.col("rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        release(edges)
        edges = left_over
    if not hooks:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    labels = hooks.pop()
    while hooks:
        upper = labels.select(F.col("a").alias("k"), F.col("root").alias("top"))
        labels = (
            hooks.pop()
            .join(upper, F.col("root") == F.col("k"), "left")
            .select("a", F.coalesce("top", "root").alias("root"))
        )
    return labels.select(F.col("a").alias("id"), F.col("root").alias("group_id"))


def _jump(parents: DataFrame) -> DataFrame:
    """Every (a, root) with root replaced by its root, until nothing moves; earlier files are deleted."""
    held = parents
    while True:
        up = parents.select(F.col("a").alias("k"), F.col("root").alias("next"))
        stepped = cut(
            parents.join(up, F.col("root") == F.col("k")).select(
                "a", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")
            )
        )
        release(held)
        held, parents = stepped, stepped.select("a", "root")
        if stepped.where("moved").isEmpty():
            return parents


def image_groups(images: DataFrame, audit: DataFrame) -> DataFrame:
    """(image_id, group_id) for every image of ``images``; one without a match is alone.

    Ids are compared after T; a null or blank id is no image. Ids that only the audit
    names get no row.
    """
    groups = connected_groups(matching_pairs(audit), "left_id", "right_id")
    ids = (
        images.where(present(F.col("image_id")))
        .select(trim_lower(F.col("image_id")).alias("image_id"))
        .distinct()
    )
    return ids.join(groups, F.col("image_id") == F.col("id"), "left").select(
        "image_id", F.coalesce("group_id", "image_id").alias("group_id")
    )
