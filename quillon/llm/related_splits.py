"""Splits that keep related records together: components by frontier breadth-first search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import normalize_label, split_name, trim_lower
from quillon.operators.prefix import running_total
from quillon.session import cut, parallelism, release, small_side

HUB_DEGREE = 10_000

# Ids that relate nothing.
NO_IDS = ("", "n/a", "unknown")


def _id(c: Column, kind: str) -> Column:
    t = trim_lower(c)
    return F.when(~t.isin(*NO_IDS), F.concat(F.lit(kind), t))


def split_hubs(edges: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """``edges`` (a, b) with the neighbours of every hub hung on parts of it.

    A node with more than ``hub_degree`` neighbours becomes a two-level tree: its neighbours
    hang on parts chosen by their hash, the parts on the node. Connections stay exactly the
    same and no node keeps more neighbours than the bound or the number of its parts.
    """
    ends = edges.select("a").union(edges.select("b"))
    hubs = cut(ends.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > hub_degree))
    if hubs.isEmpty():
        return edges
    tagged, tree = edges, []
    for end, other in (("a", "b"), ("b", "a")):
        of = hubs.select(F.col("a").alias("hub"), F.ceil(F.col("n") / hub_degree).alias("parts"))
        part = F.concat(F.lit("p"), F.pmod(F.xxhash64(other), F.col("parts")), F.lit(":"), F.col("hub"))
        tagged = (
            tagged.join(small_side(of), F.col(end) == F.col("hub"), "left")
            .withColumn(f"{end}_hub", F.col("hub")).withColumn(f"{end}_part", F.coalesce(part, F.col(end))).drop("hub", "parts")
        )
    tagged = cut(tagged.select(F.col("a_part").alias("a"), F.col("b_part").alias("b"), "a_hub", "b_hub"))
    for end in ("a", "b"):
        tree.append(tagged.where(f"{end}_hub is not null").select(F.col(end).alias("a"), F.col(f"{end}_hub").alias("b")).distinct())
    return reduce(DataFrame.union, tree, tagged.select("a", "b"))


def frontier_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b).

    Adjacency lists are hash-partitioned once and stay where they are. Every node whose
    hash is below those of its neighbours is a seed, so each component has at least one;
    all seeds expand at the same time, a level a round. A node takes the smallest seed that
    reaches it first; where another seed reaches it, now or later, the two collide. When
    the frontiers are exhausted, the collisions form a graph on seeds, smaller than the one
    before, which is searched in the same way, until no seeds collide.

    A round shuffles nothing but the messages of its frontier, one an edge over the whole
    search: frontiers and visited nodes lie in the partitions of the adjacency lists. Each
    round is checkpointed, and the files of a search are deleted when its labels stand.
    Rounds are few, since a node is at most as far from a seed as its chain of falling
    hashes is long. A component is named by one of its nodes, the same in every run. Null
    ends are no nodes; empty input gives an empty result.
    """
    parts = parallelism(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null")
    adjacency = cut(both.repartition(parts, "a").dropDuplicates(["a", "b"]), keep_layout=True)
    own = F.struct(F.xxhash64("a"), F.col("a").alias("b"))
    least = F.min(F.when(F.col("a") != F.col("b"), F.struct(F.xxhash64("b"), F.col("b").alias("b"))))
    nodes = adjacency.groupBy("a").agg(least.alias("least"))
    seeds = cut(nodes.where(F.col("least").isNull() | (own < F.col("least"))).select(F.col("a").alias("node"), F.col("a").alias("seed")), keep_layout=True)
    made, frontier, fronts, clashes = [adjacency, seeds], seeds, [seeds], []
    while not frontier.isEmpty():
        sent = (
            frontier.hint("shuffle_hash").join(adjacency, F.col("node") == F.col("a")).select("b", "seed")
            .repartition(parts, "b").dropDuplicates(["b", "seed"])
            .withColumn("first", F.min("seed").over(Window.partitionBy("b")))
        )
        held = reduce(DataFrame.union, fronts).select(F.col("node").alias("n"), F.col("seed").alias("held"))
        taken = F.coalesce("held", "first")
        met = cut(
            sent.hint("shuffle_hash").join(held, F.col("b") == F.col("n"), "left")
            .select(F.col("b").alias("node"), "seed", taken.alias("taken"), F.col("held").isNull().alias("fresh"))
            .where("fresh or seed != taken"),
            keep_layout=True,
        )
        made.append(met)
        clashes.append(met.where("seed != taken").select(F.least("taken", "seed").alias("a"), F.greatest("taken", "seed").alias("b")))
        frontier = met.where("fresh and seed = taken").select("node", "seed")
        fronts.append(frontier)
    labels = reduce(DataFrame.union, fronts)
    met_seeds = cut(reduce(DataFrame.union, clashes).distinct()) if clashes else None
    if met_seeds is None or met_seeds.isEmpty():
        out = cut(labels.select("node", F.col("seed").alias("component")))
    else:
        upper = frontier_components(met_seeds).select(F.col("node").alias("k"), "component")
        named = labels.join(small_side(upper), F.col("seed") == F.col("k"), "left")
        out = cut(named.select("node", F.coalesce("component", "seed").alias("component")))
        release(met_seeds)
    release(*made)
    return out


def group_stratified(signals: DataFrame, configs: DataFrame) -> DataFrame:
    """The rows of ``signals`` under a configuration with method group_stratified; rows without
    a sample_id or config_id are left out."""
    c = configs.where(normalize_label(F.col("method")) == "group_stratified").select("config_id").distinct()
    return signals.join(small_side(c), "config_id", "left_semi").where("sample_id is not null")


def related_samples(rows: DataFrame, flags: list[Column], hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(sample_id, component, flags): samples related by id, film or donor, directly or not.

    Film and donor ids are compared after T; null, blank and placeholder ids relate
    nothing, so a sample with no other id is a component of its own. ``flags`` are
    aggregates over the rows of a sample. Only films and donors are nodes of the graph: a
    row that names both links them, and a sample whose rows name several links the least of
    each row with the least of all. A sample then follows its least film or donor, so the
    samples themselves, however many hang on one film, are no part of the search.
    """
    film, donor = _id(F.col("group_id"), "g:"), _id(F.col("donor_id"), "d:")
    named = rows.withColumn("__film", film).withColumn("__donor", donor).withColumn("__least", F.least("__film", "__donor"))
    samples = cut(named.groupBy("sample_id").agg(F.min("__least").alias("__lo"), F.max("__least").alias("__hi"), *flags))
    several = samples.where(F.col("__lo") != F.col("__hi")).select("sample_id", F.col("__lo").alias("a"))
    inside = named.where(F.col("__film").isNotNull() & F.col("__donor").isNotNull()).select(F.col("__donor").alias("a"), F.col("__film").alias("b"))
    across = named.join(small_side(several), "sample_id").where(F.col("a") != F.col("__least")).select("a", F.col("__least").alias("b"))
    links = cut(inside.union(across).distinct())
    parts = frontier_components(split_hubs(links, hub_degree)).select(F.col("node").alias("__lo"), "component")
    alone = F.concat(F.lit("r:"), F.col("sample_id"))
    return samples.join(small_side(parts), "__lo", "left").withColumn("component", F.coalesce("component", "__lo", alone)).drop("__lo", "__hi")


def broken_relations(signals: DataFrame, configs: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(sample_id, component, n_splits): samples of related sets found in several splits.

    All rows count, copies and older ones too. The splits of a sample and of a component
    are combined as three maxima before and after the shuffle, so a set that holds a third
    of the rows sends a few rows a partition.
    """
    rows = cut(group_stratified(signals, configs).select("sample_id", "group_id", "donor_id", split_name(F.col("split")).alias("split")))
    names = ("train", "validation", "test")
    flags = [F.coalesce(F.max((F.col("split") == s).cast("int")), F.lit(0)).alias(s) for s in names]
    members = cut(related_samples(rows, flags, hub_degree))
    of_set = members.groupBy("component").agg(*[F.max(s).alias(s) for s in names])
    bad = cut(of_set.select("component", (F.col("train") + F.col("validation") + F.col("test")).alias("n_splits")).where("n_splits > 1"))
    return members.join(small_side(bad), "component").select("sample_id", "component", "n_splits")


def assigned_splits(signals: DataFrame, configs: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(config_id, sample_id, component, status, split) under every usable configuration.

    Usable: group_stratified, three sizes that sum to 1; a null seed is 13; of repeated
    configurations the least counts. Every related set lies whole in one split. A set with
    an unknown sample goes to test, where unknown samples belong; the known samples in it
    count there. The other sets are put in the order of a hash of their name and the seed
    and cut where the known samples before a set, half of it included, pass the sizes of
    train and validation, so these are met up to one set. Where too few known samples are
    left for both, they share what there is in proportion.

    A set is named by its least sample_id (``component``). A sample is known unless its
    rows say otherwise.
    """
    usable = (normalize_label(F.col("method")) == "group_stratified") & (F.abs(F.col("train_size") + F.col("validation_size") + F.col("test_size") - 1) <= 1e-6)
    sizes = (
        configs.where(usable).groupBy("config_id")
        .agg(F.min(F.struct("train_size", "validation_size", F.coalesce("seed", F.lit(13)).alias("seed"))).alias("s")).select("config_id", "s.*")
    )
    status = normalize_label(F.col("known_or_unknown"))
    rows = cut(group_stratified(signals, configs).select("config_id", "sample_id", "group_id", "donor_id", F.coalesce(status != "known", F.lit(False)).alias("unknown")))
    members = cut(related_samples(rows, [], hub_degree))
    names = cut(members.groupBy("component").agg(F.min("sample_id").alias("name")))
    named = members.join(small_side(names), "component").select("sample_id", "name")
    kinds = rows.groupBy("config_id", "sample_id").agg(F.max("unknown").alias("unknown"))
    placed = cut(kinds.join(small_side(sizes), "config_id").join(named, "sample_id"))
    sets = cut(
        placed.groupBy("config_id", "seed", "train_size", "validation_size", "name")
        .agg(F.count_if(~F.col("unknown")).alias("known"), F.max("unknown").alias("mixed"))
    )
    free = F.coalesce(F.sum(F.when(~F.col("mixed"), F.col("known"))), F.lit(0))
    totals = sets.groupBy("config_id").agg(F.sum("known").alias("all_known"), free.alias("free"))
    pure = sets.where("not mixed").withColumn("h", F.md5(F.concat_ws("|", "name", "seed"))).withColumn("piece", F.substring("h", 1, 2))
    ordered = running_total(pure, ["config_id"], "piece", ["h", "name"], F.col("known"), "before").join(small_side(totals), "config_id")
    wanted = (F.col("train_size") + F.col("validation_size")) * F.col("all_known")
    scale = F.when(wanted > F.col("free"), F.col("free") / F.greatest(wanted, F.lit(1e-300))).otherwise(1.0)
    at = F.col("before") + F.col("known") / 2
    decided = ordered.select(
        "config_id", "name",
        F.when(at < F.col("train_size") * F.col("all_known") * scale, "train").when(at < wanted * scale, "validation").otherwise("test").alias("split"),
    )
    where = decided.union(sets.where("mixed").select("config_id", "name", F.lit("test")))
    return placed.join(small_side(cut(where)), ["config_id", "name"]).select(
        "config_id", "sample_id", F.col("name").alias("component"), F.when(F.col("unknown"), "unknown").otherwise("known").alias("status"), "split"
    )
