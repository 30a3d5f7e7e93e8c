"""Paths that only inputs of more than one piece, block or batch take, on small tables."""

import tracemalloc
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame

from quillon.operators import diagrams, neighbors, resample


@contextmanager
def pieces(spark, n=6):
    """Ranges stay in ``n`` partitions, as they do when each holds enough rows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_paired_replicates_over_several_ranges(spark):
    rng = np.random.default_rng(8)
    y, a = (rng.random(600) < 0.4).astype(int), np.round(rng.normal(size=600), 1)
    rows = [(i, int(y[i]), float(a[i])) for i in range(600)]
    with pieces(spark):
        got = resample.replicated_metrics(spark.createDataFrame(rows, "id long, y int, s double"), 6, 5)
        delta = resample.bootstrap_delta(spark.createDataFrame([(t, s, -s) for _, t, s in rows], "y int, a double, b double"), 6).collect()
    for r, w in enumerate(resample.poisson_weights(np.arange(600), 6, 5).T):
        pos, neg = np.repeat(a[y == 1], w[y == 1]), np.repeat(a[y == 0], w[y == 0])
        assert got["fpr95"][r] == pytest.approx((neg > np.quantile(pos, 1 - 0.95)).mean())
    assert [(r["metric"], r["n_replicates"]) for r in delta] == [("auroc", 6), ("fpr95", 6)]


def test_open_interval_over_several_ranges(spark):
    """The driver of ``bootstrap_report``: its FPR interval holds the estimate though no range holds all ranks."""
    rng = np.random.default_rng(9)
    rows = [(int(i % 3 == 0), float(round(rng.normal() + (i % 3 == 0), 2))) for i in range(900)]
    with pieces(spark):
        got = {r["metric"]: r for r in resample.bootstrap_open(spark.createDataFrame(rows, "y int, s double"), 40).collect()}
    y, s = (np.array(c) for c in zip(*rows, strict=True))
    assert got["fpr95"]["estimate"] == pytest.approx((s[y == 0] > np.quantile(s[y == 1], 1 - 0.95)).mean())
    assert all(r["lower"] <= r["estimate"] <= r["upper"] and r["n_replicates"] == 40 for r in got.values())


@pytest.mark.parametrize("same", [False, True])
def test_neighbours_need_no_broadcast_bank(spark, monkeypatch, same):
    """Blocks, partitions of the bank and tiles of a few rows, with ties, zero vectors and repeated ids."""
    for name, n in (("PART_BLOCKS", 2), ("TILE_ROWS", 7), ("EXACT_AT_ONCE", 20)):
        monkeypatch.setattr(neighbors, name, n)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.integers(-2, 3, (80, 3)), np.zeros((3, 3)), rng.normal(size=(30, 3))])
    ids = [f"v{i % 100:02}" for i in range(len(x))]
    df = spark.createDataFrame([(k, [float(t) for t in v]) for k, v in zip(ids, x, strict=True)], "k string, v array<double>")
    got = neighbors.nearest_neighbors(df, df, "k", "v", 4, skip_self=same, block_rows=20)
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = np.round(np.clip(1 - u @ u.T, 0, 2), 12)
    want = []
    for k in sorted(set(ids)):
        met = sorted((float(d[i, j]), ids[j]) for i in range(len(x)) if ids[i] == k for j in range(len(x)) if not (same and ids[j] == k))
        want += [(k, n, s) for s, n in met[:4]]
    assert sorted((r["id"], r["neighbor"], round(r["distance"], 9)) for r in got.collect()) == sorted((k, n, round(s, 9)) for k, n, s in want)


def test_bottleneck_of_many_bars_needs_no_table_of_pairs(monkeypatch):
    rng = np.random.default_rng(12)
    bars = lambda n: np.sort(np.round(rng.exponential(50, (n, 2)), 1), axis=1)
    few = [(bars(rng.integers(1, 12)), bars(rng.integers(1, 12))) for _ in range(60)]
    want = [diagrams.bottleneck_of(p, q) for p, q in few]
    monkeypatch.setattr(diagrams, "DENSE_CELLS", -1)
    monkeypatch.setattr(diagrams, "CELLS_AT_ONCE", 5)
    assert [diagrams.bottleneck_of(p, q) for p, q in few] == want
    monkeypatch.undo()
    p = bars(4000)
    tracemalloc.start()
    assert diagrams.bottleneck_of(p, p + [0.0, 0.25]) <= 0.2500001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


@pytest.mark.parametrize("name", ["plain_method_comparison", "method_comparison"])
def test_one_neighbour_search_for_all_variants(spark, monkeypatch, name):
    from quillon.operators import scorers
    from quillon.plans import evaluation

    searched, search = [], scorers.nearest_neighbors
    monkeypatch.setattr(scorers, "nearest_neighbors", lambda *a: searched.append(a[4]) or search(*a))
    got = evaluation.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert searched == [10] and {"knn_cosine_k1", "knn_cosine_k5", "knn_cosine_k10"} <= {r["method_id"] for r in got.collect()}


def test_best_fields_by_block_agree_with_each_pair(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillon.functions import vec
    from quillon.operators import fields

    monkeypatch.setattr(fields, "ROWS_AT_ONCE", 3)
    rng = np.random.default_rng(2)
    x, y = (np.vstack([rng.normal(size=(8, 6)), np.full((2, 6), 0.1), np.full((1, 6), c)]) for c in (0.7, 0.9))
    best = fields.Best(np.array([f"t{i:02}" for i in range(11)], dtype=object), x)
    best.meet(np.arange(5), y[:5])
    best.meet(np.arange(6), y[5:])
    rows = [(f"t{i:02}", a.tolist(), b.tolist()) for i, a in enumerate(x) for b in y]
    pairs = spark.createDataFrame(rows, "k string, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    want = pairs.groupBy("k").agg(F.max(vec.structural_similarity(a, b)).alias("s"), F.max(vec.normalized_correlation(a, b)).alias("r")).orderBy("k").collect()
    assert best.similarity == pytest.approx([r["s"] for r in want], abs=1e-9)
    assert best.correlation == pytest.approx([r["r"] for r in want], abs=1e-9)


def test_no_pair_of_blocks_holds_both(spark):
    """A query block goes to Python once a partition of the bank, not once a bank block."""
    rows = [(f"v{i:02}", [float(i), 1.0, float(i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    q, b = neighbors.packed(df, "k", "v", 20), neighbors.packed(df, "k", "v", 6, part_blocks=4)
    size = lambda block, s: pd.DataFrame({"block": [block], "n": [s[0]]})
    met = neighbors.products(q, b, lambda ids, m: [0, len(ids)], lambda s, ids, m: s.__setitem__(0, s[0] + s[1] * len(ids)), size, "block int, n bigint")
    sent = met._jdf.queryExecution().analyzed().children().head()
    pairs = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent), spark).collect()
    assert sum(r["q"] is not None for r in pairs) == q.count() * b.rdd.getNumPartitions() < q.count() * b.count()
    assert all((r["q"] is None) != (r["b"] is None) for r in pairs)
    assert sum(r["n"] for r in met.collect()) == 60 * 60


def test_bootstrap_methods_keeps_one_copy_of_the_stored_vectors(spark, monkeypatch):
    from quillon.plans import tables

    kept, cut = [], tables.cut
    monkeypatch.setattr(tables, "cut", lambda df: kept.append(dict(df.dtypes).get("e")) or cut(df))
    got = tables.QUERIES["bootstrap_methods"](spark, "/root/testdata/sf0.001").collect()
    assert [x for x in kept if x] == ["array<float>"] and len(got) == 6


def test_bootstrap_report_over_several_ranges(spark):
    """The query itself, where no range holds all ranks of the quantile."""
    from quillon.plans import tables

    with pieces(spark):
        got = {r["metric"]: r for r in tables.QUERIES["bootstrap_report"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {"closed_macro_f1", "auroc", "fpr95"}
    assert all(r["lower"] <= r["estimate"] <= r["upper"] and r["n_replicates"] == 200 for r in got.values())
