"""Exact values of single operators, and nulls, empty tables, ties and odd columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import bits, text, vec
from quillon.operators import boxes, calibrate, centroids, diagrams, groups, hashjoin, metrics, prefix, resample, runs, scorers, splits
from quillon.operators.neighbors import nearest_neighbors


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize(
    ("raw", "want"), [(" Seg / Neut.", "seg_neut"), ("a--b\\c", "a_b_c"), ("\tX\t", "x"), ("", ""), ("___", ""), (None, None)]
)
def test_normalize_label(spark, raw, want):
    assert one(spark, text.normalize_label(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("raw", "want"), [("Known-Validation ", "validation"), ("UNKNOWN TEST", "test"), ("train\t", "train"), (" ", None), (None, None), ("dev", None)]
)
def test_split_name(spark, raw, want):
    assert one(spark, text.split_name(F.lit(raw).cast("string"))) == want


def test_hash64(spark):
    a, b = bits.hash64(F.lit(" 0xFF00000000000001")), bits.hash64(F.lit("1" * 8 + "0" * 55 + "1"))
    assert one(spark, a) == one(spark, b) < 0
    assert one(spark, bits.hash64(F.lit("xyz"))) is None
    assert one(spark, bits.hamming64(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64


def test_vectors(spark):
    assert one(spark, vec.cosine_distance(arr(3, 0), arr(0, 4))) == 1
    assert one(spark, vec.cosine_distance(arr(3, 0), arr(3, 0))) == pytest.approx(0)
    assert one(spark, vec.argmax(arr(1, 5, 5))) == 1
    assert sum(one(spark, vec.softmax(arr(1, 2, 3)))) == pytest.approx(1)
    assert one(spark, vec.log_sum_exp(arr(1000, 1000))) == pytest.approx(1000 + math.log(2))
    assert one(spark, vec.normalized_correlation(arr(1, 1), arr(1, 1))) == 1
    assert one(spark, vec.normalized_correlation(arr(1, 1), arr(2, 2))) == 0
    assert one(spark, vec.structural_similarity(arr(0.1, 0.9), arr(0.1, 0.9))) == pytest.approx(1)
    assert one(spark, vec.average_hash(arr(0, 1, 1, 0))) == "0110"
    assert one(spark, vec.total(F.array().cast("array<double>"))) == 0


def test_scores_point_to_unknown(spark):
    sure, flat = arr(8, 0, 0), arr(0.1, 0.1, 0.1)
    for f in (scorers.maximum_softmax, scorers.predictive_entropy, scorers.energy):
        assert one(spark, f(flat)) > one(spark, f(sure))
    with pytest.raises(ValueError):
        scorers.energy(sure, 0)
    with pytest.raises(ValueError):
        scorers.create_scorer("nothing")


def test_mahalanobis(spark):
    rows = [("a", [0.0, 0.0]), ("a", [0.1, 0.0]), ("b", [5.0, 5.0]), ("b", [5.1, 5.0])]
    df = spark.createDataFrame(rows, "label string, e array<double>")
    x = np.array([r[1] for r in rows])
    m = np.array([[0.05, 0], [5.05, 5]])
    d = x - np.repeat(m, 2, axis=0)
    p = np.linalg.pinv(d.T @ d / 3 + 1e-4 * np.eye(2))
    s = df.select(scorers.Mahalanobis("label", "e").fit(df).score().alias("s")).collect()
    assert [r["s"] for r in s] == pytest.approx([float(v @ p @ v) for v in d])


def frame(spark, y, s):
    return spark.createDataFrame(list(zip(y, map(float, s), strict=True)), "y int, s double")


def test_metrics(spark):
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    c = metrics.score_counts(df, [], F.col("y") == 1, F.col("s"))
    assert metrics.auroc(c, []).first()[0] == 1 and metrics.average_precision(c, []).first()[0] == 1
    assert metrics.fpr_at_tpr(df, [], F.col("y") == 1, F.col("s")).first()[0] == 0
    ties = metrics.score_counts(frame(spark, [0, 1], [0.5, 0.5]), [], F.col("y") == 1, F.col("s"))
    assert metrics.auroc(ties, []).first()[0] == 0.5
    empty = metrics.score_counts(df.where("s > 9"), [], F.col("y") == 1, F.col("s"))
    assert metrics.auroc(empty, []).first()[0] is None
    assert metrics.trapezoid(df.where("s < 0.15"), [], "s", "s", "a").first()[0] is None


def test_thresholds(spark):
    s = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4)], "s double")
    assert calibrate.strict_threshold(s, "s", 0.75).first()[0] == pytest.approx(0.325)
    assert calibrate.strict_threshold(s.where("s > 1"), "s").first()[0] is None
    assert calibrate.development_threshold(s, s.where("s > 1"), "s").count() == 0
    ref = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.4, 0.8)], "s double")
    rows = spark.createDataFrame([(x,) for x in (0.05, 0.2, 0.9)], "s double")
    got = calibrate.empirical_percentile(rows, ref, "s", "p").orderBy("s").collect()
    assert [r["p"] for r in got] == [0, 0.5, 1]
    reps = spark.createDataFrame(list(zip("abaab", (0.4, 0.0, 0.1, 0.9, 0.2), range(5), strict=True)), "l string, s double, i long")
    got = calibrate.representatives(reps, "l", "s", "i", [0.0, 0.5, 1.0]).where("l = 'a'").orderBy("s")
    assert [r["i"] for r in got.collect()] == [2, 0, 3]


def test_diagrams(spark):
    b = F.expr("array(struct(0D as birth, 1D as death), struct(0.25D as birth, 0.75D as death), struct(0.5D as birth, double('inf') as death))")
    assert one(spark, diagrams.betti_curve(b, arr(0, 0.25, 0.5, 0.75, 1))) == [1, 2, 3, 2, 1]
    assert one(spark, diagrams.essential_count(b)) == 1
    s = one(spark, diagrams.summary(b))
    assert (s["n"], s["total"], s["n_long"]) == (2, 1.5, 2)
    assert one(spark, diagrams.landscape(b, arr(0.5), 3)) == [0.5, 0.25, 0.0]
    none = F.filter(b, lambda x: x["birth"] > 9)
    assert one(spark, diagrams.entropy(none)) == 0 and one(spark, diagrams.summary(none))["n"] == 0
    df = spark.createDataFrame([([[0.0, 1.0]], [[0.0, 0.8]]), ([], []), ([[0.0, 1.0]], [])], "a array<array<double>>, b array<array<double>>")
    assert [round(r[0], 9) for r in df.select(diagrams.bottleneck("a", "b")).collect()] == [0.2, 0, 0.5]
    cloud = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]],), (None,)], "c array<array<double>>")
    assert [list(r[0]) for r in cloud.select(diagrams.tree_deaths("c")).collect()] == [[0.0, 1.0], []]


def box(*v):
    return F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x_min", "y_min", "x_max", "y_max"), strict=True)])


def test_boxes(spark):
    assert tuple(one(spark, boxes.clip(box(-5, 1, 8, 9), F.lit(16), F.lit(12)))) == (0, 1, 8, 9)
    assert one(spark, boxes.clip(box(3, 3, 3, 9), F.lit(16), F.lit(12))) is None
    assert one(spark, boxes.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    g = spark.createDataFrame([("i", "g1", 0.0, 0.0, 10.0, 10.0), ("i", "g2", 20.0, 20.0, 30.0, 30.0)], "image_id string, gt_id string, x_min double, y_min double, x_max double, y_max double")
    d = spark.createDataFrame([("i", "d1", 0.9, 0.0, 0.0, 10.0, 10.0), ("i", "d2", 0.8, 0.0, 0.0, 10.0, 9.0)], "image_id string, detection_id string, confidence double, x_min double, y_min double, x_max double, y_max double")
    m = boxes.match_boxes(d, g)
    assert sorted(r["status"] for r in m.collect()) == ["FP", "MISSED", "TP"]
    assert boxes.average_precision(boxes.match_boxes(d, g.where("gt_id = 'g1'")), []).first()["ap"] == 1
    assert boxes.match_boxes(d.limit(0), g.limit(0)).count() == 0


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(f"s{i}", "ab"[i % 2], f"g{i % 7}", i % 3 > 0) for i in range(90)], "id string, label string, g string, k boolean")
    got = splits.stratified_split(df, "id", "label", F.col("k")).groupBy("split", "label", "k").count().collect()
    assert sum(r["count"] for r in got) == 90 and {r["split"] for r in got if not r["k"]} == {"test"}
    assert splits.group_split(df, "g").count() == 7
    with pytest.raises(ValueError):
        splits.check_sizes(0.9, 0.2, 0.1)
    with pytest.raises(Exception, match="needs a group"):
        splits.group_split(df.withColumn("g", F.lit("")), "g").collect()
    assert splits.balanced_fill(df, "id", "label", 11).count() == 11
    assert splits.per_class_sample(df, "id", "label", 100).count() == 90
    assert splits.spanning_keys(df.withColumn("split", F.lit("train")), "g", "split").count() == 0


def test_resplit_keeps_components_whole(spark):
    df = spark.createDataFrame([("a", "x", "train"), ("b", "x", "test"), ("c", "x", "train"), ("d", "x", "train")], "id string, label string, split string")
    comp = spark.createDataFrame([("a", "k"), ("b", "k")], "id string, component string")
    assert [tuple(r) for r in splits.conservative_resplit(df, comp, "id", "label", "split").collect()] == [("k", "test,train", "train")]


def test_components_and_hash_pairs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("b", "a"), ("z", "z")], "a string, b string")
    got = {r["node"]: r["component"] for r in groups.star_components(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert groups.star_components(e.limit(0)).count() == 0
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    rows = [(f"r{i}", int(base[i % 40] ^ (1 << int(rng.integers(63)) if i > 40 else 0))) for i in range(160)] + [("null", None)]
    got = {(r[0], r[1]) for r in hashjoin.hamming_pairs(spark.createDataFrame(rows, "k string, h long"), "k", "h", 3).collect()}
    want = {tuple(sorted((a, b))) for i, (a, x) in enumerate(rows[:-1]) for b, y in rows[:i] if bin((x ^ y) & (2**64 - 1)).count("1") <= 3}
    assert got == want


def test_neighbors_and_prefix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(f"v{i:02}", [float(y) for y in x[i]]) for i in range(60)], "k string, v array<double>")
    got = {(r["id"], r["neighbor"]) for r in nearest_neighbors(df, df, "k", "v", 3, skip_self=True, block_rows=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(60)
    assert got == {(f"v{i:02}", f"v{j:02}") for i in range(60) for j in np.argsort(-s[i])[:3]}
    with pytest.raises(ValueError):
        nearest_neighbors(df, df, "k", "v", 0)
    r = spark.range(100).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 10).alias("p"), "id")
    got = prefix.running_total(r, ["k"], "p", ["id"], F.col("id"), "before").collect()
    assert all(t["before"] == sum(i for i in range(t["id"]) if i % 3 == t["k"]) for t in got)


def test_runs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 5.0)], "g string, v double")
    got = {r["g"]: r for r in runs.summary(df, ["g"], "v").collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["b"]["low"], got["b"]["sd"]) == (2, 2.0, 5.0, None)
    assert got["a"]["high"] == pytest.approx(2 + 12.706205 * math.sqrt(2) / math.sqrt(2))
    m = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 1.0)], "s int, side string, v double")
    assert [tuple(r) for r in runs.matched_deltas(m, ["s"], "side", "a", "b", "v").collect()] == [(1, 1.0, 3.0, 2.0)]


def test_replicates_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.random() < 0.3), float(round(rng.normal(), 1))) for i in range(700)] + [(900, 1, float("nan")), (901, None, 1.0), (902, 0, None)]
    got = resample.replicated_metrics(spark.createDataFrame(rows, "id long, y int, s double").repartition(3), 8, 5)
    ids, y, s = (np.array(c) for c in zip(*rows[:700], strict=True))
    weights = resample.poisson_weights(ids, 8, 5)
    for r in range(8):
        w = weights[:, r]
        pos, neg = np.repeat(s[y == 1], w[y == 1]), np.repeat(s[y == 0], w[y == 0])
        won = (pos[:, None] > neg[None, :]).sum() + (pos[:, None] == neg[None, :]).sum() / 2
        assert got["auroc"][r] == pytest.approx(won / (len(pos) * len(neg)))
        assert got["fpr95"][r] == pytest.approx((neg > np.quantile(pos, 1 - 0.95)).mean())
    many = resample.poisson_weights(np.arange(20_000), 10, 1)
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.03 and len({tuple(c) for c in many.T[:, :50]}) == 10
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert [(r["estimate"], r["n_replicates"]) for r in resample.bootstrap_open(one, 5).collect()] == [(None, 0), (None, 0)]
    same = spark.createDataFrame([(i % 2, i / 9, i / 9) for i in range(9)], "y int, a double, b double")
    assert {(r["estimate"], r["lower"], r["upper"]) for r in resample.bootstrap_delta(same, 5).collect()} == {(0.0, 0.0, 0.0)}
    f1 = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", None), (None, "a")], "truth string, given string")
    assert resample.bootstrap_macro_f1(f1, 20).first()["estimate"] == pytest.approx((2 / 3 + 2 / 4) / 2)
    assert resample.bootstrap_macro_f1(f1.limit(0)).first()["estimate"] is None


def test_centroids(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [2.0, 0.0]), ("b", [9.0, 0.0]), (None, [5.0, 5.0])], "label string, e array<double>")
    near = centroids.with_nearest(df, centroids.class_means(df, "label", "e"), "label", "e").where("label = 'b'").first()
    assert (near["nearest_label"], near["nearest"], near["margin"]) == ("b", 0.0, 8.0)
    z = centroids.standardized(df, df.where("label = 'a'"), "e", "z").where("label = 'a'")
    assert sorted(r["z"][0] for r in z.collect()) == [-1.0, 1.0] and {r["z"][1] for r in z.collect()} == {0.0}


def test_field_persistence(spark):
    from quillon.operators.homology import field_bars, field_persistence

    ring = np.zeros((5, 5))
    ring[1:4, 1:4] = 0.8
    ring[2, 2] = 0.2
    assert field_bars(ring) == [(0, 0.0, math.inf), (0, 0.2, 0.8), (1, 0.0, 0.8)]
    assert field_bars(np.array([[0.3]])) == [(0, 0.3, math.inf)]
    two = np.array([[0.0, 0.9, 0.1]])
    assert field_bars(two) == [(0, 0.0, math.inf), (0, 0.1, 0.9)]
    df = spark.createDataFrame([([[0.0, 0.9, 0.1]],), (None,), ([],)], "f array<array<double>>")
    assert [len(r[0]) for r in df.select(field_persistence("f")).collect()] == [2, 0, 0]


def test_cloud_persistence(spark):
    from quillon.operators.homology import cloud_bars, cloud_persistence

    t = np.linspace(0, 2 * np.pi, 12, endpoint=False)
    bars = cloud_bars(np.stack([np.cos(t), np.sin(t)], axis=1))
    step = 1 - math.cos(2 * np.pi / 12)
    assert [round(b[2] - step, 9) for b in bars if b[0] == 0 and b[2] < math.inf] == [0.0] * 11
    long = [b for b in bars if b[0] == 1]
    assert len(long) == 1 and long[0][1] == pytest.approx(step) and long[0][2] == pytest.approx(1.5)
    cluster = np.random.default_rng(2).normal(size=(12, 3)) * 0.01 + 1
    assert max([b[2] - b[1] for b in cloud_bars(cluster) if b[0] == 1], default=0) < 0.05
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]],), (None,)], "c array<array<double>>")
    assert [len(r[0]) for r in df.select(cloud_persistence("c")).collect()] == [2, 0]


def test_bottleneck_against_every_matching():
    from itertools import permutations

    rng = np.random.default_rng(11)
    for _ in range(60):
        n, m = rng.integers(0, 4, 2)
        p, q = (np.sort(rng.integers(0, 60, (k, 2)).astype(float), axis=1) for k in (n, m))
        half = lambda x: (x[1] - x[0]) / 2
        cost = lambda i, j: np.abs(p[i] - q[j]).max() if i < n and j < m else half(p[i]) if i < n else half(q[j]) if j < m else 0.0  # noqa: E731, B023
        want = min(max((cost(i, j) for i, j in enumerate(o)), default=0.0) for o in permutations(range(n + m)))
        assert diagrams.bottleneck_of(p, q) == want


def test_bottleneck_distances_keep_long_bars(spark, tmp_path):
    from quillon.plans.studies import bottleneck_distances

    rows = [(1, 1, "2024-01-01 00:00:00", 0.0), (2, 1, "2024-01-05 04:00:00", 0.0), (3, 2, "2024-01-01 00:00:00", 0.0), (4, 2, "2024-01-01 10:00:00", 0.0)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    # User 1 has one finite bar of 100 h, user 2 one of 10 h: both go to the diagonal, the longer decides.
    assert [tuple(r) for r in bottleneck_distances(spark, str(tmp_path)).collect()] == [(1, 50.0)]


def test_cloud_bars_against_boundary_reduction():
    from itertools import combinations

    from quillon.operators.homology import cloud_bars

    def plain(x, longest):
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = np.clip(1 - u @ u.T, 0, 2)
        size = lambda s: max((d[p] for p in combinations(s, 2)), default=0.0)
        cells = sorted((s for k in (1, 2, 3) for s in combinations(range(len(x)), k) if size(s) <= longest), key=lambda s: (size(s), len(s)))
        place, low, bars, open_ = {s: i for i, s in enumerate(cells)}, {}, [], set()
        for i, s in enumerate(cells):
            column = {place[f] for f in combinations(s, len(s) - 1)} if len(s) > 1 else set()
            while column and max(column) in low:
                column ^= low[max(column)]
            if not column:
                open_.add(i)
                continue
            m = max(column)
            low[m] = column
            open_.discard(m)
            if len(s) == 2 or size(s) > size(cells[m]):
                bars.append((len(s) - 2, float(size(cells[m])), float(size(s))))
        return sorted(bars + [(len(cells[i]) - 1, float(size(cells[i])), math.inf) for i in open_ if len(cells[i]) < 3])

    rng = np.random.default_rng(4)
    for i in range(24):
        x = rng.normal(size=(int(rng.integers(2, 16)), int(rng.integers(2, 6))))
        x, longest = np.round(x) if i % 3 == 0 else x, (2.0, 0.9, 0.4)[i % 2 + (i % 5 == 0)]
        got, want = cloud_bars(x, longest), plain(x, longest)
        assert len(got) == len(want)
        assert all(g[0] == w[0] and g[1:] == pytest.approx(w[1:]) for g, w in zip(got, want, strict=True))


@pytest.fixture(scope="module")
def class_archive(spark, tmp_path_factory):
    """One class of 200 test samples on a noisy circle and one of 30."""
    rng, folder = np.random.default_rng(6), tmp_path_factory.mktemp("archive")
    t = rng.uniform(0, 2 * np.pi, 230)
    x = np.zeros((230, 96))
    x[:, 0], x[:, 1], x[:, 70] = np.cos(t), np.sin(t), rng.normal(size=230) * 0.1
    rows = [(f"s{i}", "many" if i < 200 else "few", "known", "test", [float(v) for v in x[i]], [0.0] * 5) for i in range(230)]
    spark.createDataFrame(rows, "sample_id string, true_label string, known_status string, split string, embedding array<double>, logits array<double>").write.parquet(str(folder / "embedding_archive.parquet"))
    return str(folder)


def test_rips_summary_takes_192_points(spark, class_archive):
    from quillon.plans.composites import rips_summary

    got = {(r["label"], r["dim"]): r for r in rips_summary(spark, class_archive).collect()}
    assert {k: (r["n_bars"], r["n_essential"]) for k, r in got.items() if k[1] == 0} == {("many", 0): (191, 1), ("few", 0): (29, 1)}
    assert got["many", 1]["longest"] > 1 and got["many", 1]["n_essential"] == 0


def test_class_tree_summary_shares_the_sample(spark, class_archive):
    from quillon.plans.composites import rips_summary
    from quillon.plans.studies import class_tree_summary

    got = {r["label"]: r for r in class_tree_summary(spark, class_archive).collect()}
    assert {k: (r["n_points"], r["n_bars"]) for k, r in got.items()} == {"many": (192, 191), "few": (30, 29)}
    for r in rips_summary(spark, class_archive).where("dim = 0").collect():
        assert (r["total"], r["longest"]) == pytest.approx((got[r["label"]]["total"], got[r["label"]]["longest"]), abs=2e-6)


def test_field_persistence_summary_reads_every_coordinate(spark, tmp_path):
    from quillon.plans.composites import field_persistence_summary

    e = [1.0] * 96
    e[0], e[90] = 0.0, 0.5
    rows = [("s", "a", "known", "test", e, [0.0] * 5)]
    spark.createDataFrame(rows, "sample_id string, true_label string, known_status string, split string, embedding array<double>, logits array<double>").write.parquet(str(tmp_path / "embedding_archive.parquet"))
    assert [tuple(r) for r in field_persistence_summary(spark, str(tmp_path)).collect()] == [("s", 2, 0)]
