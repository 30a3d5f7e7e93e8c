"""Operators of the nine problems against brute force, and their odd inputs."""

import base64
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import (
    byte_bpe, coverage_cutoff, cube_sample, match_groups, related_splits, source_mixture, split_overlap, subject_model, vector_neighbors,
)

T0 = dt.datetime(2025, 1, 1)


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def graph(n=300, seed=1):
    rng = random.Random(seed)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    rng.shuffle(chain)
    star = [("hub", f"s{i:03}") for i in range(80)]
    loose = [(f"r{rng.randrange(n):03}", f"r{rng.randrange(n):03}") for _ in range(n // 2)]
    return [*chain, *star, *(e for e in loose if e[0] != e[1])]


AUDIT = "left_image_id string, right_image_id string, hamming int, id string, group_id string"


def audit(spark, rows):
    return spark.createDataFrame([(a, b, h, "clash", "clash") for a, b, h in rows], AUDIT)


def test_groups_match_union_find(spark):
    edges = graph()
    rows = [*((a, f" {b.upper()} ", 0) for a, b in edges), *((b, a, 4) for a, b in edges[:50])]
    rows += [("lone", "other", 5), ("lone", None, 0), (" ", "x", 0), ("same", "SAME", 0), ("n", "m", None)]
    got = match_groups.connected_groups(match_groups.matching_pairs(audit(spark, rows)), "left_id", "right_id")
    assert {r["id"]: r["group_id"] for r in got.collect()} == union_find(edges)
    images = spark.createDataFrame([("C000", 1), ("lone", 1), (None, 1), ("  ", 1), ("c120 ", 1)], "image_id string, group_id int")
    got = {r["image_id"]: r["group_id"] for r in match_groups.image_groups(images, audit(spark, rows)).collect()}
    assert got == {"c000": "c000", "lone": "lone", "c120": "c000"}
    empty = audit(spark, [])
    assert match_groups.connected_groups(match_groups.matching_pairs(empty), "left_id", "right_id").count() == 0


IMAGE = "image_id string, split string, source string, sha256 string, average_hash string, hash long"


def test_overlaps_match_brute_force(spark):
    rng = random.Random(2)
    rows, bits = [], {}
    base = [rng.getrandbits(64) for _ in range(25)]
    for i in range(260):
        h = base[i % 25]
        for _ in range(rng.randrange(7)):
            h ^= 1 << rng.randrange(64)
        split = rng.choice(["train", "Train ", "known_validation", "test", "", None])
        text = rng.choice([f"{h:016x}", f"0x{h:016X}", f"{h:064b}", None, "bad"])
        sha = rng.choice([f"sum{i % 40}", "", None])
        rows.append((f"I{i}", split, "src", sha, text, 7))
        bits[f"i{i}"] = (split, sha, h if text and text != "bad" else None)
    rows += rows[:30]
    listed = [("i1", "I2", 1), ("i3", "i4", 9)]
    got = {tuple(sorted((r["train_id"], r["eval_id"]))) for r in split_overlap.cross_split_pairs(spark.createDataFrame(rows, IMAGE), audit(spark, listed)).collect()}
    name = lambda s: {"train": "t", "Train ": "t", "known_validation": "e", "test": "e"}.get(s)
    want = set()
    for a, (sa, ca, ha) in bits.items():
        for b, (sb, cb, hb) in bits.items():
            if name(sa) == "t" and name(sb) == "e":
                near = ha is not None and hb is not None and (ha ^ hb).bit_count() <= 4
                if near or (ca and ca == cb) or {a, b} == {"i1", "i2"}:
                    want.add(tuple(sorted((a, b))))
    assert got == want and want
    none = spark.createDataFrame([], IMAGE)
    assert split_overlap.cross_split_pairs(none, audit(spark, listed)).count() == 0
    assert split_overlap.overlap_report(none, audit(spark, [])).count() == 0
    report = split_overlap.overlap_report(spark.createDataFrame(rows, IMAGE), audit(spark, listed)).agg(F.sum("n_pairs")).first()[0]
    assert report == len(want)


@pytest.mark.parametrize(("pieces", "hot"), [(6, 3), (8, 100), (10, 2)])
def test_overlaps_of_any_pieces_and_hot_passages(spark, pieces, hot):
    rng = random.Random(3)
    base = [0, rng.getrandbits(64)]
    near = lambda h: h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8)))
    sides = [[near(base[i % 2]) for i in range(40)] + [rng.getrandbits(64) for _ in range(20)] for _ in range(2)]
    sides = [sorted(set(s)) for s in sides]
    text = lambda h: str(h - (1 << 64) if h >= 1 << 63 else h)
    frames = [spark.createDataFrame([("hash", text(h)) for h in s] + [("checksum", text(s[0])), ("checksum", "x")], "kind string, value string") for s in sides]
    widths = [64 // pieces + (i < 64 % pieces) for i in range(pieces)]
    got = split_overlap.overlapping_values(*frames, widths=widths, hot_owners=hot).collect()
    found = {(r["eval_value"], r["train_value"]): r["bits"] for r in got if r["kind"] == "hash"}
    assert found == {(text(a), text(b)): (a ^ b).bit_count() for a in sides[0] for b in sides[1] if (a ^ b).bit_count() <= 4}
    assert len(found) == sum(r["kind"] == "hash" for r in got) > 20
    assert [(r["eval_value"], r["covered"]) for r in got if r["kind"] == "checksum" and r["eval_value"] == "x"] == [("x", 2**pieces - 1)]


def test_candidates_grow_as_the_hashes():
    each = []
    for n in (10**5, 10**7, 10**9):
        widths = split_overlap.piece_widths(n)
        kept = sorted(widths)[: len(widths) - split_overlap.MAX_BITS]
        each.append(n * len(split_overlap._choices(widths)) / 2 ** sum(kept))
    assert max(each) <= 250 and split_overlap.piece_widths(1) == [11, 11, 11, 11, 10, 10]


def test_covered_bits(spark):
    a, b = 0, 1 << 63
    one = lambda v: spark.createDataFrame([("hash", str(v - (1 << 64) if v >= 1 << 63 else v))], "kind string, value string")
    r = split_overlap.overlapping_values(one(a), one(b)).first()
    assert (r["bits"], r["covered"]) == (1, 0b011111)


SIGNAL = "sample_id string, dataset string, split string, known_or_unknown string, confidence double, unknown_score double, scored_at timestamp, r string, x double"
POINT = "point_id int, strategy string, target_coverage double, dataset string"


@pytest.mark.parametrize(("k", "margin"), [(400, 0.02), (8, 0.001)])
def test_cutoffs_match_brute_force(spark, k, margin):
    rng = random.Random(3)
    rows, want_rows = [], []
    for i in range(600):
        d = rng.choice(["A", " a", "b", "c"])
        c = rng.choice([round(rng.random(), 1), round(rng.random(), 6)])
        rows.append((f"s{i}", d, "known_validation", "Known ", c, 1 - c, T0, "clash", 1.0))
        want_rows.append((d.strip().lower(), c))
    rows += [("s0", "A", "train", "known", 0.5, 0.5, T0 - dt.timedelta(1), "", 0.0), (None, "A", "validation", "known", 0.5, 0.5, T0, "", 0.0)]
    rows += [(f"z{i}", "a", s, "known", v, v, T0, "", 0.0) for i, (s, v) in enumerate([("train", 0.5), ("validation", math.nan), ("validation", 1.5), ("validation", None)])]
    points = [(1, "confidence only", 0.7, "clash"), (1, "confidence_only", 0.7, "clash"), (2, "CONFIDENCE_MARGIN_MSP_QC", 1.0, ""), (3, "confidence_margin", 0.5, ""), (4, "confidence_only", math.nan, ""), (5, "confidence_only", None, ""), (6, "confidence_only", 0.05, "")]
    scores = coverage_cutoff.known_validation_scores(spark.createDataFrame(rows, SIGNAL))
    cuts = coverage_cutoff.coverage_cutoffs(scores, coverage_cutoff.target_points(spark.createDataFrame(points, POINT)), k, margin)
    got = {(r["point_id"], r["dataset"]): (r["x"], r["n_kept"], r["n_ties"]) for r in cuts.collect()}
    want = {}
    for p, t, high in ((1, 0.7, True), (2, 1.0, False), (6, 0.05, True)):
        for d in "abc":
            x = sorted(-c if high else 1 - c for e, c in want_rows if e == d)
            cut = next(v for v in x if sum(y <= v for y in x) / len(x) >= t)
            want[(p, d)] = (cut, sum(y <= cut for y in x), x.count(cut))
    assert got == want
    empty = spark.createDataFrame([], SIGNAL)
    assert coverage_cutoff.dataset_cutoffs(empty, spark.createDataFrame(points, POINT)).count() == 0
    assert coverage_cutoff.dataset_cutoffs(spark.createDataFrame(rows, SIGNAL), spark.createDataFrame([], POINT)).count() == 0


MANIFEST = "sample_id string, canonical_label string, known_status string, label string, plan_id int"
TARGET = "plan_id int, canonical_label string, known_status string, target_fraction double, min_rows bigint, sample_size bigint, needed string"
ALIAS = "alias string, canonical_label string"


def test_flight_keeps_balances():
    rng = np.random.default_rng(1)
    x = (rng.random((400, 5)) < 0.4).astype(float)
    pi = rng.random(400)
    got = cube_sample.flight(pi, x, rng)
    assert np.allclose(x.T @ got, x.T @ pi, atol=1e-6)
    left = (got > 0) & (got < 1)
    assert left.sum() <= 5
    done = cube_sample.landing(got, x, rng)
    assert set(np.unique(done)) <= {0.0, 1.0} and np.abs(x.T @ (done - pi)).max() <= 5
    mean = np.mean([cube_sample.flight(np.full(4, 0.25), np.ones((4, 1)), np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.allclose(mean, 0.25, atol=0.03)


@pytest.mark.parametrize("block_rows", [20_000, 16])
def test_sample_meets_targets(spark, block_rows):
    rows = [(f"s{i}", ["Neutrophil", "seg neut", "eos.", "rare"][0 if i < 700 else 1 + i % 3], " Known", "clash", 9) for i in range(1000)]
    rows += [*rows[:50], ("s1", "eosinophil", "known", "", 0), (None, "eos", "known", "", 0), (" ", "eos", "known", "", 0), ("t", None, None, "", 0), ("u", "eos", "unknown", "", 0)]
    alias = [("neutrophil", "neut"), ("seg_neut", "neut"), ("eos", "Eosinophil")]
    targets = [(1, "neut", "known", 0.5, 0, 100, "x"), (1, "EOSINOPHIL", "known", 0.3, 0, 100, "x"), (1, "rare", "known", 0.2, 120, 100, "x"), (1, "nobody", "known", 0.1, 0, 100, "x"), (2, "neut", "known", 0.333, 5, 10, "x"), (3, "rare", "known", None, None, None, "x")]
    args = spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(targets, TARGET), spark.createDataFrame(alias, ALIAS)
    sample, report = cube_sample.balanced_sample(*args, block_rows=block_rows)
    r = {(x["plan_id"], x["label"]): x for x in report.collect()}
    assert r[1, "neut"]["selected"] == 50 and r[1, "eosinophil"]["selected"] == 30
    assert r[1, "rare"]["short"] and r[1, "rare"]["selected"] == r[1, "rare"]["available"] == 100 and r[1, "rare"]["needed"] == 120
    assert r[1, "nobody"]["short"] and r[1, "nobody"]["available"] == 0
    assert not r[2, "neut"]["short"] and abs(r[2, "neut"]["selected"] - 5) <= 1
    assert r[1, "neut"]["available"] == 700 + sum(i % 3 == 0 for i in range(700, 1000))
    got = sorted(tuple(x) for x in sample.collect())
    assert len(got) == len({(g[0], g[3]) for g in got})
    assert got == sorted(tuple(x) for x in cube_sample.balanced_sample(*args, block_rows=block_rows)[0].collect())


def test_category_flight_keeps_each_count():
    rng = np.random.default_rng(2)
    category = rng.integers(0, 9, 3000) * 10**15
    pi = rng.random(3000)
    pi[:5] = [0, 1, 1e-12, 1 - 1e-12, 0.5]
    got = cube_sample.category_flight(pi, category, rng)
    for c in np.unique(category):
        assert abs(got[category == c].sum() - pi[category == c].sum()) < 1e-6 and ((got > 0) & (got < 1) & (category == c)).sum() <= 1
    done = cube_sample.category_landing(got, rng)
    assert set(np.unique(done)) <= {0.0, 1.0} and abs(done.sum() - pi.sum()) <= 1
    assert all(abs(done[category == c].sum() - pi[category == c].sum()) <= 1 for c in np.unique(category))
    mean = np.mean([cube_sample.category_flight(np.array([0.2, 0.7, 0.6, 0.5]), np.zeros(4), np.random.default_rng(s)) for s in range(6000)], axis=0)
    assert np.allclose(mean, [0.2, 0.7, 0.6, 0.5], atol=0.03)
    assert len(cube_sample.category_flight(np.zeros(0), np.zeros(0, dtype=int), rng)) == 0


def test_shortages_are_handed_on(spark):
    rows = [(f"s{i}", "abc"[min(2, i // 100)], "known", "", 0) for i in range(205)] + [("s0", "c", "known", "", 0), ("s150", "c", "known", "", 0)]
    targets = [(1, "a", "known", 0.5, 0, 150, ""), (1, "b", "known", 0.25, 0, 150, ""), (1, "c", "known", 0.25, 0, 150, ""), (2, "a", "known", 0.9, 0, 1000, ""), (2, "c", "known", 0.1, 7, 70, "")]
    args = spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(targets, TARGET), spark.createDataFrame([], ALIAS)
    sample, report = cube_sample.balanced_sample(*args)
    r = {(x["plan_id"], x["label"]): x for x in report.collect()}
    assert r[1, "c"]["available"] == 7 and r[1, "c"]["selected"] == 7 and r[1, "c"]["short"]
    assert r[1, "a"]["selected"] + r[1, "b"]["selected"] == 143 and r[1, "a"]["selected"] in (96, 95) and not r[1, "a"]["short"]
    assert r[2, "a"]["selected"] == 99 and r[2, "a"]["short"] and r[2, "c"]["selected"] == 7 and not r[2, "c"]["short"]
    assert sample.groupBy("plan_id").count().where("plan_id = 1").first()["count"] == 150


def test_sample_of_nothing(spark):
    none = spark.createDataFrame([], MANIFEST), spark.createDataFrame([(1, "a", "known", 0.5, 1, 10, "")], TARGET), spark.createDataFrame([], ALIAS)
    sample, report = cube_sample.balanced_sample(*none)
    assert sample.count() == 0 and report.first()["short"]
    assert cube_sample.balanced_sample(none[0], none[1].limit(0), none[2])[1].count() == 0


TRIAGE = "sample_id string, config_id int, group_id string, donor_id string, split string, known_or_unknown string, component string"
CONFIG = "config_id int, method string, train_size double, validation_size double, test_size double, seed int, sample_id string"


def test_components_by_frontier(spark):
    edges = graph(seed=5)
    df = spark.createDataFrame([*edges, *edges[:20], ("loop", "loop")], "a string, b string")
    got = related_splits.frontier_components(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, related_splits.frontier_components(df.repartition(7)).collect()))
    split = related_splits.frontier_components(related_splits.split_hubs(df, 8)).where("node not like 'p%:%'").collect()
    assert len({r["component"] for r in split}) == len({r["component"] for r in got}) and len(split) == len(got)
    parts, want = {}, {}
    for r in got:
        parts.setdefault(r["component"], set()).add(r["node"])
    for k, v in {**union_find(edges), "loop": "loop"}.items():
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))
    assert related_splits.frontier_components(spark.createDataFrame([], "a string, b string")).count() == 0


def triage(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        g = rng.choice([f"G{rng.randrange(60)}", f" g{rng.randrange(60)}", "hub", "", " ", None, "N/A", "unknown"])
        d = rng.choice([f"d{rng.randrange(90)}", None, None, "Unknown", "n/a"])
        rows.append((f"s{i}", rng.choice([1, 2, 9]), g, d, rng.choice(["train", "train", "Known Test", "validation", None]), rng.choice(["known", "known", "Unknown"]), "clash"))
    rows += [(r[0], 1, None, r[3], "train", r[5], "clash") for r in rows[:60]]
    configs = [(1, "Group-Stratified", 0.7, 0.15, 0.15, 1, "c"), (2, "group stratified", 0.6, 0.2, 0.2, None, "c"), (9, "stratified", 0.7, 0.15, 0.15, 1, "c"), (3, None, 0.1, 0.1, 0.8, 1, "c"), (4, "group_stratified", 0.9, 0.1, None, 1, "c")]
    return rows, spark.createDataFrame(rows, TRIAGE), spark.createDataFrame(configs, CONFIG)


@pytest.mark.parametrize("hub_degree", [10_000, 8])
def test_broken_relations_match_brute_force(spark, hub_degree):
    rows, df, configs = triage(spark)
    used = [r for r in rows if r[1] in (1, 2)]
    key = lambda x: None if x is None or x.strip().lower() in ("", "n/a", "unknown") else x.strip().lower()
    edges = [("r" + r[0], k + key(v)) for r in used for k, v in (("g", r[2]), ("d", r[3])) if key(v)]
    part = union_find([*edges, *(("r" + r[0], "r" + r[0]) for r in used)])
    seen = {}
    for r in used:
        if r[4]:
            seen.setdefault(part["r" + r[0]], set()).add(r[4].lower().split()[-1])
    want = {r[0] for r in used if len(seen.get(part["r" + r[0]], ())) > 1}
    got = related_splits.broken_relations(df, configs, hub_degree)
    assert {r["sample_id"] for r in got.collect()} == want and got.count() == len(want)
    placed = related_splits.assigned_splits(df, configs, hub_degree).collect()
    assert {r["config_id"] for r in placed} == {1, 2}
    homes = {}
    for r in placed:
        homes.setdefault((r["config_id"], part["r" + r["sample_id"]]), set()).add(r["split"])
        assert r["status"] == "known" or r["split"] == "test"
    assert all(len(v) == 1 for v in homes.values())
    for c, size in ((1, 0.7), (2, 0.6)):
        known = [r for r in placed if r["config_id"] == c and r["status"] == "known"]
        mixed = {part["r" + r["sample_id"]] for r in placed if r["config_id"] == c and r["status"] != "known"}
        sets = {}
        for r in known:
            k = part["r" + r["sample_id"]]
            if k not in mixed:
                sets[k] = sets.get(k, 0) + 1
        free = sum(sets.values())
        want = min(size * len(known), free * size / (size + (1 - size) / 2))
        assert abs(sum(r["split"] == "train" for r in known) - want) <= max(sets.values())
    none = df.limit(0)
    assert related_splits.broken_relations(none, configs).count() == 0 and related_splits.assigned_splits(none, configs).count() == 0


ARCHIVE = "sample_id string, embedding array<float>, id string, unit string"


@pytest.mark.parametrize("hot_rows", [500_000, 40])
def test_neighbors_reach_brute_force(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(vector_neighbors, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(vector_neighbors, "HOT_PAIRS", hot_rows)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(80, 96))
    x = np.repeat(centers, 12, axis=0) + rng.normal(size=(960, 96)) * 0.22
    x = (x * rng.uniform(0.1, 50, (960, 1))).astype(np.float32)
    x[:12] = x[0]
    rows = [(f"v{i:04}", [float(v) for v in x[i]], "clash", "clash") for i in range(960)]
    bad = [("n1", None), ("n2", []), ("n3", [1.0]), ("n4", [0.0] * 96), ("n5", [math.nan] * 96), ("n6", [math.inf] * 96), (None, [1.0] * 96), ("n7", [None] * 96)]
    df = spark.createDataFrame([*rows, *rows[:40], *((a, b, "", "") for a, b in bad)], ARCHIVE)
    got = {(r[0], r[1]) for r in vector_neighbors.similar_pairs(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(960):
        for j in sorted(range(960), key=lambda j: (-s[i, j], j))[:5]:
            if s[i, j] >= 0.9:
                want.add((f"v{min(i, j):04}", f"v{max(i, j):04}"))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert vector_neighbors.similar_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 12_000])
def test_neighbors_at_the_threshold_are_whole(spark, n):
    """Pairs just above the similarity, of which the planned tables of a hashed search miss some."""
    rng = np.random.default_rng(4)
    u = rng.normal(size=(n, 96))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.normal(size=(n, 96))
    v -= (u * v).sum(axis=1, keepdims=True) * u
    v = 0.90001 * u + math.sqrt(1 - 0.90001**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = list(zip([f"{s}{i:05}" for s in "uv" for i in range(n)], np.vstack([u, v]).tolist(), strict=True))
    got = {(r[0], r[1]) for r in vector_neighbors.similar_pairs(spark.createDataFrame(rows, "sample_id string, embedding array<float>")).collect()}
    assert got == {(f"u{i:05}", f"v{i:05}") for i in range(n)}


def test_close_pairs_of_small_blocks(spark, monkeypatch):
    """Several numbers of blocks, pairs dropped early, against brute force."""
    for name, size in (("BLOCK_ROWS", 5), ("PART_BLOCKS", 2), ("TILE_ROWS", 3), ("EXACT_AT_ONCE", 7), ("PAIRS_HELD", 20), ("AXES", 3)):
        monkeypatch.setattr(vector_neighbors, name, size)
    rng = np.random.default_rng(6)
    for n in (1, 9, 15, 37, 64):
        x = (np.repeat(rng.normal(size=(-(-n // 8), 12)), 8, axis=0)[:n] + rng.normal(size=(n, 12)) * 0.3).astype(np.float32)
        rows = spark.createDataFrame([(i, [float(t) for t in e]) for i, e in enumerate(x)], "id long, embedding array<float>")
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        s = u @ u.T
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if s[i, j] >= 0.9}
        found = [(r["a"], r["b"]) for r in vector_neighbors.close_pairs(rows, 0.9, n).collect()]
        assert len(found) == len(set(found)) and set(found) == want
        near = {(r["a"], r["b"]) for r in vector_neighbors.close_pairs(rows, 0.9, 2).collect()}
        least = {(min(i, j), max(i, j)) for i in range(n) for j in sorted((j for j in range(n) if j != i), key=lambda j: -s[i, j])[:2] if s[i, j] >= 0.9}
        assert least <= near <= want
        axes = np.linalg.qr(rng.normal(size=(12, 12)))[0][:, :3]
        one = vector_neighbors._Close(np.arange(n), x, axes, 0.9, 2)
        one.meet(np.arange(n), x, True)
        got = one.result()
        assert least <= set(zip(got["a"], got["b"], strict=True)) <= want


def test_probe_order():
    sets = vector_neighbors.perturbations(3, 200)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets)
    assert all(5 - j not in s for s in sets for j in s)
    assert vector_neighbors.plan_search(10**9, 0.9).depth > vector_neighbors.plan_search(10**6, 0.9).depth


@pytest.mark.parametrize("n", [8_000, 80_000, 800_000])
def test_planned_tables_reach_the_recall_at_the_radius(n):
    plan = vector_neighbors.plan_search(n, 0.9)
    rng = np.random.default_rng(9)
    x = rng.random((4000, plan.depth)) * plan.width
    y = x + rng.normal(0, math.sqrt(0.2), x.shape)
    sets = vector_neighbors.perturbations(plan.depth, plan.probes)

    def probed(v):
        h = np.floor(v / plan.width).astype(int)
        walls = sorted((w, j, step) for j in range(plan.depth) for w, step in ((v[j] / plan.width - h[j], -1), (h[j] + 1 - v[j] / plan.width, 1)))
        for s in sets:
            key = h.copy()
            for k in s:
                key[walls[k][1]] += walls[k][2]
            yield tuple(key)

    home = lambda v: tuple(np.floor(v / plan.width).astype(int))
    p = np.mean([home(b) in set(probed(a)) or home(a) in set(probed(b)) for a, b in zip(x, y, strict=True)])
    assert 1 - (1 - p) ** plan.tables >= 0.999


ODD = ["", "a", " ", "don't stop  now\n\n x", "<|endoftext|> hi", "naïve Füße año", "​\x1c\x85 \t", "中文字符 😀👨‍🔬", "x" * 20_000, " " * 5000, "ab" * 4000, "1234567 890", "��"]


def test_ids_match_the_library(spark):
    import tiktoken

    ranks = byte_bpe.load_ranks()
    lib = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S").replace(r"[^\s", r"[^\s"), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice("ab e\n\tñß中.,'s19_") for _ in range(rng.randrange(80))) for _ in range(300))]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*texts, None])], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.text_ids(df).collect()}
    assert all(got[i] == lib.encode_ordinary(t) for i, t in enumerate(texts)) and got[len(texts)] == []
    assert all(lib.decode(got[i]) == t for i, t in enumerate(texts))
    assert byte_bpe.text_ids(df.limit(0)).count() == 0


def test_merge_takes_the_leftmost_least(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258}
    assert byte_bpe.merge_piece(b"aaaab", ranks) == [256, 256, ord("b")]
    assert byte_bpe.merge_piece(b"aab", ranks) == [256, ord("b")]
    f = tmp_path / "r"
    f.write_bytes(b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items()))
    assert byte_bpe.load_ranks(str(f)) == ranks


DOC = "doc_id bigint, source string, text string, n_tokens string, labels string"
MIX = "mix_id int, source string, target_weight double, max_repeats int, budget_tokens bigint, slot string"


def test_mixture(spark):
    docs = [(i, ["Big", "big ", "mid", "small"][min(3, i // 40)], "word " * (20 + i % 7), "clash", "") for i in range(130)]
    docs += [(999, None, "word", "", ""), (1000, "mid", None, "", ""), (1001, "mid", "", "", ""), (None, "mid", "word", "", ""), docs[0]]
    mixes = [(1, "big", 0.5, 1, 3000, "x"), (1, "mid", 0.25, 3, 3000, "x"), (1, "Small", 0.25, 2, 3000, "x"), (2, "absent", 0.6, 9, 500, "x"), (2, "big", 0.4, 1, 500, "x"), (3, None, 1.0, 1, 10, "x"), (4, "big", None, None, None, "x")]
    args = spark.createDataFrame(docs, DOC), spark.createDataFrame(mixes, MIX)
    mixture, report = source_mixture.mix_sources(*args, block_tokens=16)
    r = {(x["mix_id"], x["source"]): x for x in report.collect()}
    tokens = {x["source"]: x["n"] for x in source_mixture.document_tokens(args[0]).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert r[1, "small"]["short"] and r[2, "absent"]["short"] and r[2, "absent"]["source_tokens"] == 0
    assert not r[1, "big"]["short"] and r[1, "big"]["source_tokens"] == tokens["big"]
    assert abs(r[1, "big"]["mixed_tokens"] - 1500) <= 48 and abs(r[1, "mid"]["mixed_tokens"] - 750) <= 48
    assert r[1, "small"]["mixed_tokens"] == r[1, "small"]["capacity"] == 2 * tokens["small"]
    assert r[1, "big"]["holding_tokens"] == min(tokens["big"] / 0.5, 3 * tokens["mid"] / 0.25, 2 * tokens["small"] / 0.25)
    assert r[2, "big"]["holding_tokens"] == 0
    used = mixture.groupBy("mix_id", "source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n"), F.max("repeat").alias("m")).collect()
    assert all(u["n"] == r[u["mix_id"], u["source"]]["mixed_tokens"] for u in used)
    blocks = source_mixture.shuffled_blocks(source_mixture.document_tokens(args[0]), 16).groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n"))
    assert {b["source"]: b["n"] for b in blocks.collect()} == tokens
    empty = source_mixture.mix_sources(args[0].limit(0), args[1], block_tokens=16)
    assert empty[0].count() == 0 and empty[1].where("short").count() == 5
    assert source_mixture.mix_sources(args[0], args[1].limit(0))[1].count() == 0


def test_a_repeated_source_fills_every_slot(spark):
    docs = spark.createDataFrame([(1, "a", "word " * 9, "", ""), (2, "a", "word " * 11, "", ""), (3, "b", "word " * 3, "", "")], DOC)
    lengths = {r["doc_id"]: r["n_tokens"] for r in source_mixture.document_tokens(docs).collect()}
    budget = 16 * 7
    mixes = spark.createDataFrame([(1, "a", 1.0, 10, budget, ""), (2, "b", 1.0, 40, budget, ""), (3, "a", 1.0, 2, budget, "")], MIX)
    mixture, report = source_mixture.mix_sources(docs, mixes, block_tokens=16)
    r = {x["mix_id"]: x for x in report.collect()}
    assert [r[m]["short"] for m in (1, 2, 3)] == [False, False, True]
    assert [r[m]["mixed_tokens"] for m in (1, 2, 3)] == [budget, budget, 2 * (lengths[1] + lengths[2])]
    rows, seen = mixture.collect(), {}
    assert len({tuple(x)[:5] for x in rows}) == len(rows)
    for x in rows:
        seen.setdefault((x["mix_id"], x["repeat"], x["doc_id"]), []).extend(range(x["from_token"], x["to_token"]))
    assert all(len(set(t)) == len(t) and max(t) < lengths[k[2]] for k, t in seen.items())
    for m, docs_of in ((1, (1, 2)), (2, (3,)), (3, (1, 2))):
        rounds = r[m]["mixed_tokens"] // sum(lengths[i] for i in docs_of)
        assert all(len(seen[m, k, i]) == lengths[i] for k in range(rounds) for i in docs_of)
        assert sum(len(t) for k, t in seen.items() if k[0] == m) == r[m]["mixed_tokens"]


def test_golden_points_at_any_slot(spark):
    slots = [0, 1, 2, 3, 10**6, 2**32 + 5, 2**47, 2**48 - 1, 2**48, 2**62]
    got = spark.createDataFrame([(s,) for s in slots], "slot bigint").select("slot", source_mixture.golden_point(F.col("slot")).alias("u")).collect()
    turn = 2**48
    assert {r["slot"]: r["u"] for r in got} == {s: (s + 1) * source_mixture._GOLDEN % turn / turn for s in slots}


WORDS = {"law": ["court", "clause", "licence", "appeal"], "sport": ["match", "goal", "team", "race"], "software": ["build", "parser", "commit", "server"]}


def test_subjects(spark):
    rng = random.Random(7)
    docs, labels, truth = [], [], {}
    for i in range(400):
        names = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        sents = [f"The {rng.choice(WORDS[n])} and the {rng.choice(WORDS[n])} came up again." for n in names for _ in range(4)] + ["See the attached list."] * 2
        rng.shuffle(sents)
        docs.append((i, " ".join(sents), "clash"))
        truth[i] = set(names)
        if i < 200:
            labels += [(i, f" {n.upper()} ", "clash") for n in names]
    docs += [(900, None, ""), (901, "", ""), (902, " \t\n", ""), (903, "word " * 50_000, "")]
    labels += [labels[0], (5, "none", ""), (6, None, ""), (None, "law", ""), (12345, "law", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, labels string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, text string")
    areas = spark.createDataFrame([(n, "") for n in WORDS], "subject string, name string")
    got = {}
    for r in subject_model.document_subjects(d, lab, areas).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in range(200, 400)]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.9 * len(held)
    assert not {900, 901, 902} & set(got)
    assert subject_model.document_subjects(d, lab.limit(0), areas).count() == 0
    assert subject_model.document_subjects(d.limit(0), lab, areas).count() == 0
    assert subject_model.document_subjects(d, lab, areas.limit(0)).count() == 0


def test_sentences():
    f = subject_model.sentence_words
    assert f("[05:00:35] note A b. C 57.3 d!\n1. E") == [["note", "a", "b"], ["c", "d"], ["e"]]
    assert f("so­ft ze​ro") == [["soft", "zero"]]
    assert f(None) == f("") == f(" \t") == f("1. 2.") == []
