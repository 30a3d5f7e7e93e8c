"""Names, taxonomy, checks, rules, exact quantiles and image headers on small fixtures."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import names, vec
from quillon.operators import boxes, calibrate, checks, diagrams, groups, homology, near_duplicates, prefix, rules, runs, scorers, tdist
from quillon.operators.taxonomy import Taxonomy, _plain_yaml, canonical_labels
from quillon.session import cut, release
from quillon.sources import files, sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def column(spark, kind, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def test_names(spark):
    assert one(spark, names.method_id(F.lit("kNN-cosine"), F.lit("k=1.0 x"))) == "knn_cosine_k1_0_x"
    df = column(spark, "string", ["hairy_cell", "smudge_cell", "else", None])
    assert [r[0] for r in df.orderBy("i").select(names.unknown_group(F.col("x"))).collect()] == ["lymphoid_related", "other", "unassigned", "unassigned"]
    assert [r[0] for r in df.orderBy("i").select(names.label_index(F.col("x"), ["else", "a"])).collect()] == [-1, -1, 0, -1]
    assert one(spark, names.named_split(F.lit("test"), F.lit(None).cast("string"))) == "unknown_test" and one(spark, names.named_split(F.lit("train"), F.lit("known"))) == "train"
    assert one(spark, names.leading_size(F.lit("14x7"))) == 14 and one(spark, names.leading_size(F.lit("big"))) is None
    got = [tuple(r[0]) for r in column(spark, "string", [" Small_Lymph", "BURST", None, "odd-one"]).orderBy("i").select(names.cell_class(F.col("x"))).collect()]
    assert got == [("lymphocyte", "known", True, ""), ("", "excluded", False, "burst"), ("", "excluded", False, "empty_label"), ("unknown", "unknown", True, "")]
    assert one(spark, names.hamming_text(F.lit("0110"), F.lit("0011"))) == 2 and one(spark, names.hamming_text(F.lit(None).cast("string"), F.lit("1"))) is None
    with pytest.raises(Exception, match="different lengths"):
        one(spark, names.hamming_text(F.lit("01"), F.lit("011")))


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("known_classes:\n  - Mono cyte\n  - eos\nunknown_classes: blast\naliases:\n  EO: eos\n")
    t = Taxonomy.from_yaml(spark, str(tmp_path / "t.yaml"))
    assert t.known == ("mono_cyte", "eos") and t.unknown == ("blast",) and t.aliases == {"eo": "eos"}
    assert _plain_yaml("a:\n  - x\n  - 'y z'\nb: [p, q]\nc:\n  d: e\n") == {"a": ["x", "y z"], "b": ["p", "q"], "c": {"d": "e"}}
    df = column(spark, "string", ["eo.", "MONO-CYTE", "blast", None])
    got = df.orderBy("i").select(t.canonical(F.col("x")).alias("c"), t.status(F.col("x")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("eos", "known"), ("mono_cyte", "known"), ("blast", "unknown"), (None, "unknown")]
    assert df.where("i < 2").select(t.checked(F.col("x"))).count() == 2
    with pytest.raises(Exception, match="not a known class"):
        df.select(t.checked(F.col("x"))).collect()
    with pytest.raises(ValueError, match="both known and unknown"):
        Taxonomy(("a b",), ("A-B",))
    alias = spark.createDataFrame([("EO", "Eos"), ("eo", "zz"), (None, "q")], "alias string, canonical_label string")
    assert [r["canonical"] for r in canonical_labels(df, "x", alias).orderBy("i").collect()] == ["eos", "mono_cyte", "blast", None]


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, v string")
    assert [tuple(r) for r in checks.one_to_one(a, b, ["k"]).collect()] == [(1, "x", "p")]
    with pytest.raises(ValueError, match="repeated k"):
        checks.one_to_one(a.union(a), b, ["k"])
    with pytest.raises(ValueError, match="no entry for k: 2"):
        checks.full_lookup(a, b.select("k", F.col("v").alias("w")), "k")
    assert checks.full_lookup(a.where("k = 1"), b.select("k", F.col("v").alias("w")), "k").count() == 1
    assert checks.exactly_one(a, v="X").first()["k"] == 1
    for wanted in ({"v": "none"}, {}):
        with pytest.raises(ValueError):
            checks.exactly_one(a, **wanted)
    s = spark.createDataFrame([("train",), (None,), ("test",)], "split string")
    assert checks.predefined_split(s, "split").where("split = ''").count() == 1
    with pytest.raises(ValueError, match="unknown split: holdout"):
        checks.predefined_split(s.union(spark.createDataFrame([("holdout",)], "split string")), "split")
    with pytest.raises(ValueError, match="outside the test split"):
        checks.test_only(s)
    assert checks.test_only(s.where("split = 'test'")).count() == 1
    with pytest.raises(Exception, match="not finite"):
        checks.finite_scores(column(spark, "double", [1.0, math.nan]), "x").collect()
    assert tuple(one(spark, checks.checksum_state(F.upper(F.sha2(F.lit("a").cast("binary"), 256)), F.lit("a").cast("binary")))) == (True, True)
    assert tuple(one(spark, checks.checksum_state(F.lit("zz"), F.lit(None).cast("binary")))) == (False, False)
    assert checks.config_hash({"b": 1, "a": [2]}) == checks.config_hash({"a": [2], "b": 1}) != checks.config_hash({"a": [3], "b": 1})
    assert checks.run_id("r", 3, {}) == checks.run_id("r", 3, {})


def test_development_threshold_needs_disjoint_classes(spark):
    k = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "label string, s double")
    u = spark.createDataFrame([("c", 0.9), ("d", 0.8)], "label string, s double")
    assert calibrate.development_threshold(k, u, "s", 0.5, "label").first()["threshold"] == 0.2
    with pytest.raises(ValueError, match="classes on both sides: b"):
        calibrate.development_threshold(k, u.union(k.where("label = 'b'")), "s", 0.5, "label")


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], float(np.round(rng.normal(), 1))) for i in range(400)]
    counts = cut(spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n")))
    got = {r["g"]: r for r in prefix.linear_quantiles(counts, ["g"], "v", "n", {"p": 0.05, "q": 0.5, "top": 1.0}).collect()}
    for g in "ab":
        v = np.array([x for k, x in rows if k == g])
        assert [got[g][c] for c in ("p", "q", "top")] == pytest.approx([np.quantile(v, q) for q in (0.05, 0.5, 1.0)])
    assert prefix.linear_quantiles(counts.limit(0), ["g"], "v", "n", {"p": 0.5}).count() == 0
    ranked = prefix.global_rank(spark.range(1000).select((1000 - F.col("id")).alias("x")).repartition(7), ["x"], "at").collect()
    assert all(r["at"] == r["x"] - 1 for r in ranked)
    walk = spark.createDataFrame([(i, float((i * 7) % 11)) for i in range(60)], "i int, v double").withColumn("p", F.floor(F.col("i") / 13))
    most = {r["i"]: r["m"] for r in prefix.running_most(walk, [], "p", ["i"], F.col("v"), "m").collect()}
    assert all(most[i] == max(float((k * 7) % 11) for k in range(i + 1)) for i in range(60))


def test_student_t(spark):
    # Two-sided p at the 95 % points of Student's t.
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(runs.T_CRITICAL)], "df int, t double")
    assert all(r["p"] == pytest.approx(0.05, abs=1e-6) for r in df.select(tdist.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect())
    got = [one(spark, tdist.correlation_p(F.lit(r), F.lit(n))) for r, n in ((1.0, 5), (0.0, 4), (0.5, 2))]
    assert got[0] == 0 and got[1] == pytest.approx(1) and got[2] is None


def test_rules(spark):
    num = lambda *v: [F.lit(x) for x in v]
    q = one(spark, rules.crop_quality(*num(20, 40, 5.0, 10.0, 0.5, True)))
    assert q["flags"] == ["too_small", "clipped_at_image_border", "blur", "underexposed"] and q["quality"] == 0.0
    assert one(spark, rules.crop_quality(*num(40, 40, 50.0, 200.0, 0.5, False)))["flags"] == ["overexposed"]
    bad = one(spark, rules.crop_quality(F.lit(None).cast("int"), *num(40, 50.0, 200.0, 0.5, False)))
    assert bad["flags"] == ["invalid_crop"] and bad["quality"] == 0
    assert one(spark, rules.mask_status(*num(0.5, 0.2, 0.3, 2)))["status"] == "valid"
    assert one(spark, rules.mask_status(*num(0.5, 0.2, 0.3, 9)))["status"] == "warning"
    assert one(spark, rules.mask_status(*num(0.0, 0.0, 0.0, 1)))["status"] == "invalid"
    df = spark.createDataFrame([("a", 10.0, 2.0, 4), ("b", 10.0, 1.0, 4)], "l string, d double, r double, h int")
    assert {r["l"]: r["chosen"] for r in rules.best_feasible(df, "l", F.lit(False), "d", "r", "h").collect()} == {"a": False, "b": True}


def test_near_duplicates(spark):
    f = [float(x) for x in range(16)]
    g = [x + 0.01 * (i % 2) for i, x in enumerate(f)]
    rows = [("a", 0, "s", f), ("b", 0, "s", None), ("c", 1, None, g), ("d", 7, "t", [15 - x for x in f]), ("e", -1, "u", f), ("n", None, None, None)]
    df = spark.createDataFrame(rows, "id string, h long, checksum string, field array<double>")
    pairs = near_duplicates.candidate_pairs(df)
    level = {(r["key_a"], r["key_b"]): r["level"] for r in pairs.collect()}
    assert level == {("a", "b"): "confirmed", ("a", "c"): "probable_level1", ("b", "c"): "candidate_level3", ("a", "d"): "candidate_level3", ("b", "d"): "candidate_level3", ("c", "d"): "candidate_level3"}
    got = {r["node"]: tuple(r) for r in near_duplicates.duplicate_components(df, pairs).collect()}
    assert {k: (v[0], v[2], v[3]) for k, v in got.items()} == {
        "a": ("ndc_000000", 3, 3), "b": ("ndc_000000", 3, 3), "c": ("ndc_000000", 3, 2), "d": ("ndc_000001", 1, 0), "e": ("ndc_000002", 1, 0), "n": ("ndc_000003", 1, 0),
    }
    assert groups.star_components(pairs.limit(0).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))).count() == 0


def test_fields_and_vectorizers(spark):
    df = spark.createDataFrame([([[0.0, 1.0], [1.0, 0.0]],), (None,), ([[0.0], [1.0, 2.0]],), ([[3.0, 1.0], [1.0, 0.0]],)], "f array<array<double>>")
    got = [r["g"] for r in df.select(homology.field_diagrams(F.col("f"), unit=True).alias("g")).collect()]
    assert got[0]["error"] is None and len(got[0]["bars"]) == 1 and [bool(g["error"]) for g in got] == [False, True, True, True] and not got[3]["bars"]
    up = df.limit(1).select(homology.field_diagrams(F.col("f"), superlevel=True).alias("g")).first()["g"]["bars"]
    assert [(b["dim"], b["birth"]) for b in up] == [(0, 0.0)]
    bars = spark.createDataFrame([(1, [(0.0, 2.0), (1.0, 4.0), (0.5, float("inf"))]), (2, []), (3, [(9.0, 99.0)])], "k int, b array<struct<birth:double,death:double>>")
    v = diagrams.fit_vectorizers(bars.where("k = 1"), "b")
    out = {r["k"]: r["features"] for r in diagrams.vectorized(bars, "b", v).collect()}
    assert {len(x) for x in out.values()} == {129} and v.slices["image"] == (65, 129) and not any(out[2])
    assert out[1][1] == 1 and sum(out[1][65:]) == 5 and sum(out[3][65:]) == 0
    empty = diagrams.fitted_grid(bars.limit(0), "b").first()["grid"]
    assert (empty[0], empty[-1], len(empty)) == (0.0, 1.0, 16)
    assert one(spark, vec.percentile_scaled(F.array(*[F.lit(2.0)] * 4))) == [0.0] * 4
    assert one(spark, vec.linear_quantile(F.array(F.lit(3.0), F.lit(1.0)), 0.25)) == 1.5


def test_scorer_dispatch(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", "ab"[i % 2], "known", "train" if i < 40 else "test", [float(x) for x in rng.normal(size=4) + 3 * (i % 2)], [float(i % 2), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, label string, status string, split string, e array<double>, z array<double>")
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    for method, variant in (("msp", ""), ("energy", "T=2"), ("ncm", "standardized"), ("knn_cosine", "k=3"), ("react", "p90"), ("vim", "0.95"), ("mahalanobis", "relative")):
        assert scorers.fit_and_score(method, variant, train, test).select("sample_id", "score").count() == 20
    with pytest.raises(ValueError, match="known training rows"):
        scorers.fit_and_score("ncm", "cosine", df, test)
    with pytest.raises(ValueError, match="unknown method"):
        scorers.fit_and_score("oracle", "", train, test)


def test_threshold_sweep(spark):
    box = "x_min double, y_min double, x_max double, y_max double"
    g = spark.createDataFrame([("i", "g1", 0.0, 0.0, 10.0, 10.0), ("i", "g2", 20.0, 20.0, 30.0, 30.0)], f"image_id string, gt_id string, {box}")
    d = spark.createDataFrame([("i", "d1", 0.9, 0.0, 0.0, 10.0, 10.0), ("i", "d2", 0.5, 20.0, 20.0, 30.0, 30.0), ("i", "d3", 0.3, 50.0, 50.0, 60.0, 60.0)], f"image_id string, detection_id string, confidence double, {box}")
    got = {r["score_bound"]: r for r in boxes.threshold_sweep(d, g, [0.2, 0.4, 0.8, 0.95]).collect()}
    assert [(got[b]["tp"], got[b]["fp"], got[b]["missed"]) for b in (0.2, 0.4, 0.8, 0.95)] == [(2, 1, 0), (2, 0, 0), (1, 0, 1), (0, 0, 2)]
    assert [b for b, r in got.items() if r["best"]] == [0.4]


def images():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 40, 30) + b"\x08\x02"
    jpeg = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 21, 33) + b"\x00" * 6
    bmp = b"BM" + b"\x00" * 16 + struct.pack("<ii", 7, -9)
    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 12, 0) + struct.pack("<HHII", 257, 4, 1, 13)
    return {"a/g/x.png": (png, (40, 30)), "a/g/y.jpg": (jpeg, (33, 21)), "b/g/z.bmp": (bmp, (7, 9)), "b/h/t.tif": (tiff, (12, 13))}


def test_manifest_from_files(spark, tmp_path):
    for path, (content, size) in images().items():
        f = tmp_path / "root" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)
        assert files.image_size(content) == size
    assert files.image_size(None) is None and files.image_size(b"\xff\xd8\xff") is None and files.image_size(b"II*\x00\xff\xff\xff\x00") is None
    t = Taxonomy(("a",))
    m = files.build_manifest(spark, str(tmp_path / "root"), "set", 1, t, strict=True)
    assert {r["path"]: (r["width"], r["height"]) for r in m.collect()} == {p: s for p, (_, s) in images().items()}
    assert {(r["canonical_label"], r["known_status"], r["group_id"]) for r in m.collect()} == {("a", "known", "g"), ("b", "unknown", "g"), ("b", "unknown", "h")}
    sinks.save_manifest(m, str(tmp_path / "m"))
    assert files.csv_table(spark, str(tmp_path / "m"), files.MANIFEST_SCHEMA).count() == 4
    (tmp_path / "root" / "a" / "bad.png").write_bytes(b"no image")
    assert files.build_manifest(spark, str(tmp_path / "root"), "set").where("width is null").count() == 1
    with pytest.raises(Exception, match="no image size in a/bad.png"):
        files.build_manifest(spark, str(tmp_path / "root"), "set", strict=True).collect()
    s = files.synthetic_manifest(spark, 200, ("a", "b"), ("c",))
    assert s.exceptAll(files.synthetic_manifest(spark, 200, ("a", "b"), ("c",)).repartition(3)).isEmpty() and s.select("sample_id").distinct().count() == 200
    rows = files.training_rows(s.withColumn("split", F.lit("train")), "train")
    assert 0 < rows.count() < 200 == files.training_rows(s.withColumn("split", F.lit("train")), "train", True).count()


def test_sinks_in_place(spark, tmp_path):
    df, p = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "t")
    sinks.save_table(df, p)
    sinks.update_table(spark, p, "k", 2, {"v": "z"})
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "z")]
    with pytest.raises(ValueError, match="no row"):
        sinks.update_table(spark, p, "k", 9, {"v": "z"})
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_rows(df, log, "csv")
    assert files.csv_table(spark, log, "k int, v string").where("v = 'a'").count() == 2 and files.csv_table(spark, log, "k int, v string").count() == 4
    held = cut(df.repartition(3, "k"), keep_layout=True)
    assert held.count() == 2 and "Exchange" not in held.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    release(held)
    with pytest.raises(Exception):
        held.collect()
