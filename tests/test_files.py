"""Sources, sinks and streams round trip through small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.sources import files, sinks
from quillon.streaming import scores


def test_manifest_round_trip(spark, tmp_path):
    for p, b in (("x/g1/a.png", b"1"), ("y/g2/b.JPG", b"2"), ("y/g2/skip.txt", b"3")):
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    m = files.build_manifest(spark, str(tmp_path / "root"), "set", 1).orderBy("path").collect()
    assert [(r["path"], r["canonical_label"], r["group_id"]) for r in m] == [("x/g1/a.png", "x", "g1"), ("y/g2/b.JPG", "y", "g2")]
    df = spark.createDataFrame([("b", *["v"] * 8, 1, 2), ("a", None, *["v"] * 7, 1, 2)], files.MANIFEST_SCHEMA)
    sinks.save_manifest(df, str(tmp_path / "m"))
    back = files.csv_table(spark, str(tmp_path / "m"), files.MANIFEST_SCHEMA)
    assert sorted(r["sample_id"] for r in back.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.save_manifest(df.drop("width"), str(tmp_path / "n"))


def test_signals(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sample_id,split,known_or_unknown,confidence,margin,unknown_score,quality_pass,correct_if_known\na,test,known,0.5,x,0.1,Yes,\nb,test,known,1,0.2,0.3,0,true\n")
    a, b = files.signal_records(spark, str(tmp_path / "s.csv")).orderBy("sample_id").collect()
    assert (a["margin"], a["quality_pass"], a["correct_if_known"]) == (None, True, None)
    assert (b["confidence"], b["quality_pass"], b["correct_if_known"]) == (1.0, False, True)


def test_annotations_and_cells(spark, tmp_path):
    (tmp_path / "t.dat").write_text("p1 lab  r1\n\np2 lab\n")
    assert [tuple(r) for r in files.annotations(spark, str(tmp_path / "t.dat")).orderBy("path").collect()] == [("p1", "lab", "r1", "nan"), ("p2", "lab", "nan", "nan")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/t.dat", "q l\n")
        z.writestr("../evil.dat", "no l\n")
    assert [r["path"] for r in files.annotations(spark, str(tmp_path / "z.zip")).collect()] == ["q"]
    (tmp_path / "im.json").write_text(json.dumps({"Cell_0": {"label": "a", "x1": "1", "y1": "2", "x2": "3", "y2": "bad"}, "meta": {"label": "n"}}))
    (r,) = files.cell_records(spark, str(tmp_path / "im.json")).collect()
    assert (r["image_id"], r["cell"], r["x_max"], r["y_max"]) == ("im", "Cell_0", 3.0, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    p = str(tmp_path / "t")
    assert sinks.save_once(df, p) and not sinks.save_once(df, p)
    sinks.append_rows(df, p)
    assert spark.read.parquet(p).count() == 4
    assert json.loads(sinks.stable_json(df))[0] == {"k": 1, "v": "a"}
    with pytest.raises(ValueError):
        sinks.stable_json(df, 1)
    assert sinks.nested_records(df, "k", ["v"]).count() == 2
    with pytest.raises(ValueError):
        sinks.nested_records(df, "k", ["v"], ("v",))
    assert [r["v"] for r in sinks.updated(df, "k", 1, {"v": "z"}).orderBy("k").collect()] == ["z", "b"]
    assert sinks.simple_yaml({"a": None, "b": [1, {"c": True}]}) == "a: null\nb:\n  - 1\n  -\n    c: true\n"


def test_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/triage_signal.parquet").withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = scores.windowed_rates(stream, 0.5).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("rates").agg(F.sum("n")).first()[0]
    assert got == src.where("scored_at is not null").count()
