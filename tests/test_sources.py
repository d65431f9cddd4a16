import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.sources import readers, writers


def test_manifest_modes(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filepath,class,plane,source\na/x.png,glioma,ax,real\n/b/y.png,glioma,?,real\n")
    path = f"{tmp_path}/m.csv"
    got = readers.read(spark, "manifest", path, root="/data").orderBy("filepath").collect()
    assert [(r.path, r.basename, r.valid) for r in got] == [("/b/y.png", "y.png", False), ("/data/a/x.png", "x.png", True)]
    assert readers.read(spark, "manifest", path, mode="drop").count() == 1
    with pytest.raises(Exception):
        readers.read(spark, "manifest", path, mode="failfast").collect()
    with pytest.raises(ValueError):
        readers.read(spark, "nothing", path)


def test_jsonl_and_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"seed": 1, "x": 2.5}\n\n{"seed": 2}\n')
    assert readers.read(spark, "jsonl", f"{tmp_path}/a.jsonl").count() == 2
    with pytest.raises(Exception):
        readers.read(spark, "jsonl", f"{tmp_path}/a.jsonl", required=("x",)).collect()
    (tmp_path / "log.txt").write_text('start\n{"fid": 3.5}\nnoise {\n')
    assert readers.read(spark, "metric_lines", f"{tmp_path}/log.txt", schema="fid double").collect()[0].fid == 3.5
    (tmp_path / "d.dat").write_text("n y\n1 0.5\n2 0.25\n")
    assert readers.read(spark, "dat", f"{tmp_path}/d.dat").agg(F.sum("y")).first()[0] == 0.75


def test_index_and_ids(spark, tmp_path):
    (tmp_path / "i.csv").write_text("image_id,v\n1,a\n2,b\n")
    (tmp_path / "j.csv").write_text("image_id,v\n1,a\n1,b\n")
    assert readers.read(spark, "index", f"{tmp_path}/i.csv").count() == 2
    with pytest.raises(Exception):
        readers.read(spark, "index", f"{tmp_path}/j.csv").collect()
    assert readers.read(spark, "ids", [f"{tmp_path}/i.csv", f"{tmp_path}/j.csv"]).count() == 2


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def test_images_archive_and_features(spark, tmp_path):
    for combo in ("glioma_ax", "no_tumor_sa"):
        (tmp_path / "img" / combo).mkdir(parents=True)
        (tmp_path / "img" / combo / "1.PNG").write_bytes(png(4, 5))
        (tmp_path / "img" / combo / "note.txt").write_text("x")
    got = readers.read(spark, "images", f"{tmp_path}/img").collect()
    assert [(r["class"], r.plane) for r in got] == [("glioma", "ax"), ("no_tumor", "sa")]
    members = {f"{i:05d}.png": png(i + 1, 2) for i in range(5)} | {"dataset.json": json.dumps({"labels": [["00001.png", 3]]}).encode()}
    (tmp_path / "a.zip").write_bytes(readers.zipped(members))
    rows = {r.name: r for r in readers.read(spark, "archive", f"{tmp_path}/a.zip", files_per_partition=2).collect()}
    assert len(rows) == 5 and rows["00001.png"].label == 3 and rows["00003.png"].width == 4 and rows["00000.png"].label is None
    x = np.random.default_rng(0).normal(size=(7, 3)).astype("f4")
    np.save(tmp_path / "x.npy", x)
    got = readers.read(spark, "features", f"{tmp_path}/x.npy", rows_per_partition=3).orderBy("row_id").collect()
    assert np.allclose([r.embedding for r in got], x)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], i / 3) for i in range(10)], "id int, g string, v double")
    writers.manifest(df, f"{tmp_path}/m", ["g", "id"], ["g", "id"])
    assert spark.read.csv(f"{tmp_path}/m", header=True).columns == ["g", "id"]
    index = writers.shards(df, f"{tmp_path}/s", [F.col("id")], 2, ["g"])
    assert sorted(tuple(r) for r in index.collect()) == [(g, s, 2 if s < 2 else 1) for g in "ab" for s in range(3)]
    writers.plot_data(df.filter("id = 1"), f"{tmp_path}/p")
    assert any("0.333333" in f.read_text() for f in (tmp_path / "p").glob("part*"))
    writers.history([df.select("id", "g"), df.select("id", "v", F.lit("c").alias("g"))], f"{tmp_path}/h", ["g"])
    assert spark.read.json(f"{tmp_path}/h/jsonl").count() == 20
    writers.registry(df.filter("id < 0"), f"{tmp_path}/r", "P1", ["id"])
    writers.registry(df, f"{tmp_path}/q", "P2", ["id"])
    kinds = lambda p: sorted(r.record_type for r in spark.read.json(f"{tmp_path}/{p}").select("record_type").collect())
    assert kinds("r") == ["data_availability", "plot_metadata"] and kinds("q") == ["data"] * 10 + ["plot_metadata"]
    assert "exceeds" in writers.report({"pairs": 3}, "Audit", {"pairs": 0})
    a = writers.lineage(df, "id", "v").first()
    assert a == writers.lineage(df.orderBy(F.desc("id")), "id", "v").first() and a != writers.lineage(df.filter("id > 0"), "id", "v").first()
