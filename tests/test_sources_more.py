import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.sources import readers, writers


def put(root, *names):
    for n in names:
        os.makedirs(os.path.dirname(root / n), exist_ok=True)
        (root / n).write_bytes(b"x")


def test_partitions_warn_of_missing_folders(spark, tmp_path):
    put(tmp_path, "a_ax/2.png", "a_ax/1.JPG", "a_ax/note.txt", "b_sa/7.jpeg", "a_co/keep/9.png")
    with pytest.warns(UserWarning) as seen:
        got = readers.read(spark, "partitions", str(tmp_path), classes=("a", "b"), planes=("ax", "sa")).collect()
    assert [(os.path.basename(r.path), r["class"], r.plane) for r in got] == [("1.JPG", "a", "ax"), ("2.png", "a", "ax"), ("7.jpeg", "b", "sa")]
    assert sorted(str(w.message).rpartition("/")[2] for w in seen if w.category is UserWarning) == ["a_sa is missing", "b_ax is missing"]
    assert readers.partitions(spark, str(tmp_path), ("a",), ("co",), below="keep").count() == 1
    with pytest.warns(UserWarning):
        assert readers.partitions(spark, f"{tmp_path}/none", ("a",), ("ax",)).collect() == []


def test_class_folders_take_names(spark, tmp_path):
    put(tmp_path, "x/s_t_1_gl_ax_t1.png", "x/s_t_2_nt_zz_t1.png", "y/s_t_3_qq_ax_t1.png", "y/s_t_4_me_sa.png", "y/s_t_5_pi_sa_t1.txt")
    got = readers.read(spark, "class_folders", str(tmp_path)).collect()
    assert [(os.path.basename(r.path), r["class"], r.plane) for r in got] == [("s_t_1_gl_ax_t1.png", "glioma", "ax"), ("s_t_2_nt_zz_t1.png", "no_tumor", "?")]


def test_listing_ignores_globs_of_names_and_folders(spark, tmp_path):
    put(tmp_path, "a.py", "b.pyc", "cache/c.txt", "d/cache/e.txt", "d/f.txt", "d/g.tmp")
    names = lambda *ignores: [r.name for r in readers.read(spark, "listing", str(tmp_path), ignores=ignores).collect()]
    assert names() == ["a.py", "b.pyc", "cache/c.txt", "d/cache/e.txt", "d/f.txt", "d/g.tmp"]
    assert names("cache", "*.pyc") == ["a.py", "d/f.txt", "d/g.tmp"]
    assert names("?.p*", "d") == ["cache/c.txt"]


def test_first_tick_of_a_log_is_left_out(spark, tmp_path):
    (tmp_path / "l.txt").write_text('{"tick": 0, "fid": 9}\nno json\n{"tick": 1, "fid": 4}\n{"tick": 2, broken}\n{"tick": 3, "fid": 2}\n')
    got = readers.metric_lines(spark, f"{tmp_path}/l.txt", "tick int, fid double", after_first="tick").orderBy("tick").collect()
    assert [(r.tick, r.fid) for r in got if r.fid is not None] == [(1, 4.0), (3, 2.0)] and not any(r.tick == 0 for r in got)


def lines(path):
    return [json.loads(x) for top, _, names in os.walk(path) for n in sorted(names) if n.startswith("part") for x in open(f"{top}/{n}")]


def test_history_has_sorted_keys(spark, tmp_path):
    a = spark.createDataFrame([("e", 1, 2.0, 3.0)], "experiment string, seed int, z double, a double")
    b = spark.createDataFrame([("e", 2, 5.0)], "experiment string, seed int, m double")
    writers.history([a, b], f"{tmp_path}/h", ["experiment", "seed"])
    got = lines(f"{tmp_path}/h/jsonl")
    assert [list(x) for x in sorted(got, key=len)] == [["experiment", "m", "seed"], ["a", "experiment", "seed", "z"]]
    assert spark.read.csv(f"{tmp_path}/h/csv", header=True).columns == ["experiment", "seed", "z", "a", "m"]


def test_append_only_lines(spark, tmp_path):
    for n in (0, 1):
        writers.append_lines(spark.range(3 * n, 3 * n + 3).select(F.col("id").alias("z"), (F.col("id") * 2).alias("a")), f"{tmp_path}/l", ["z"])
    got = lines(f"{tmp_path}/l")
    assert sorted(x["z"] for x in got) == list(range(6)) and all(list(x) == ["a", "z"] for x in got)


def test_streamed_lines_count_a_batch_once(spark, tmp_path):
    for n in (0, 1):
        spark.range(n * 5, n * 5 + 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = writers.stream_lines(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert q.awaitTermination(120) and q.exception() is None
    assert sorted(x["id"] for x in lines(f"{tmp_path}/out")) == list(range(10))


def test_nested_document(spark, tmp_path):
    row = spark.range(1).select(F.struct(F.lit(1.5).alias("mean"), F.array(F.lit(1), F.lit(2)).alias("rows")).alias("summary"), F.lit("x").alias("label"))
    writers.document(row, f"{tmp_path}/d")
    assert lines(f"{tmp_path}/d") == [{"label": "x", "summary": {"mean": 1.5, "rows": [1, 2]}}]
    with pytest.raises(ValueError):
        writers.document(row.union(row), f"{tmp_path}/e")


def test_feature_file_and_lineage(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(500, 6)).astype("f4")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<float>").repartition(7)
    writers.features(df, f"{tmp_path}/x.npy", "k", "v")
    assert (np.load(tmp_path / "x.npy") == x).all() and sorted(os.listdir(tmp_path)) == ["x.npy", "x.npy.lineage.json"]
    lineage = json.loads((tmp_path / "x.npy.lineage.json").read_text())
    assert lineage == {"rows": 500, "width": 6, "sha256": hashlib.sha256(x.tobytes()).hexdigest()}
    back = readers.read(spark, "features", f"{tmp_path}/x.npy", rows_per_partition=90).orderBy("row_id").collect()
    assert np.allclose([r.embedding for r in back], x)
    with pytest.raises(Exception, match="there already"):
        writers.features(df, f"{tmp_path}/x.npy", "k", "v")
    bad = df.union(spark.createDataFrame([(900, [1.0])], df.schema))
    with pytest.raises(Exception, match="one width"):
        writers.features(bad, f"{tmp_path}/y.npy", "k", "v")
    assert not any(n.startswith((".", "y")) for n in os.listdir(tmp_path))
    writers.features(df.limit(0), f"{tmp_path}/z.npy", "k", "v")
    assert np.load(tmp_path / "z.npy").shape == (0, 0)
