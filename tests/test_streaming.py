import pytest
from pyspark.sql import functions as F

from sievewright.operators import selection
from sievewright.plans.inputs import hashes, ticks
from sievewright.plans import curves
from sievewright.session import table
from sievewright.streaming import metrics

SF = "/root/testdata/sf0.001"


def run(spark, out, tmp_path, mode):
    name = f"s{abs(hash(str(tmp_path))) % 10**9}"
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture()
def events(spark, tmp_path):
    rows = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_moments_equal_batch(spark, events, tmp_path):
    got = run(spark, metrics.moments(events, "event_type", "value"), tmp_path, "complete")
    want = {r.name: r for r in curves.moments(spark, SF).collect()}
    assert {r.event_type: (r.n, round(r.mean, 6), round(r.std, 6)) for r in got.collect()} == {k: (r.n, r["mean"], r["std"]) for k, r in want.items()}


def test_ticks_equal_batch(spark, events, tmp_path):
    got = run(spark, metrics.ticks(events, "event_type", "value", "ts", names="[a-z_]+"), tmp_path, "complete")
    want = {(r.name, r.tick): r.n for r in ticks(spark, SF).collect()}
    assert {(r.event_type, (r.tick.start.date() - __import__("datetime").date(2024, 1, 1)).days): r.n for r in got.collect()} == want


def series(spark, tmp_path):
    rows = ticks(spark, SF).select("name", "value", F.col("tick").cast("long").alias("at"))
    rows.orderBy("at").coalesce(1).write.parquet(f"{tmp_path}/ticks")
    return spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/ticks")


def test_controller_equals_batch(spark, tmp_path):
    got = run(spark, metrics.controller(series(spark, tmp_path), "name", "value", "at", 50.0, 0.05), tmp_path, "append")
    want = {(r.name, r.tick): r.p for r in curves.controller_clamped(spark, SF).collect()}
    assert {(r.name, r.at): pytest.approx(r.p, abs=1e-6) for r in got.collect()} == want


def test_held_mean(spark, tmp_path):
    got = run(spark, metrics.held_mean(series(spark, tmp_path), "name", "value", "at"), tmp_path, "append").collect()
    assert len(got) == ticks(spark, SF).count() and max(r.n for r in got) <= 31


def test_gate_equals_batch(spark, tmp_path):
    rows = hashes(spark, SF).select(F.col("combo").cast("int").alias("combo"), "id", F.lit(True).alias("quality_ok"), "hash")
    rows.coalesce(1).write.parquet(f"{tmp_path}/c")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/c")
    got = run(spark, metrics.greedy_gate(stream, "combo", 22, 20), tmp_path, "append")
    batch = selection.greedy_gate(rows.withColumn("m2_ok", F.lit(True)).withColumn("ref_near", F.lit(False)), 22, 20)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in batch.collect())


def test_outlier_gate_equals_batch(spark, monkeypatch):
    from sievewright.plans import catalogue, streams
    from sievewright.plans.inputs import vectors

    monkeypatch.setattr(streams, "PERCENTILE", 50.0)
    got = {r.id: r.decision for r in catalogue.QUERIES["stream_outlier_gate"](spark, SF).collect()}
    v = vectors(spark, SF).select(F.col("combo").cast("int").alias("combo"), "id", "is_real", F.col("embedding").cast("array<double>").alias("vector"))
    gated = selection.gate(v, 50.0).select("id", F.col("kept").alias("m2_ok"))
    rows = hashes(spark, SF).join(gated, "id").select(F.col("combo").cast("int").alias("combo"), "id", F.lit(True).alias("quality_ok"), "m2_ok", F.lit(False).alias("ref_near"), "hash")
    assert got == {r.id: r.decision for r in selection.greedy_gate(rows, 22, 1 << 30).collect()}


def test_outliers_go_before_they_can_count_as_kept(spark, tmp_path):
    rows = hashes(spark, SF).select(F.col("combo").cast("int").alias("combo"), "id", F.lit(True).alias("quality_ok"), (F.col("id") % 4 != 0).alias("m2_ok"), "hash")
    rows.coalesce(1).write.parquet(f"{tmp_path}/c")
    got = run(spark, metrics.greedy_gate(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/c"), "combo", 22, 1 << 30), tmp_path, "append")
    batch = selection.greedy_gate(rows.withColumn("ref_near", F.lit(False)), 22, 1 << 30)
    want = {r.id: r.decision for r in batch.collect()}
    assert {r.id: r.decision for r in got.collect()} == want and "outlier" in want.values()
