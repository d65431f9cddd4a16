import datetime as dt

import duckdb
import numpy as np
import pytest

from sievewright.plans import catalogue, streams
from sievewright.streaming import collector

SCHEMA = "name string, ts timestamp, value double"
DAY = 86_400_000


def at(day, hour=1):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def run(spark, tmp_path, n):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    out = collector.collected(stream, "name", "value", "ts", late="1 day", names="[a-z]+")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.schema(collector.TICKS).parquet(f"{tmp_path}/out")


def plain(reports, until):
    """Averages of each tick, the last ones where there are none."""
    base = int((dt.datetime(2024, 1, 1) - dt.datetime(1970, 1, 1)).days)
    out = {}
    for name in {r[0] for r in reports if r[0].isalpha() and r[2] is not None}:
        days = {}
        for n, t, v in reports:
            if n == name and v is not None:
                days.setdefault((t - dt.datetime(2024, 1, 1)).days, []).append(v)
        held = None
        for d in range(min(days), until):
            held = (len(days[d]), float(np.mean(days[d])), float(np.std(days[d]))) if d in days else held
            out[name, base + d] = (*held, d in days)
    return out


def test_deltas_and_held_values_over_a_restart(spark, tmp_path):
    rng = np.random.default_rng(0)
    first = [("loss", at(d, int(h)), float(rng.normal())) for d in (0, 1, 2, 5) for h in rng.integers(0, 24, 4)] + [("fid", at(1), 7.0), ("fid", at(2), None), ("x9", at(1), 1.0), ("lr", at(4), 2.0)]
    second = [("loss", at(d), float(d)) for d in (6, 9)] + [("fid", at(8), 3.0), ("fid", at(8, 5), 5.0), ("lr", at(12), 1.0)]
    got = []
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, tmp_path, len(got)).collect()
    # the watermark is a day behind the latest report, day 12 at 1 o'clock: day 10 is the last that is closed
    want = plain(first + second, 11)
    assert len(got) == len(want)
    assert {(r.name, r.tick): (r.num, pytest.approx(r["mean"]), pytest.approx(r["std"]), r.fresh) for r in got} == want
    assert any(not w[3] for w in want.values())


def test_moments():
    assert collector.averages(1, 5.0, 25.0) == (1, 5.0, 0.0)
    n, mean, std = collector.averages(4, 10.0, 30.0)
    assert (n, mean, std) == (4, 2.5, pytest.approx(np.std([1, 2, 3, 4])))


@pytest.mark.parametrize("store", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_the_query_brings_its_state_store(spark, sf, store):
    """Sessions keep Spark's default store unless told otherwise; the query must run there and leave the setting as it was."""
    key = collector.PROVIDER[0]
    before = spark.conf.get(key, None)
    spark.conf.unset(key) if store is None else spark.conf.set(key, store)
    try:
        named = spark.conf.get(key, None)
        got = streams.stream_collector(spark, sf).collect()
        assert spark.conf.get(key, None) == named
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.sql(catalogue.ORACLE["stream_collector"]).fetchall())
