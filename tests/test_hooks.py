import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import hooks, scalars
from sievewright.functions.hooks import Hooks, Metrics


def test_metrics(spark):
    metrics = Metrics()

    @metrics.register
    def rows(df):
        return df.agg(F.count(F.lit(1)).alias("n"))

    assert metrics.names() == ["rows"] and metrics.valid("rows") and not metrics.valid("cols")
    assert metrics.expose(spark, spark.range(5)) == ["metric_rows"]
    assert spark.sql("SELECT n FROM metric_rows").first()[0] == 5
    with pytest.raises(KeyError, match="known are rows"):
        metrics.calc("cols", spark.range(1))
    with pytest.raises(ValueError):
        metrics.register(rows)


def test_names_and_hooks():
    assert hooks.by_name("sievewright.functions.scalars.let") is scalars.let
    assert hooks.by_name("collections.Counter", "aab")["a"] == 2
    base = Hooks(load=lambda: 1, score=lambda: 2)
    assert (base.load(), base.with_(score=lambda: 5).score()) == (1, 5)
    with pytest.raises(KeyError):
        base.with_(save=print)
    with pytest.raises(AttributeError):
        base.save


def test_transform_drops(spark):
    def make():
        return lambda r: {"id": r["id"], "twice": 2 * r["id"]} if r["id"] % 2 else None

    assert sorted(map(tuple, hooks.transformed(spark.range(6), make, "id long, twice long").collect())) == [(1, 2), (3, 6), (5, 10)]
    assert hooks.transformed(spark.range(0), make, "id long, twice long").collect() == []


def test_transforms_keep_the_types_of_the_schema(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, s string")
    got = hooks.transformed(rows, lambda: lambda r: r, "id int, s string").collect()
    assert sorted(map(tuple, got)) == [(1, None), (2, "x")]


def test_names_of_planes_and_tests(spark):
    names = ["scan_ax_001", "aaxb", "scan_AX_1", "x__sa__y", "co", "a_b_c_gl_ax_t", "a_b_c_nt_zz_t", "a_b_c_pi_sa", "a_b_c_qq_co_t"]
    rows = spark.createDataFrame([(n,) for n in names], "s string")
    first, free = scalars.test_name(F.col("s")), scalars.test_name(F.col("s"), False)
    got = rows.select(scalars.token_in(F.col("s"), ["ax", "co", "sa"]).alias("p"), first["class"].alias("c"), first["plane"].alias("q"), free["plane"].alias("f")).collect()
    assert [r.p for r in got] == ["ax", None, None, "sa", "co", "ax", None, "sa", "co"]
    assert [(r.c, r.q, r.f) for r in got[5:]] == [("glioma", "ax", "ax"), ("no_tumor", None, "zz"), (None, None, None), (None, "co", "co")]


def test_slerp_of_long_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 300))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    got = np.array(df.select(scalars.slerp(F.col("a"), F.col("b"), F.lit(0.25)).alias("v")).first().v)
    u, v = a / np.linalg.norm(a), b / np.linalg.norm(b)
    w = np.arccos(u @ v)
    assert np.allclose(got, (np.sin(0.75 * w) * u + np.sin(0.25 * w) * v) / np.sin(w))
