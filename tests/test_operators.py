import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators import checkpoint, curves, metrics, relational, sampling, selection, similarity, stats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_quota_halves_go_to_even(spark):
    got = spark.createDataFrame([(323,), (361,), (2,), (3,)], "n int").select(S.half_even(F.col("n") * 2.5)).collect()
    assert [r[0] for r in got] == [808, 902, 5, 8]


def test_band_join_finds_what_a_cross_join_finds(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    h = [int(x) for x in base] + [int(x) ^ (1 << int(i)) ^ (1 << int(j)) for x, i, j in zip(base, rng.integers(0, 63, 40), rng.integers(0, 63, 40))]
    df = spark.createDataFrame(list(enumerate(h)), "id long, hash long")
    for t in (0, 2, 6, 18):
        want = sorted((i, j, (h[i] ^ h[j]).bit_count() if h[i] ^ h[j] >= 0 else ((h[i] ^ h[j]) & (2**64 - 1)).bit_count()) for i in range(80) for j in range(80))
        assert rows(similarity.hamming_join(df, df, t)) == [w for w in want if w[2] <= t]


def test_nearest_in_blocks_and_ties(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 6)], "id long, hash long")
    one = rows(similarity.nearest(df.filter("id > 2"), df, "hash", "hamming"))
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 1)
    assert rows(similarity.nearest(df.filter("id > 2"), df, "hash", "hamming")) == one == [(3, 3, 0), (4, 4, 0)]
    assert rows(similarity.nearest(df.filter("id = 2"), df.filter("id <> 4"), "hash", "hamming")) == [(2, 1, 0)]


def test_holm_with_ties_and_caps(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.01), (3, 0.6), (4, 0.9)], "id int, p double")
    got = {r.id: round(r.p_holm, 6) for r in stats.holm(df, "p").collect()}
    assert got == {1: 0.04, 2: 0.04, 3: 1.0, 4: 1.0}


def test_wilson_interval(spark):
    low, high = S.wilson(F.lit(1271.0), F.lit(2264.0))
    got = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (round(100 * got.l, 2), round(100 * got.h, 2)) == (54.09, 58.17)


def test_student_tail(spark):
    known = [(1, 1.0, 0.25), (2, 1.0, 0.2113249), (9, 2.262157, 0.025), (10, 1.812461, 0.05), (30, -2.042272, 0.975)]
    df = spark.createDataFrame(known, "df int, t double, p double").select("p", stats.student_upper(F.col("t"), F.col("df")).alias("q"))
    assert all(math.isclose(r.p, r.q, abs_tol=1e-5) for r in df.collect())


def test_f1_of_absent_classes_and_zero_rows(spark):
    labels = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    preds = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y_true int, y_pred int")
    m = metrics.confusion(preds, labels)
    assert m.count() == 9
    assert {(r.y_true, r.y_pred): r.share for r in metrics.normalised(m).collect()}[2, 2] == 0
    s = metrics.class_scores(m)
    fixed, seen = metrics.averaged(s, False).first().macro_f1, metrics.averaged(s, True).first().macro_f1
    assert round(fixed, 6) == round(2 / 3 * 2 / 3, 6) and round(seen, 6) == round(2 / 3, 6)


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("b", 1.0, 0), ("b", 2.0, 1), ("b", 2.0, 0)], "g string, s double, y int")
    assert rows(metrics.auroc(df, "s", "y", ["g"]).na.fill(-1.0)) == [("a", -1.0), ("b", 0.75)]


def test_checkpoint_edges(spark):
    data = [("m", 1, 30.0, 0.5, 0.2), ("m", 2, 49.9, 0.49, 0.21), ("m", 3, 80.0, 0.9, 0.9), ("n", 1, 75.0, None, None), ("k", 1, 10.0, 0.5, 0.2), ("k", 2, 11.0, 0.4, 0.29)]
    got = {r.model: r for r in checkpoint.three_stage(spark.createDataFrame(data, "model string, kimg int, fid double, precision double, recall double")).collect()}
    assert got["m"].kimg == 2 and got["m"].by_recall and got["m"].tier == "EXCELLENT"
    assert got["n"].tier == "FAIR" and got["n"].kimg == 1
    assert got["k"].kimg == 2 and got["k"].by_recall


def test_short_series_and_plateau(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "name string, tick int, value double")
    assert [r.smoothed for r in curves.moving_average(df, ["name"], "tick", "value").orderBy("tick").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert curves.plateau(df, ["name"], "tick", "value").first().plateau_at == 0.6 * 4
    assert curves.normal_interval(df.filter("tick = 1"), ["name"], "value").first().half_ci == 0


def test_guards_raise(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    for bad in (relational.guard_unique(df, "id"), relational.mode_policy(df, F.col("id") > 5, "failfast"), sampling.fixed(df, ["id"], 3, 0, "id", strict=True)):
        with pytest.raises(Exception):
            bad.collect()
    with pytest.raises(ValueError):
        relational.mode_policy(df, F.lit(True), "other")


def test_balanced_sample_skips_lone_strata(spark):
    df = spark.createDataFrame([(i, "x", "ab"[i % 3 == 0]) for i in range(10)] + [(20, "y", "a")], "id int, s string, side string")
    got = rows(sampling.balanced(df, ["s"], "side", ["a", "b"], 1, "id").groupBy("s", "side").count())
    assert got == [("x", "a", 4), ("x", "b", 4)]


def test_frechet_of_equal_sets_is_zero(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i % 2, [float(x) for x in v]) for i, v in enumerate(np.repeat(rng.normal(size=(50, 3)), 2, axis=0))], "side int, vector array<double>")
    sums = {r.side: (r.n, r.sums) for r in selection.moments(df, "vector", ["side"]).collect()}
    assert abs(selection.frechet(sums[0], sums[1])) < 1e-9


def test_slerp_and_hash(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    got = spark.range(1).select(S.slerp(a, b, F.lit(0.5)).alias("v"), S.sign_hash(F.array(*[F.lit(float(i)) for i in range(64)])).alias("h")).first()
    assert got.v == pytest.approx([math.sqrt(0.5)] * 2) and got.h == (1 << 32) - 1


def test_guards(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="k is not there: 2"):
        relational.required(left, right, "k", "v").collect()
    with pytest.raises(ValueError, match="2 rows of one side and 1"):
        relational.zip_rows(left, "k", right, "k")
    other = spark.createDataFrame([(9, "y"), (8, "x")], "o int, v string")
    assert sorted(map(tuple, relational.zip_rows(left, "k", other, "o").collect())) == [(1, 8, "x"), (2, 9, "y")]


def test_nearest_without_pairs(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)] + [(None, [1.0, 1.0]), (900, None)], "id long, v array<double>")
    got = similarity.nearest(rows.filter("id % 20 = 0"), rows, "v", "cosine")
    assert sorted(map(tuple, got.collect())) == [(i, i % 7, 0.0) for i in range(0, 200, 20)]
    assert similarity.nearest(rows.limit(0), rows, "v", "cosine").collect() == []


def test_binomial(spark):
    rows = spark.createDataFrame([(519, 899), (5, 10), (0, 10), (10, 10), (0, 0)], "k long, n long")
    got = [r[0] for r in rows.select(stats.binomial_two_sided("k", "n")).collect()]
    exact = [min(1.0, sum(math.comb(n, j) for j in range(n + 1) if abs(2 * j - n) >= abs(2 * k - n)) / 2**n) for k, n in ((519, 899), (5, 10), (0, 10), (10, 10), (0, 0))]
    assert got == pytest.approx(exact)
