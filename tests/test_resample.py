import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions.scalars import mix32
from sievewright.operators import resample, stats

SCHEMA = "condition int, seed int, case_id long, y_true int, y_pred int"


def plain_metric(t, p, metric, labels):
    t, p = np.array(t), np.array(p)
    f1 = [2 * ((t == c) & (p == c)).sum() / max(1, (t == c).sum() + (p == c).sum()) for c in range(labels)]
    if metric == 0:
        return (t == p).mean()
    return np.mean(f1) if metric == 1 else sum(f * (t == c).sum() for c, f in enumerate(f1)) / len(t) if metric == 2 else f1[metric - 3]


def data(n=37, seeds=3, labels=3, conditions=(0, 1, 2)):
    rng = np.random.default_rng(4)
    truth = rng.integers(0, labels, n)
    said = {(c, s): np.where(rng.random(n) < 0.6 + 0.1 * c, truth, rng.integers(0, labels, n)) for c in conditions for s in range(seeds)}
    ids = np.sort(rng.choice(1000, n, replace=False))
    rows = [(c, s, int(i), int(t), int(p)) for (c, s), ps in said.items() for i, t, p in zip(ids, truth, ps)]
    return rows, ids, truth, said


@pytest.mark.parametrize("block", [1000, 10])
def test_every_iteration_equals_the_plain_rule(spark, block):
    rows, ids, truth, said = data()
    p = spark.createDataFrame(rows, SCHEMA).repartition(5)
    todo = resample.tasks(spark, [1, 2], 6, 100, 11)
    got = {(r.comparison, r.metric, r.it): (r.boot, r.perm) for r in resample.resampled(p, todo, [0, 1, 2], [0, 1, 2], 3, block, 4).collect()}
    seeds = {(r.comparison, r.metric): r.seed for r in todo.collect()}
    assert seeds == {(c, m): 100 + 1000003 * (c - 1) + 10007 * (m + 1) for c in (1, 2) for m in range(6)} and len(got) == 12 * 12
    sizes = [min(block, len(ids) - at) for at in range(0, len(ids), block)]
    for (c, m), seed in seeds.items():
        value = lambda cond, t, at: np.mean([plain_metric(t[at], said[cond, s][at], m, 3) for s in range(3)])
        for it in range(11):
            counts = resample.block_draws(seed, np.array([it]), sizes)
            assert counts.sum() == len(ids)
            at, done = [], 0
            for b, size in enumerate(sizes):
                w = resample.drawn(seed, np.array([it]), counts[:, b], np.array([done]), size)[0].astype(int)
                at += [b * block + k for k in range(size) for _ in range(w[k])]
                done += int(counts[0, b])
            boot, perm = got[c, m, it]
            assert boot == pytest.approx(value(c, truth, at) - value(0, truth, at))
            swap = resample.swapped(seed, np.array([it]), ids.astype(np.int64))[0] == 1
            mixed = [np.mean([plain_metric(truth, np.where(swap, said[y, s], said[x, s]), m, 3) for s in range(3)]) for x, y in ((c, 0), (0, c))]
            assert perm == pytest.approx(mixed[0] - mixed[1])


def test_summary_against_sorted_draws(spark):
    rows, *_ = data()
    rows = [r for r in rows if r[0] < 2]
    draws = resample.resampled(spark.createDataFrame(rows, SCHEMA), resample.tasks(spark, [1], 6, 5, 200), [0, 1], [0, 1, 2], 3).cache()
    out = {r.metric: r for r in resample.summary(draws).collect()}
    for m in range(6):
        own = draws.filter(F.col("metric") == m).collect()
        boot, perm = (np.array([getattr(r, x) for r in own if r.it >= 0]) for x in ("boot", "perm"))
        a, b = next((r.boot, r.perm) for r in own if r.it < 0)
        assert (out[m].ci_low, out[m].ci_high) == (pytest.approx(np.percentile(boot, 2.5)), pytest.approx(np.percentile(boot, 97.5)))
        assert out[m].p_raw == pytest.approx(((np.abs(perm).round(9) >= round(abs(a - b), 9)).sum() + 1) / 201)
    ordered = sorted(out.values(), key=lambda r: r.p_raw)
    running = 0.0
    for k, r in enumerate(ordered):
        running = max(running, min(1.0, (6 - k) * r.p_raw))
        assert r.p_holm == pytest.approx(running) or any(abs(o.p_raw - r.p_raw) < 1e-12 for o in ordered if o is not r)


def test_runs_that_are_not_paired_are_an_error(spark):
    rows, *_ = data()
    todo = resample.tasks(spark, [1], 6, 5, 2)
    for bad in (rows[1:], [*rows, rows[0]], [(*rows[0][:3], 9, 0), *rows[1:]]):
        with pytest.raises(Exception, match="not paired"):
            resample.resampled(spark.createDataFrame(bad, SCHEMA), todo, [0, 1, 2], [0, 1, 2], 3).collect()


def test_mixing_is_that_of_the_columns(spark):
    got = [r[0] for r in spark.range(200).select(mix32(77, F.lit(3), F.col("id") * 12345678901)).collect()]
    assert got == resample.mixed(77, np.int64(3), np.arange(200) * 12345678901).tolist()


def test_bootstrap_interval_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    cases = spark.createDataFrame([(i, int(d), 10) for i, d in enumerate(rng.integers(-4, 6, 300))], "case_id long, diff long, n long")
    d = np.random.default_rng(1).integers(-4, 6, 300) / 10
    se = d.std() / math.sqrt(300)
    for size in (1000, 40):
        draws = [r.m for r in resample.bootstrap_means(cases, 3000, 7, size).collect()]
        assert len(draws) == 3000 and np.std(draws) == pytest.approx(se, rel=0.06)
        assert np.allclose(np.percentile(draws, [2.5, 50, 97.5]), d.mean() + np.array([-1.96, 0, 1.96]) * se, atol=0.0035)


def test_binomial_of_any_size_and_null(spark):
    pairs = [(519, 899), (5, 10), (0, 10), (10, 10), (0, 0), (1, 3), (7, 9), (3, 60), (49, 100), (430, 1000)]
    rows = spark.createDataFrame([*pairs, (None, 4), (499_000, 1_000_000)], "k long, n long")
    got = [r[0] for r in rows.select(stats.binomial_two_sided("k", "n")).collect()]
    exact = [min(1.0, sum(math.comb(n, j) for j in range(n + 1) if abs(2 * j - n) >= abs(2 * k - n)) / 2**n) for k, n in pairs]
    assert got[: len(pairs)] == pytest.approx(exact, rel=1e-9)
    assert got[-2] is None and got[-1] == pytest.approx(math.erfc((2000 - 1) / 1000 / math.sqrt(2)), rel=1e-4)  # with the correction for continuity
