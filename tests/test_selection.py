import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import diversity, neighbours, selection

SCHEMA = "combo int, id long, is_real boolean, vector array<double>"


def plain_geometry(real, components=200):
    """Whitening by PCA and shrunk covariance, from the rows themselves."""
    centre = real.mean(axis=0)
    axes = np.linalg.svd(real - centre, full_matrices=False)[2][: max(1, min(len(real) - 1, components, real.shape[1]))]
    z = (real - centre) @ axes.T
    n, d = z.shape
    cov = z.T @ z / n
    mu = np.trace(cov) / d
    delta = ((cov - mu * np.eye(d)) ** 2).sum() / d
    beta = max(0.0, sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / d / n**2)
    share = min(beta, delta) / delta if delta else 0.0
    root = np.linalg.cholesky(np.linalg.inv((1 - share) * cov + share * mu * np.eye(d)))
    return lambda x: ((x - centre) @ axes.T) @ root


def plain_order(x, n):
    """From the point nearest to the origin, then always the farthest from those taken."""
    order = [int(np.argmin(np.linalg.norm(x, axis=1)))]
    while len(order) < min(n, len(x)):
        near = np.array([min(np.linalg.norm(x[i] - x[t]) for t in order) for i in range(len(x))])
        if near.max() == 0:
            break
        order.append(int(near.argmax()))
    return order


def groups(seed, n_groups=12, real=40, synth=70, d=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_groups):
        scale = rng.uniform(0.5, 6, d)
        for k in range(real + synth):
            rows.append((c, c * 1000 + k, k < real, (rng.normal(size=d) * scale * (1.0 if k < real else 1.3)).tolist()))
    return rows


def test_gate_and_order_equal_the_plain_rule_in_twelve_groups(spark, monkeypatch):
    monkeypatch.setattr(diversity, "NAMED", 5)
    rows = groups(1)
    ratios = [0.5, 1.0, 1.25]
    gated = selection.gate(spark.createDataFrame(rows, SCHEMA).repartition(7), 90.0).cache()
    ranks = selection.ranked(gated, ratios).cache()
    got = {(r.combo, r.fps_rank): r.id for r in ranks.collect()}
    m2 = {(r.combo, r.id): (r.m2, r.threshold, r.kept) for r in gated.collect()}
    want = {}
    for c in range(12):
        own = [r for r in rows if r[0] == c]
        real = np.array([r[3] for r in own if r[2]])
        other = [(r[1], r[3]) for r in own if not r[2]]
        white = plain_geometry(real)
        limit = np.percentile((white(real) ** 2).sum(axis=1), 90.0)
        space = white(np.array([v for _, v in other]))
        for (i, _), d in zip(other, (space**2).sum(axis=1)):
            assert m2[c, i] == (pytest.approx(d, rel=1e-6), pytest.approx(limit, rel=1e-6), d <= limit)
        alive = [k for k in range(len(other)) if (space[k] ** 2).sum() <= limit]
        for n, k in enumerate(plain_order(space[alive], round(1.25 * len(real)))):
            want[c, n + 1] = other[alive[k]][0]
    assert got == want
    sets = selection.ratio_sets(ranks, ratios).collect()
    for ratio in ratios:
        assert {(r.combo, r.id) for r in sets if r.ratio == ratio} == {(c, i) for (c, k), i in want.items() if k <= round(ratio * 40)}


def test_gate_of_small_groups(spark):
    rng = np.random.default_rng(2)
    data = [(0, i, i % 2 == 0, [float(x) for x in rng.normal(size=2)]) for i in range(80)] + [(0, 999, False, [50.0] * 2)]
    data += [(1, 1, True, [1.0, 2.0]), (1, 2, False, [3.0, 4.0]), (1, 3, False, [3.0, 4.0]), (2, 1, True, [0.0, 1.0]), (2, 2, True, [1.0, 1.0]), (3, 5, False, [1.0, 1.0])]
    gated = selection.gate(spark.createDataFrame(data, SCHEMA)).cache()
    got = {(r.combo, r.id): r for r in gated.collect()}
    assert not got[0, 999].kept and got[0, 999].m2 > got[0, 999].threshold
    assert got[1, 2].kept and got[1, 3].kept and got[3, 5].kept and got[1, 2].n_real == 1 and got[3, 5].n_real == 0 and not any(c == 2 for c, _ in got)
    ranks = {(r.combo, r.id): r.fps_rank for r in selection.ranked(gated, [2.0]).collect()}
    assert ranks[1, 2] == 1 and (1, 3) not in ranks and (3, 5) not in ranks  # a copy ends the order; no real rows ask for none
    nearest = min((r for (c, _), r in got.items() if c == 0 and r.kept), key=lambda r: r.m2)
    assert ranks[0, nearest.id] == 1
    assert selection.gate(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("named", [1, 3, 200])
def test_order_of_ties_and_copies(spark, named):
    points = [(float(a), float(b)) for a in range(-2, 3) for b in range(-2, 3)] * 3
    df = spark.createDataFrame([(7, i, bytearray(np.array(p).tobytes())) for i, p in enumerate(points)], "combo int, id long, x binary").repartition(5)
    got = [i for _, i, _ in sorted(diversity.farthest_order(df, {7: 60}, named), key=lambda r: r[2])]
    assert got == plain_order(np.array(points), 60) and len(got) == 25


def test_exact_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [(c, i, float(v)) for c in range(3) for i, v in enumerate(rng.choice(9, 1 + 40 * c))]
    got = {r.c: r.threshold for r in selection.exact_percentile(spark.createDataFrame(rows, "c int, id long, v double").repartition(6), "c", "v", "id", 97.5).collect()}
    assert got == {c: pytest.approx(np.percentile([v for d, _, v in rows if d == c], 97.5)) for c in range(3)}


def plain_greedy(rows, limit, target):
    kept, out = {}, {}
    for combo, i, quality, m2, ref, h in sorted(rows, key=lambda r: r[1]):
        own = kept.setdefault(combo, [])
        if len(own) >= target:
            out[i] = "not reached"
        elif not quality:
            out[i] = "quality"
        elif not m2:
            out[i] = "outlier"
        elif any(((h ^ x) & (2**64 - 1)).bit_count() <= limit for x in own):
            out[i] = "self duplicate"
        elif ref:
            out[i] = "reference duplicate"
        else:
            out[i] = "kept"
            own.append(h)
    return out


@pytest.mark.parametrize("target", [1 << 30, 6])
def test_greedy_rounds_equal_the_sequential_rule(spark, monkeypatch, target):
    """One hot group of chains, copies and loners over many blocks."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(6)
    rows, h = [], int(rng.integers(0, 2**63))
    for i in range(400):
        h = int(rng.integers(0, 2**63)) if i % 9 == 0 else h if i % 5 == 0 else h ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62)))
        rows.append((0 if i % 8 else 1, i, bool(rng.random() > 0.1), bool(rng.random() > 0.1), bool(rng.random() < 0.2), h))
    df = spark.createDataFrame(rows, "combo int, id long, quality_ok boolean, m2_ok boolean, ref_near boolean, hash long").repartition(5)
    rounds = []
    got = {r.id: r.decision for r in selection.greedy_gate(df, 3, target, rounds).collect()}
    assert got == plain_greedy(rows, 3, target)
    assert 1 < len(rounds) < 12 and rounds == sorted(rounds, reverse=True)


def test_greedy_of_nothing(spark):
    df = spark.createDataFrame([], "combo int, id long, quality_ok boolean, m2_ok boolean, ref_near boolean, hash long")
    assert selection.greedy_gate(df, 3, 5).collect() == []
    one = df.union(spark.createDataFrame([(1, 2, False, True, False, 5)], df.schema))
    assert [r.decision for r in selection.greedy_gate(one, 3, 5).collect()] == ["quality"]


def test_packed_vectors(spark):
    got = spark.range(1).select(selection.packed(F.array(F.lit(1.5), F.lit(-2.0))).alias("x")).first().x
    assert np.frombuffer(bytes(got)).tolist() == [1.5, -2.0]
