import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.operators import neighbours, similarity


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 24)


def distance(kind, x, y):
    if kind == "hamming":
        return (int(x) ^ int(y)).bit_count() if x >= 0 and y >= 0 else ((int(x) & (2**64 - 1)) ^ (int(y) & (2**64 - 1))).bit_count()
    x, y = np.array(x, float), np.array(y, float)
    if kind == "cosine":
        return round(1 - float(x @ y) / (max(np.sqrt(x @ x), 1e-12) * max(np.sqrt(y @ y), 1e-12)), 9)
    return round(float(np.sqrt(((x - y) ** 2).sum())), 9)


def some(kind, n, seed, first=0):
    rng = np.random.default_rng(seed)
    if kind == "hamming":
        values = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 6)]
        return [(first + i, int(rng.integers(0, 3)) or None, values[i % 6] ^ int(rng.integers(0, 2**20))) for i in range(n)]
    middles = rng.normal(0, 1, (5, 4))
    return [(first + i, int(rng.integers(0, 3)) or None, [round(float(v), 1) for v in middles[i % 5] + rng.normal(0, 0.3, 4)]) for i in range(n)]


def frame(spark, kind, rows):
    return spark.createDataFrame(rows, f"id long, g int, v {'long' if kind == 'hamming' else 'array<double>'}").repartition(3)


@pytest.mark.parametrize("kind", ["hamming", "cosine", "euclid"])
@pytest.mark.parametrize("group", [None, "g"])
def test_k_nearest_equal_brute_force(spark, kind, group):
    q, b = some(kind, 60, 1), some(kind, 150, 1, 1000)
    found = neighbours.nearest_k(frame(spark, kind, q), frame(spark, kind, b), "v", kind, 3, group=group)
    got = sorted((r.query_id, r["rank"], r.base_id, round(r.distance, 6)) for r in found.collect())
    want = []
    for i, g, x in q:
        near = sorted((distance(kind, x, y), j) for j, h, y in b if group is None or g == h)[:3]
        want += [(i, n + 1, j, round(float(d), 6)) for n, (d, j) in enumerate(near)]
    assert got == sorted(want)


@pytest.mark.parametrize("kind,limit", [("hamming", 12), ("hamming", 30), ("cosine", 0.05), ("euclid", 0.4)])
def test_pairs_and_rows_within_a_limit(spark, kind, limit):
    a, b = some(kind, 70, 2), some(kind, 90, 2, 500)
    want = {(i, j) for i, _, x in a for j, _, y in b if distance(kind, x, y) <= limit}
    left, right = frame(spark, kind, a), frame(spark, kind, b)
    assert {(r.query_id, r.base_id) for r in neighbours.pairs_within(left, right, "v", kind, limit).collect()} == want
    assert sorted(r.query_id for r in neighbours.with_neighbour(left, right, "v", kind, limit).collect()) == sorted({i for i, _ in want})


def test_manifold_membership(spark):
    a, b = some("euclid", 80, 4), some("euclid", 60, 4, 500)
    radii = {j: round(0.05 * (j % 9), 3) for j, _, _ in b}
    m = spark.createDataFrame([(j, g, y, radii[j]) for j, g, y in b], "id long, g int, v array<double>, r double")
    got = neighbours.in_manifold(frame(spark, "euclid", a), m, "v", "r", group="g")
    assert sorted(r.query_id for r in got.collect()) == sorted({i for i, g, x in a for j, h, y in b if g == h and distance("euclid", x, y) <= radii[j]})


def test_cells_that_lie_apart_are_never_compared(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 1, (12, 8))
    rows = [(i, 0, (middles[i % 12] + rng.normal(0, 0.01, 8)).tolist()) for i in range(1200)]
    df = frame(spark, "cosine", rows)
    b, q = neighbours.blocks(df, "v", "cosine"), neighbours.blocks(df.filter("id % 5 = 0"), "v", "cosine")
    found, more, pairs, done = neighbours.searched(q, b, "cosine", 2)
    assert done.count() < 0.3 * pairs.count()
    got = {(r.query_id, r["rank"]): r.base_id for r in neighbours._merged(found, more, 2).collect()}
    assert len(got) == 480 and all(got[i, 1] == i for i in range(0, 1200, 5))


@pytest.mark.parametrize("kind", ["hamming", "cosine"])
def test_empty_sides_nulls_and_copies(spark, kind):
    one = 5 if kind == "hamming" else [1.0, 0.0]
    rows = [(i, 1, one) for i in range(100)] + [(200, 1, None)]
    df = frame(spark, kind, rows)
    got = neighbours.nearest_k(df, df, "v", kind, 2).collect()
    assert sorted((r.query_id, r["rank"], r.base_id) for r in got) == sorted((i, k, k - 1) for i in range(100) for k in (1, 2))
    assert neighbours.nearest_k(df.limit(0), df, "v", kind).collect() == [] == neighbours.nearest_k(df, df.limit(0), "v", kind).collect()
    assert neighbours.with_neighbour(df, df.limit(0), "v", kind, 1).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 5), st.sampled_from(["hamming", "cosine", "euclid"]))
def test_the_kernel_breaks_ties_by_id(seed, k, kind):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (9, 2)).astype(float) + 1
    y = rng.integers(0, 4, (14, 2)).astype(float) + 1
    if kind == "hamming":
        x, y = x[:, 0].astype(np.uint64), y[:, 0].astype(np.uint64)
    elif kind == "cosine":
        x, y = (v / np.sqrt((v**2).sum(axis=1, keepdims=True)) for v in (x, y))
    ids = rng.permutation(14)
    side = lambda i, v: {"ids": list(i), "x": v.tobytes(), "n": len(i), "extra": [0.0] * len(i)}
    got = neighbours.best(kind, k)(side(range(9), x), side(ids, y)).to_pylist()
    for i in range(9):
        near = sorted((float(neighbours.exact(kind, x[i : i + 1], y[j : j + 1])[0]), int(ids[j])) for j in range(14))[:k]
        assert [(r["distance"], r["base_id"]) for r in got if r["query_id"] == i] == near


@pytest.mark.parametrize("limit", [3, 7, 8, 10, 11, 12, 18])
def test_hamming_joins_of_any_width_are_lossless(spark, limit):
    rng = np.random.default_rng(limit)
    base = int(rng.integers(-(2**63), 2**63 - 1))
    rows = [(0, base)]
    for i in range(1, 160):
        flips = rng.choice(64, int(rng.integers(0, 24)), replace=False)
        rows.append((i, int(np.bitwise_xor.reduce(np.array([base & (2**64 - 1), *[1 << int(f) for f in flips]], np.uint64)).astype(np.int64))))
    df = spark.createDataFrame([*rows, (999, None)], "id long, hash long")
    want = {(i, j, distance("hamming", x, y)) for i, x in rows for j, y in rows if distance("hamming", x, y) <= limit}
    assert {tuple(r) for r in similarity.hamming_join(df, df, limit).collect()} == want
    assert {r.id for r in similarity.near_rows(df.filter("id < 50"), df.filter("id >= 50"), limit).collect()} == {i for i, j, _ in want if i < 50 <= j}
