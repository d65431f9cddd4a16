import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import centroids
from sievewright.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, scale, size, seed=2):
    kept = [(i, [math.floor(scale * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    h = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    now = [x for _, x in sorted(kept, key=lambda r: (h(r[0]), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        now = [[sum(col) // len(col) for col in zip(*own)] if (own := [x for (_, x), j in zip(kept, of) if j == c]) else old for c, old in enumerate(now)]
    last = [nearest(x) for _, x in kept]
    each = {j: sum(d for d, c in last if c == j) for _, j in last}
    name = lambda j: hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()
    return sorted(((i, j, d, each[j], sum(each.values()), name(j)) for (i, _), (d, j) in zip(kept, last)), key=str)


def of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=30), st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=9), st.sampled_from([1, 1 << 21]))
def test_annulus_finds_the_nearest_and_the_smaller_number(xs, cs, times):
    x, c = np.array(xs, np.int64) * times, np.array(cs, np.int64) * times
    number, distance, done = centroids.assign(x, c)
    all_ = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
    assert len(x) <= done <= len(x) * len(c)


def test_the_annulus_skips_centroids():
    rng = np.random.default_rng(1)
    c = rng.integers(-20, 20, (30, 8)) + np.arange(30)[:, None] * 400
    x = c[rng.integers(0, 30, 2000)] + rng.integers(-5, 5, (2000, 8))
    assert centroids.assign(x, c)[2] < 4 * len(x)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.choice([-0.5, 0.0, 0.25, 1.0], 4).tolist()) for i in range(150)]
    rows += [(7, [0.0] * 4), (7, [0.0] * 4), (None, [1.0] * 4), (900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [1.0] * 3), (905, [])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).repartition(5)
    assert of(centroids.centroid_clusters(spark, df, k=9, rounds=4, scale=16, size=4)) == brute(rows, 9, 4, 16, 4)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids_and_clashing_columns(spark, n):
    rows = [(i, [float(i), -1.0]) for i in range(n)]
    df = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], "vec_id long, embedding array<double>, cluster int, x int, distance long")
    assert of(centroids.centroid_clusters(spark, df, k=5, rounds=2, scale=256, size=2)) == brute(rows, 5, 2, 256, 2)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(v)) for v in np.random.default_rng(i).uniform(-2e5, 2e5, 3)]) for i in range(40)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    assert of(centroids.centroid_clusters(spark, df, k=6, rounds=3, scale=256, size=3)) == brute(rows, 6, 3, 256, 3)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = QUERIES["op12_centroids"](spark, sf)
    want = con.sql(ORACLE["op12_centroids"])
    at = [want.columns.index(c) for c in got.columns]
    assert of(got) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
