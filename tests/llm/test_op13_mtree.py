import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import mtree
from sievewright.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(v))) for v in e]) for i, e in rows if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), j) for m, (j, x) in enumerate(kept) if m != n)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def of(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**31), st.sampled_from([2, 1000]), st.integers(1, 12))
def test_a_tree_finds_the_best_with_ties(n, seed, spread, k):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(-spread, spread, (n, 3)), axis=0)
    most = int((x**2).sum(axis=1).max())
    pages = [
        {"page": i, "inner": p["inner"], "pivot": x[p["pivot"]].tobytes(), "vectors": x[p["entries"]].tobytes(), "radii": p["radii"], "away": p["away"], "child": p["child"], "ids": [] if p["inner"] else [[int(e)] for e in p["entries"]]}
        for i, p in enumerate(mtree.build(x, mtree._last(x, most)))
    ]
    tree = mtree.Tree(pages, 3, most)
    for q in rng.integers(-spread, spread, (5, 3)):
        scores = x @ q
        want = sorted((-int(s), i) for i, s in enumerate(scores))[:k]
        assert sorted(tree.search(q, k, -np.inf)[0]) == want
        bound = -want[-1][0]
        assert sorted(tree.search(q, k, bound)[0]) == want


def test_stored_distances_save_computations():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (60, 16))
    x = np.unique(np.floor(1024 * (centres[rng.integers(0, 60, 12_000)] + rng.normal(0, 0.02, (12_000, 16)))).astype(np.int64), axis=0)
    most = int((x**2).sum(axis=1).max())
    built = mtree.build(x, mtree._last(x, most))
    assert max(len(p["entries"]) for p in built) <= mtree.LEAF and len(built) > 90
    tree = mtree.Tree([{"page": i, "inner": p["inner"], "pivot": x[p["pivot"]].tobytes(), "vectors": x[p["entries"]].tobytes(), "radii": p["radii"], "away": p["away"], "child": p["child"], "ids": [[int(e)] for e in p["entries"]]} for i, p in enumerate(built)], 16, most)
    assert np.mean([tree.search(x[i], 11, -np.inf)[1] for i in range(0, len(x), 500)]) < 0.4 * len(x)


def test_every_entry_of_the_index_is_a_row(spark):
    rows = [(i, np.random.default_rng(i).normal(0, 0.2, 8).tolist(), 0) for i in range(1500)]
    v = mtree.whole_vectors(spark.createDataFrame(rows, SCHEMA), 1024)
    most = v.selectExpr("aggregate(x, 0L, (a, b) -> a + b * b) AS m").agg({"m": "max"}).first()[0]
    pages, trees, _ = mtree.index(spark, mtree._distinct(v, 11), 8, most, 200)
    ids = [i for p in pages.filter("not inner").collect() for e in p["ids"] for i in e]
    assert sorted(ids) == list(range(1500)) and trees.count() > 5


@pytest.mark.parametrize("tree", [40, 16_384])
def test_ties_copies_repeats_and_unusable_rows(spark, tree, monkeypatch):
    monkeypatch.setattr(mtree, "SLICE", 7)
    rng = np.random.default_rng(8)
    rows = [(i, rng.choice([-0.5, 0.0, 0.25], 5).tolist()) for i in range(400)]
    rows += [(i, [0.25] * 5) for i in range(1000, 1300)] + [(20, [0.25] * 5), (20, [0.25] * 5), (-40, [-0.5] * 5)]
    rows += [(None, [0.5] * 5), (500, None), (510, [0.1, None, 0.0, 0.0, 0.0]), (520, [float("nan")] * 5), (530, [float("-inf")] * 5)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).repartition(6)
    assert of(mtree.top_scores(spark, df, k=4, every=10, tree=tree)) == brute(rows, 4, 10)


def test_unequal_sizes_and_clashing_columns(spark):
    rows = [(i, np.random.default_rng(i).normal(0, 1, i % 4).tolist()) for i in range(30)]
    df = spark.createDataFrame([(i, e, 1, "a", 2.0, [1]) for i, e in rows], "vec_id long, embedding array<double>, x int, rank string, score double, ids array<int>")
    want = [(i, [float(v) for v in e]) for i, e in rows]
    got = of(mtree.top_scores(spark, df, k=3, every=5))
    assert got == sorted((i, r, j, s) for i, r, j, s in _padded(want, 3, 5))


def _padded(rows, k, every):
    whole = [(i, [math.floor(1024 * v) for v in e] + [0] * (4 - len(e))) for i, e in rows]
    for i, q in whole:
        if i % every == 0:
            for r, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in whole if j != i)[:k], 1):
                yield i, r, j, -s


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(v)) for v in np.random.default_rng(i).uniform(-6e4, 6e4, 4)]) for i in range(60)]
    assert of(mtree.top_scores(spark, spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA), k=5, every=4)) == brute(rows, 5, 4)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, [1.0, 0.5], 0) for i in range(n)], SCHEMA)
    assert of(mtree.top_scores(spark, df)) == brute([(i, [1.0, 0.5]) for i in range(n)], 10, 100)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = QUERIES["op13_mtree"](spark, sf)
    want = con.sql(ORACLE["op13_mtree"])
    at = [want.columns.index(c) for c in got.columns]
    assert of(got) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_the_driver_takes_few_rows_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SAMPLE", 64)
    classes = spark.range(0, 6000, 1, 60).selectExpr("transform(sequence(1, 64), i -> xxhash64(id, i) % 1000) AS x", "array(id) AS ids")
    want = [r["x"] for r in classes.collect()]
    key = {tuple(r["x"]): r["h"] for r in classes.selectExpr("x", "xxhash64(x) AS h").collect()}
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")  # of all tasks of a job; 64 rows of each are 2 MB
    try:
        start = mtree.index(spark, classes, 64, 64_000_000, 4096)[2]
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert start["sample"].tolist() == sorted(want, key=lambda x: key[tuple(x)])[:64]


def test_the_least_rows_where_hashes_crowd(spark, monkeypatch):
    """A share below which too few rows lie is widened, down to all rows."""
    monkeypatch.setattr(mtree, "SAMPLE", 8)
    classes = spark.range(40).selectExpr("array(id) AS x", "array(id) AS ids")
    got = [[r["x"] for r in mtree._least(classes, n)] for n in (40, 10**6, 10**12)]
    want = [r["x"] for r in classes.selectExpr("x", "xxhash64(x) AS h").orderBy("h").limit(8).collect()]
    assert got == [want] * 3


def test_no_blocks_of_queries_reach_the_driver(spark, monkeypatch):
    """Blocks were joined to the trees and taken for as small as the queries' file, hence broadcast: 334 MB of 7,200 queries."""
    monkeypatch.setattr(mtree, "cut", lambda spark, df, label, made=mtree.cut: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), made(spark, df, label))[1])
    plans = {}
    rows = [(i, np.random.default_rng(i).normal(0, 0.2, 8).tolist(), 0) for i in range(600)]
    got = mtree.top_scores(spark, spark.createDataFrame(rows, SCHEMA), k=3, every=10, tree=50)
    assert of(got) == brute(rows_of(rows), 3, 10)
    plans["result"] = got._jdf.queryExecution().executedPlan().toString()
    assert {"found", "result"} <= set(plans) and not [k for k, p in plans.items() if "Broadcast" in p]


def rows_of(rows):
    return [r[:2] for r in rows]


def test_a_tree_without_vectors_is_passed_over():
    queries = {"numbers": np.array([5]).tobytes(), "x": np.array([1, 2]).tobytes(), "bounds": np.array([-np.inf]).tobytes()}
    ints = ("numbers", "x", "bounds")
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([None]), pa.array([queries], pa.struct([(c, pa.binary()) for c in ints]))],
        ["tree", "slice", "block", "node", "queries"],
    )
    assert sum(len(b) for b in mtree._searched(2, 10, 3)(iter([batch]))) == 0


def test_nearest_pivots_by_products():
    rng = np.random.default_rng(4)
    x, p = rng.integers(-500, 500, (3000, 8)), rng.integers(-500, 500, (40, 8))
    most = int(max((x**2).sum(axis=1).max(), (p**2).sum(axis=1).max()))
    last, lasts = mtree._last(x, most), mtree._last(p, most)
    gaps = np.stack([mtree._gaps(x, last, v, w) for v, w in zip(p, lasts)])
    own = mtree._nearest(x, last, p, lasts)
    assert np.allclose(gaps[own, np.arange(3000)], gaps.min(axis=0)) and np.array_equal(mtree._gaps(x, last, p[own], lasts[own]), gaps[own, np.arange(3000)])
