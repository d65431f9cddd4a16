import pickle

import numpy as np
import pytest

from sievewright.operators import forest
from sievewright.plans import catalogue, selecting

SCHEMA = "experiment int, id long, y int, x array<double>"


def blobs(n, seed, classes=3, d=6, first=0):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(99).normal(0, 1.2, (classes, d))
    y = rng.integers(0, classes, n)
    return np.arange(first, first + n), y, middles[y] + rng.normal(0, 1, (n, d))


def rows_of(ids, y, x, experiment=0):
    return [(experiment, int(i), int(c), [float(v) for v in r]) for i, c, r in zip(ids, y, x)]


def plain_tree(b, y, w, seed, tree, classes, tried, leaf):
    """One tree, node by node."""

    def node(rows, path, above, depth):
        counts = np.bincount(y[rows], w[rows], classes)
        vote = int(counts.argmax()) if len(rows) else above
        gini = lambda c: c.sum() - (c**2).sum() / max(c.sum(), 1)
        best, found = 1e-12, None
        if (counts > 0).sum() > 1 and depth < forest.DEPTH:
            for f in forest.candidates(seed, np.array([tree]), np.array([path]), b.shape[1], tried)[0]:
                gains = []
                for cut in range(forest.BINS - 1):
                    low = np.bincount(y[rows[b[rows, f] <= cut]], w[rows[b[rows, f] <= cut]], classes)
                    high = counts - low
                    ok = low.sum() >= leaf and high.sum() >= leaf
                    gains.append(gini(counts) - gini(low) - gini(high) if ok else -1)
                j = int(np.argmax(gains))
                if gains[j] > best + 1e-9:
                    best, found = gains[j], (int(f), j)
        if found is None:
            return vote
        f, cut = found
        right = b[rows, f] > cut
        return (f, cut, node(rows[~right], path * 2 % (1 << 40), vote, depth + 1), node(rows[right], (path * 2 + 1) % (1 << 40), vote, depth + 1))

    return node(np.flatnonzero(w), 1, 0, 0)


def said(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def test_trees_equal_plain_ones_on_fifty_rows():
    ids, y, x = blobs(50, 1)
    b = forest.binned(x, forest.cuts(x))
    trees = [0, 1, 2, 3]
    nodes = forest.grown(b, y, ids, 3, 11, trees, 2, 2)
    got = forest.votes(nodes, b, 4)
    for k in trees:
        plain = plain_tree(b.astype(int), y, forest.bag(11, k, ids), 11, k, 3, 2, 2)
        assert [said(plain, r) for r in b] == got[:, k].tolist()


def test_bags_are_poisson_and_independent():
    w = np.stack([forest.bag(3, t, np.arange(4000)) for t in range(20)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert np.abs(np.corrcoef(w) - np.eye(20)).max() < 0.07


def test_a_larger_forest_begins_with_the_smaller(spark):
    ids, y, x = blobs(120, 2)
    train = spark.createDataFrame(rows_of(ids, y, x), SCHEMA)
    few, many = (forest.grow(spark, train, [5], n, 3) for n in (50, 100))
    small = {r.lot: (bytes(r.trees), r.oob) for r in few.collect()}
    large = {r.lot: (bytes(r.trees), r.oob) for r in many.collect()}
    assert sorted(small) == [0, 1] and sorted(large) == [0, 1, 2, 3] and all(large[k] == small[k] for k in small)


def test_growth_curve_equals_one_fit_of_each_size(spark):
    ids, y, x = blobs(90, 3)
    tid, ty, tx = blobs(70, 4, first=1000)
    train = spark.createDataFrame(rows_of(ids, y, x, 0) + rows_of(ids[:60], y[:60], x[:60], 1), SCHEMA).repartition(4)
    test = spark.createDataFrame([r[1:] for r in rows_of(tid, ty, tx)], "id long, y int, x array<double>")
    trees = 60
    made = forest.grow(spark, train, [1, 2], trees, 3)
    got = {(r.experiment, r.seed, r.n_estimators): r for r in forest.growth(spark, made, test, 3, trees).collect()}
    assert sorted(got) == [(e, s, n) for e in (0, 1) for s in (1, 2) for n in (25, 50, 60)]
    for (e, s, n), r in got.items():
        i, c, v = (ids, y, x) if e == 0 else (ids[:60], y[:60], x[:60])
        t = forest.cuts(v)
        nodes = forest.grown(forest.binned(v, t), c, i, 3, s, list(range(n)), 2, 2)
        own, other = forest.votes(nodes, forest.binned(v, t), n), forest.votes(nodes, forest.binned(tx, t), n)
        tally = lambda votes, weight: np.stack([((votes == k) * weight).sum(axis=1) for k in range(3)], axis=1)
        out_of = tally(own, np.stack([forest.bag(s, k, i) == 0 for k in range(n)], axis=1))
        there = out_of.sum(axis=1) > 0
        assert r.oob_score == pytest.approx((out_of.argmax(axis=1) == c)[there].mean())
        p = tally(other, 1).argmax(axis=1)
        f1 = [2 * ((p == k) & (ty == k)).sum() / max(1, (p == k).sum() + (ty == k).sum()) for k in range(3)]
        assert r.test_accuracy == pytest.approx((p == ty).mean()) and r.f1 == pytest.approx(f1)
        assert r.test_macro_f1 == pytest.approx(np.mean(f1)) and r.test_weighted_f1 == pytest.approx(sum(f * (ty == k).mean() for k, f in enumerate(f1)))
    assert got[0, 1, 60].test_accuracy > 0.6


def test_a_bounded_sample_and_one_class(spark):
    ids, y, x = blobs(200, 5)
    made = forest.grow(spark, spark.createDataFrame(rows_of(ids, y, x), SCHEMA), [1], 25, 3, most=40).collect()
    assert len(made[0].ids) == 40
    one = spark.createDataFrame(rows_of(ids[:30], y[:30] * 0, x[:30]), SCHEMA)
    r = forest.growth(spark, forest.grow(spark, one, [1], 25, 1), one.select("id", "y", "x"), 1, 25).first()
    assert (r.oob_score, r.test_accuracy, r.test_macro_f1) == (1.0, 1.0, 1.0)
    assert pickle.loads(bytes(made[0].trees))[2] == 25


def test_votes_stay_in_their_tasks_and_lots_are_small(spark):
    """Test rows and forests meet by slices and leave as counts of a lot; votes as rows of (forest, lot, row) took the time."""
    ids, y, x = blobs(400, 6)
    rows = spark.createDataFrame(rows_of(ids, y, x), SCHEMA)
    made = forest.grow(spark, rows, [1], 50, 3)
    lot = made.first()
    t, nodes, n = pickle.loads(bytes(lot.trees))
    assert n == 25 and len(lot.trees) < t.nbytes + 16 * len(nodes["vote"]) + 1000
    plan = forest.growth(spark, made, rows.select("id", "y", "x"), 3, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_all_rows_are_trained_on(spark):
    """20,000 rows of least hash stood for larger sets before."""
    df = spark.range(20_500).selectExpr("0 AS experiment", "id", "cast(id % 2 AS int) AS y", "array(cast(id % 7 AS double), cast(id % 11 AS double)) AS x")
    assert len(forest.grow(spark, df, [1], 1, 2).first().ids) == 20_500


def test_large_sets_in_blocks_equal_sets_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROUND", 25 * 330)  # a lot a round
    ids, y, x = blobs(300, 7)
    tid, ty, tx = blobs(90, 8, first=1000)
    train = spark.createDataFrame(rows_of(ids, y, x, 0) + rows_of(ids[:30], y[:30], x[:30], 1), SCHEMA).repartition(3)
    test = spark.createDataFrame([r[1:] for r in rows_of(tid, ty, tx)], "id long, y int, x array<double>")
    want = {(r.experiment, r.seed, r.n_estimators): r for r in forest.growth(spark, forest.grow(spark, train, [1, 2], 30, 3), test, 3, 30).collect()}
    got = {(r.experiment, r.seed, r.n_estimators): r for r in forest.scores(spark, train, test, [1, 2], 30, 3, held=60 * 6).collect()}
    assert got == want and len(want) == 8


def test_large_sets_of_one_class_and_without_a_split(spark):
    rows = spark.range(50).selectExpr("cast(id % 2 AS int) AS experiment", "id", "cast(id % 2 = 1 AND id % 4 > 1 AS int) AS y", "array(1.0D, 2.0D) AS x")
    test = rows.filter("id < 10").select("id", "y", "x")
    want = sorted(forest.growth(spark, forest.grow(spark, rows, [3], 25, 2), test, 2, 25).collect())
    assert sorted(forest.scores(spark, rows, test, [3], 25, 2, held=10).collect()) == want


@pytest.mark.parametrize("n", [2, 33, 100, 1001])
def test_thresholds_by_places_equal_quantiles(spark, n):
    x = np.random.default_rng(n).normal(0, 1, (n, 2)).round(1 if n == 100 else 9)
    df = spark.createDataFrame(rows_of(range(n), [0] * n, x, 4), SCHEMA)
    assert np.array_equal(forest.quantiles(df, {4: n})[4], forest.cuts(x))


def test_trees_in_parts_vote_as_side_by_side(monkeypatch):
    ids, y, x = blobs(200, 9)
    b = forest.binned(x, forest.cuts(x))
    want = forest.votes(forest.grown(b, y, ids, 3, 5, list(range(7)), 2, 2), b, 7)
    monkeypatch.setattr(forest, "BESIDE", 600)
    assert np.array_equal(forest.votes(forest.grown(b, y, ids, 3, 5, list(range(7)), 2, 2), b, 7), want)


def test_seed_scores_do_not_depend_on_what_a_task_holds(spark, sf, monkeypatch):
    """The query trains on every row: in blocks, its sets of up to 160 rows give the accuracies that they give whole."""
    monkeypatch.setattr(selecting, "RF_TREES", 3)
    monkeypatch.setattr(selecting, "RF_SEEDS", 1)
    want = sorted(catalogue.QUERIES["rf_seed_scores"](spark, sf).collect())
    monkeypatch.setattr(forest, "HELD", 64 * 20)
    assert sorted(catalogue.QUERIES["rf_seed_scores"](spark, sf).collect()) == want and len(want) == 5
