"""Random forests that are grown on, with out-of-bag scores at every size.

A forest's trees are independent given their number: bag, features of each node and thresholds come from hashes of
(seed, tree, row), so a forest of 500 trees begins with the same 25 trees as one of 25, and growth reuses what
is there. Trees are dealt to tasks in lots of ``LOT``; a lot grows level by level, all its trees side by side, on
binned features: one sort by (node, bin) a candidate feature and running class counts find the best splits of a level.

All rows of a training set are trained on. Sets of up to ``HELD`` values are sent as packed rows of a table in the shared
folder and read by every share of lots; test rows are blocks that meet the lots' trees by an equi-join, and what leaves
a task are votes summed over its lot. Larger sets (``wide``) stay in blocks: thresholds are exact quantiles by places in ranges, nodes
of more rows than a task holds are split by histograms that blocks send and nodes sum, and once a node is small its rows meet in
one task that grows the rest. Out-of-bag and test rows meet those subtrees by slices. Both give the same trees and scores.
Running sums over lots give the votes of every size.

Defined results: a row is in a tree's bag as often as its Poisson(1) draw says; a node splits where the weighted
Gini impurity falls most, the earlier candidate and the lower threshold first, and keeps ``leaf`` drawn rows on each
side; a leaf votes for its most frequent class, the smaller first; out-of-bag votes of a row are those of the trees that do
not have it, rows without any are left out of the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import kept, ordinals

LOT, BINS, DEPTH, BLOCK = 25, 32, 24, 4096
#: Values (rows times features) of a training set or node that one task grows on, rows times trees that grow side by side, and in one round of large sets.
HELD, BESIDE, ROUND = 3_200_000, 250_000, 50_000_000
#: Lots that share one copy of the training rows, blocks of test rows that share one copy of a forest.
SHARE, SLICE = 5, 16


def hashed(*ids) -> np.ndarray:
    """64 mixed bits of integers, as unsigned; products wrap."""
    x = np.full(1, 0x9E3779B97F4A7C15, np.uint64)
    for i in ids:
        x = (x ^ np.atleast_1d(i).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(32))
    return x


def bag(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a tree draws each row: Poisson(1) by the cumulative shares 1/e, 2/e, 2.5/e and on."""
    u = (hashed(seed, tree, rows) >> np.uint64(11)).astype(float) / 2.0**53
    shares = np.cumsum(1 / np.cumprod([1.0, 1, 2, 3, 4, 5, 6, 7])) / np.e
    return np.searchsorted(shares, u, side="right")


def cuts(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds (feature, bins - 1) at quantiles."""
    return np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T


def binned(x: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Bin of each value: the number of thresholds that it exceeds."""
    return np.stack([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(thresholds)], axis=1).astype(np.uint8)


def candidates(seed: int, tree: np.ndarray, node: np.ndarray, features: int, tried: int) -> np.ndarray:
    """The features that each node tries: those of least hash, which differ as the mix of a node's hash and a feature can be undone."""
    h = hashed(seed, 7 + tree[:, None], 1_000_003 + node[:, None], np.arange(features)[None, :])
    if tried >= features:
        return np.argsort(h, axis=1, kind="stable")
    least = np.argpartition(h, tried - 1, axis=1)[:, :tried]
    return np.take_along_axis(least, np.argsort(np.take_along_axis(h, least, axis=1), axis=1, kind="stable"), axis=1)


def _gains(low: np.ndarray, total: np.ndarray, parent: np.ndarray, leaf: int) -> np.ndarray:
    """The fall of impurity by classes (first axis) left of a cut; counts are whole numbers, so sums are exact in any order."""
    a, size = low.sum(axis=0), total.sum(axis=0)
    c = size - a
    left = np.einsum("c...,c...->...", low, low)
    right = np.einsum("c...,c...->...", total, total) - 2 * np.einsum("c...,c...->...", total, low) + left
    impurity = a - left / np.maximum(a, 1) + c - right / np.maximum(c, 1)
    return np.where((a >= leaf) & (c >= leaf), parent - impurity, -1)


def _cut(at: np.ndarray, value: np.ndarray, y: np.ndarray, w: np.ndarray, total: np.ndarray, parent: np.ndarray, leaf: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The best gain and its bin, the lowest of equals, for each node by one feature each; ``total`` is (class, node).

    Few nodes with many rows have a table of all bins; many nodes with few rows sort theirs.
    """
    classes, n = total.shape
    if n * bins <= len(at):
        low = np.bincount((y * n + at) * bins + value, w, classes * n * bins).reshape(classes, n, bins).cumsum(axis=2)
        gain = _gains(low, np.broadcast_to(total[:, :, None], low.shape), parent[:, None], leaf)
        cut = gain.argmax(axis=1)
        return gain[np.arange(n), cut], cut
    bits = int(classes).bit_length()
    packed = np.sort(((((at * bins + value) << bits) + y) << 4) + w)  # a row is drawn at most 8 times
    key, y, w = packed >> (bits + 4), (packed >> 4) & ((1 << bits) - 1), packed & 15
    starts = np.r_[True, key[1:] != key[:-1]]
    group, key = np.cumsum(starts) - 1, key[starts]
    of = key // bins
    upto = np.bincount(y * len(key) + group, w, classes * len(key)).reshape(classes, -1).cumsum(axis=1)
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])  # every node has rows
    before = np.concatenate([np.zeros((classes, 1)), upto[:, start[1:] - 1]], axis=1)
    gain = _gains(upto - before[:, of], total[:, of], parent[of], leaf)
    most = np.maximum.reduceat(gain, start)
    hit = np.flatnonzero(gain == most[of])
    hit = hit[np.r_[True, of[hit[1:]] != of[hit[:-1]]]]
    return most, key[hit] % bins


def grown(b: np.ndarray, y: np.ndarray, rows: np.ndarray, classes: int, seed: int, trees: list[int], tried: int, leaf: int, bins: int = BINS, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """The nodes of some trees over binned rows: tree, feature (-1 for a leaf), bin, left child, vote; a tree's root is its first node."""
    most = max(1, BESIDE // max(1, len(rows)))
    if len(trees) <= most:
        return _grown_on(b, y, np.stack([bag(seed, tree, rows) for tree in trees]), classes, seed, trees, tried, leaf, bins, depth)
    return _beside([grown(b, y, rows, classes, seed, trees[at : at + most], tried, leaf, bins, depth) for at in range(0, len(trees), most)], [len(trees[at : at + most]) for at in range(0, len(trees), most)])


def _beside(parts: list[dict[str, np.ndarray]], trees: list[int]) -> dict[str, np.ndarray]:
    """Nodes of several runs as those of one: all roots first."""
    roots, rest, first, after = [], [], 0, sum(trees)
    for nodes, n in zip(parts, trees):
        left = np.where(nodes["feature"] >= 0, nodes["left"] + after - n, nodes["left"])
        moved = nodes | {"tree": nodes["tree"] + first, "left": left}
        roots.append({k: v[:n] for k, v in moved.items()})
        rest.append({k: v[n:] for k, v in moved.items()})
        first, after = first + n, after + len(left) - n
    return {k: np.concatenate([v[k] for v in roots + rest]) for k in parts[0]}


def _grown_on(b: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, seed: int, trees: list[int], tried: int, leaf: int, bins: int = BINS, depth: int = DEPTH, top: int = 1) -> dict[str, np.ndarray]:
    """As ``grown`` with draws (tree, row) given, below node ``top`` of each tree; 1 is the root, 2n and 2n + 1 are children of n."""
    at, row = np.nonzero(weight)  # the node of its level that each drawn row is in
    w = weight[at, row]
    tree, path, n_nodes, levels = np.arange(len(trees)), np.full(len(trees), top, np.int64), len(trees), []
    for level in range(top.bit_length() - 1, depth + 1):
        total = np.bincount(y[row] * len(tree) + at, w, classes * len(tree)).reshape(classes, -1)
        feature, cut, left = np.full(len(tree), -1), np.zeros(len(tree), np.int64), np.zeros(len(tree), np.int64)
        levels.append({"tree": tree, "feature": feature, "bin": cut, "left": left, "vote": total.argmax(axis=0)})
        size = total.sum(axis=0)
        can = ((total > 0).sum(axis=0) > 1) & (size >= 2 * leaf)
        if level == depth or not can.any():
            break
        open_ = np.flatnonzero(can)
        live = can[at]
        row, w, at = row[live], w[live], (np.cumsum(can) - 1)[at[live]]
        total, size = total[:, open_], size[open_]
        tries = candidates(seed, np.array(trees)[tree[open_]], path[open_], b.shape[1], tried)
        best, of, by = np.full(len(open_), 1e-12), np.full(len(open_), -1), np.zeros(len(open_), np.int64)
        parent = size - (total**2).sum(axis=0) / np.maximum(size, 1)
        class_of = y[row]
        for k in range(tries.shape[1]):
            gain, place = _cut(at, b[row, tries[at, k]].astype(np.int64), class_of, w, total, parent, leaf, bins)
            better = gain > best + 1e-9
            best[better], of[better], by[better] = gain[better], tries[better, k], place[better]
        splits = of >= 0
        if not splits.any():
            break
        into = open_[splits]
        feature[into], cut[into], left[into] = of[splits], by[splits], n_nodes + 2 * np.arange(len(into))
        goes = splits[at]
        row, w, at = row[goes], w[goes], at[goes]
        right = b[row, of[at]] > by[at]
        at = 2 * (np.cumsum(splits) - 1)[at] + right
        tree = np.repeat(tree[into], 2)
        path = (np.repeat(path[into] * 2, 2) + np.tile([0, 1], len(into))) % (1 << 40)
        n_nodes += len(tree)
    return {k: np.concatenate([v[k] for v in levels]).astype(np.int64) for k in levels[0]}


def _followed(nodes: dict[str, np.ndarray], b: np.ndarray, row: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The class that a tree votes for, for pairs of row and tree; a pair that has come to a leaf is let be."""
    node, live = tree.copy(), np.arange(len(row))
    while len(live):
        f = nodes["feature"][node[live]]
        live, f = live[f >= 0], f[f >= 0]
        now = node[live]
        node[live] = nodes["left"][now] + (b[row[live], f] > nodes["bin"][now])
    return nodes["vote"][node]


def votes(nodes: dict[str, np.ndarray], b: np.ndarray, trees: int) -> np.ndarray:
    """The class (row, tree) that each tree votes for."""
    row, tree = (v.ravel() for v in np.indices((len(b), trees)))
    return _followed(nodes, b, row, tree).reshape(len(b), trees)


def _tallied(v: np.ndarray, row: np.ndarray, rows: int, classes: int) -> np.ndarray:
    """Votes (row, class)."""
    return np.bincount(row * classes + v, minlength=rows * classes).reshape(rows, classes)


def packed_rows(rows: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """Rows (by, id, y, x array<double>) as blocks (by, block, ids, y, x)."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)[order]
        one = {k: table.column(k)[0].as_py() for k in (*by, "block")} | {"ids": ids[order].tolist(), "y": table.column("y").to_numpy().astype(np.int64)[order].tolist(), "x": x.tobytes()}
        kinds = [*[(k, pa.int32()) for k in (*by, "block")], ("ids", pa.list_(pa.int64())), ("y", pa.list_(pa.int64())), ("x", pa.binary())]
        return pa.Table.from_pylist([one], pa.schema(kinds))

    if by:
        rows = rows.join(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("slices")), by)
    else:
        rows = rows.withColumn("slices", F.lit(max(1, -(-rows.count() // block))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    kinds = "".join(f"{k} int, " for k in by) + "block int, ids array<long>, y array<long>, x binary"
    return kept(dealt.select(*by, "block", "id", "y", "x").groupBy(*by, "block").applyInArrow(pack, kinds), "rows")


def _joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.concatenate([np.array(r["ids"], np.int64) for r in rows])
    y = np.concatenate([np.array(r["y"], np.int64) for r in rows])
    x = np.concatenate([np.frombuffer(r["x"]).reshape(len(r["ids"]), -1) for r in rows])
    order = np.argsort(ids, kind="stable")
    return ids[order], y[order], x[order]


def _lots(classes: int, tried: int | None, leaf: int):
    """For applyInArrow over the training blocks of some lots of a forest: each lot's trees with thresholds, packed, and the out-of-bag votes of each row."""
    import pickle

    def run(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["lots"]).to_pylist()
        ids, y, x = _joined(rows)
        t = cuts(x)
        b, seed, out = binned(x, t), rows[0]["seed"], []
        for of in table.column("lots")[0].as_py():
            trees = list(range(of["lot"] * LOT, of["lot"] * LOT + of["trees"]))
            nodes = grown(b, y, ids, classes, seed, trees, tried or max(1, int(np.log2(x.shape[1]))), leaf)
            row, tree = np.nonzero(np.stack([bag(seed, k, ids) == 0 for k in trees], axis=1))
            tally = _tallied(_followed(nodes, b, row, tree), row, len(ids), classes)
            slim = {k: nodes[k].astype(c) for k, c in (("feature", np.int16 if x.shape[1] < 1 << 15 else np.int32), ("bin", np.uint8), ("left", np.int32), ("vote", np.int32))}
            out.append({"experiment": rows[0]["experiment"], "seed": seed, "lot": of["lot"], "trees": pickle.dumps((t, slim, len(trees))), "ids": ids, "y": y, "oob": tally.ravel()})
        kinds = [("experiment", pa.int32()), ("seed", pa.int32()), ("lot", pa.int32()), ("trees", pa.binary()), ("ids", pa.list_(pa.int64())), ("y", pa.list_(pa.int64())), ("oob", pa.list_(pa.int64()))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return run


SCORES = "experiment int, seed int, lot int, n long, correct long, hit array<long>, said array<long>, true array<long>"


def _counted(r: dict, lot: int, y: np.ndarray, said: np.ndarray, classes: int) -> dict:
    count = lambda v: np.bincount(v[(v >= 0) & (v < classes)], minlength=classes)
    same = y == said
    return {"experiment": r["experiment"], "seed": r["seed"], "lot": lot, "n": len(y), "correct": int(same.sum()), "hit": count(y[same]), "said": count(said), "true": count(y)}


def _scored(rows: list[dict]) -> pa.Table:
    ints = pa.list_(pa.int64())
    return pa.Table.from_pylist(rows, pa.schema([("experiment", pa.int32()), ("seed", pa.int32()), ("lot", pa.int32()), ("n", pa.int64()), ("correct", pa.int64()), ("hit", ints), ("said", ints), ("true", ints)]))


def _judged(classes: int):
    """For cogrouped lots of a forest and blocks of test rows: counts at the end of every lot, of votes that run over the lots."""
    import pickle

    def run(lots: pa.Table, blocks: pa.Table) -> pa.Table:
        parts, out = sorted(lots.to_pylist(), key=lambda r: r["lot"]), []
        made = [pickle.loads(r["trees"]) for r in parts]
        for block in blocks.to_pylist() if parts else []:
            y, x = np.array(block["y"], np.int64), np.frombuffer(block["x"]).reshape(len(block["ids"]), -1)
            tally, b, of = np.zeros((len(y), classes), np.int64), None, None
            for r, (t, nodes, n) in zip(parts, made):
                if of is None or not np.array_equal(t, of):  # a forest's lots have the same thresholds
                    b, of = binned(x, t), t
                row, tree = (v.ravel() for v in np.indices((len(b), n)))
                tally += _tallied(_followed(nodes, b, row, tree), row, len(b), classes)
                out.append(_counted(r, r["lot"], y, tally.argmax(axis=1), classes))
        return _scored(out)

    return run


def _out_of_bag(classes: int):
    """For applyInArrow over the lots of a forest: counts of running out-of-bag votes over the rows that have any."""

    def run(table: pa.Table) -> pa.Table:
        tally, out = 0, []
        lots = table.column("lot").to_numpy()
        for i in np.argsort(lots):
            y = table.column("y")[i].values.to_numpy()
            tally = tally + table.column("oob")[i].values.to_numpy().reshape(-1, classes)
            there = tally.max(axis=1) > 0
            r = {k: table.column(k)[0].as_py() for k in ("experiment", "seed")}
            out.append(_counted(r, int(lots[i]), y[there], tally.argmax(axis=1)[there], classes))
        return _scored(out)

    return run


def grow(spark: SparkSession, train: DataFrame, seeds: list[int], trees: int, classes: int, tried: int | None = None, leaf: int = 2, most: int | None = None) -> DataFrame:
    """Rows (experiment, seed, lot, trees, ids, y, oob): the lots of a forest for each experiment and seed, from rows (experiment, id, y, x).

    Every set goes whole through a task, so this is for sets of up to ``HELD`` values; ``scores`` sends larger ones to ``wide``.
    A caller may ask for ``most`` rows of least id hash; without it all rows are used.
    """
    rows = train.select(F.col("experiment").cast("int").alias("experiment"), "id", "y", "x")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("experiment").orderBy(F.xxhash64("id"), "id"))
        rows = rows.withColumn("rn", rank).filter(F.col("rn") <= most).drop("rn")
    blocks = packed_rows(rows, ["experiment"])
    lots = [(s, n, min(LOT, trees - n * LOT)) for s in seeds for n in range(-(-trees // LOT))]
    shares = {}  # lots that share one copy of the training rows
    for s, n, t in lots:
        shares.setdefault((s, n // SHARE), []).append(F.struct(F.lit(n).alias("lot"), F.lit(t).alias("trees")))
    todo = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(n).alias("share"), F.array(*of).alias("lots")) for (s, n), of in shares.items()])
    each = blocks.withColumn("of", F.explode(todo)).select("experiment", "of.*", "block", "ids", "y", "x").repartition(len(shares), "experiment", "seed", "share")
    kinds = "experiment int, seed int, lot int, trees binary, ids array<long>, y array<long>, oob array<long>"
    return kept(each.groupBy("experiment", "seed", "share").applyInArrow(_lots(classes, tried, leaf), kinds), "forest")


def growth(spark: SparkSession, forest: DataFrame, test: DataFrame, classes: int, trees: int) -> DataFrame:
    """Rows (experiment, seed, n_estimators, oob_score, test_accuracy, test_macro_f1, test_weighted_f1, f1): scores at the end of every lot.

    ``test`` has rows (id, y, x), judged by every forest.
    """
    blocks = packed_rows(test.select("id", "y", "x"), []).withColumn("slice", F.floor(F.col("block") / SLICE).cast("int"))
    last = blocks.agg(F.max("slice")).first()[0] or 0
    keys = ["experiment", "seed", "lot"]
    sent = forest.select(*keys, "trees", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("slice"))
    every = forest.select(F.col("experiment").alias("e"), F.col("seed").alias("s")).distinct()
    met = blocks.crossJoin(F.broadcast(every)).select(F.col("e").alias("experiment"), F.col("s").alias("seed"), F.col("slice").alias("slice"), "ids", "y", "x")
    of = ["experiment", "seed", "slice"]
    seen = sent.groupBy(*of).cogroup(met.groupBy(*of)).applyInArrow(_judged(classes), SCORES)
    oob = forest.select(*keys, "y", "oob").groupBy("experiment", "seed").applyInArrow(_out_of_bag(classes), SCORES)
    return _curve(seen, oob, classes, trees)


def _curve(seen: DataFrame, oob: DataFrame, classes: int, trees: int) -> DataFrame:
    keys = ["experiment", "seed", "lot"]
    scored = oob.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("correct").alias("correct")).filter("n > 0").select(*keys, (F.col("correct") / F.col("n")).alias("oob_score"))
    counts = [F.sum(F.col(k)[c]).alias(f"{k}{c}") for c in range(classes) for k in ("hit", "said", "true")]
    table = seen.groupBy(*keys).agg((F.sum("correct") / F.sum("n")).alias("test_accuracy"), F.sum("n").alias("n"), *counts)
    f1 = [F.when(F.col(f"said{c}") + F.col(f"true{c}") > 0, 2 * F.col(f"hit{c}") / (F.col(f"said{c}") + F.col(f"true{c}"))).otherwise(0.0) for c in range(classes)]
    there = [((F.col(f"said{c}") + F.col(f"true{c}")) > 0).cast("int") for c in range(classes)]
    total = lambda x: sum(x[1:], x[0])
    out = table.select(*keys, "test_accuracy", (total(f1) / total(there)).alias("test_macro_f1"), (total([f * F.col(f"true{c}") for c, f in enumerate(f1)]) / F.col("n")).alias("test_weighted_f1"), F.array(*f1).alias("f1"))
    size = F.least((F.col("lot") + 1) * LOT, F.lit(trees)).alias("n_estimators")
    return out.join(scored, keys, "left").select("experiment", "seed", size, "oob_score", "test_accuracy", "test_macro_f1", "test_weighted_f1", "f1")


def scores(spark: SparkSession, train: DataFrame, test: DataFrame, seeds: list[int], trees: int, classes: int, tried: int | None = None, leaf: int = 2, held: int | None = None) -> DataFrame:
    """Rows as of ``growth``, of forests on all rows of each training set, whatever its size; ``held`` is for ``HELD``."""
    held = HELD if held is None else held
    train = kept(train.select(F.col("experiment").cast("int").alias("experiment"), "id", "y", "x"), "sets")
    sizes = {r["experiment"]: (r["n"], r["f"]) for r in train.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("f")).collect()}  # a row a training set
    large = {e: n for e, (n, f) in sizes.items() if n * f > held}
    parts = []
    if len(large) < len(sizes) or not sizes:
        small = train.filter(~F.col("experiment").isin(list(large)))
        parts.append(growth(spark, grow(spark, small, seeds, trees, classes, tried, leaf), test, classes, trees))
    if large:
        features = max(sizes[e][1] for e in large)
        rows = train.filter(F.col("experiment").isin(list(large)))
        parts.append(wide(spark, rows, test, large, features, seeds, trees, classes, tried or max(1, int(np.log2(features))), leaf, max(1, held // features)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def quantiles(train: DataFrame, sizes: dict[int, int], bins: int = BINS) -> dict[int, np.ndarray]:
    """The thresholds that ``cuts`` gives for all rows of each set, from the values at the places that they lie between."""
    share = np.linspace(0, 1, bins + 1)[1:-1]
    places = {e: (n - 1) * share for e, n in sizes.items()}
    values = train.select("experiment", F.posexplode("x").alias("f", "v"))
    placed = ordinals(values, ["v"], "place", ["experiment", "f"])
    wanted = {e: sorted({int(i) for v in at for i in (v, min(v + 1, sizes[e] - 1))}) for e, at in places.items()}
    taken = F.lit(False)
    for e, at in wanted.items():
        taken = taken | ((F.col("experiment") == e) & F.col("place").isin(at))
    found = {(r["experiment"], r["f"], r["place"]): r["v"] for r in placed.filter(taken).collect()}  # two rows a threshold
    out = {}
    for e, at in places.items():
        features = 1 + max(f for of, f, _ in found if of == e)
        low, part = np.floor(at).astype(int), at - np.floor(at)
        a = np.array([[found[e, f, int(i)] for i in low] for f in range(features)])
        b = np.array([[found[e, f, int(min(i + 1, sizes[e] - 1))] for i in low] for f in range(features)])
        out[e] = np.where(part >= 0.5, b - (b - a) * (1 - part), a + (b - a) * part)
    return out


def _binned_blocks(thresholds: dict[int, np.ndarray]):
    """For mapInArrow over packed rows: bins in place of values; blocks without a set (test rows) once for each set."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"]).reshape(len(r["ids"]), -1)
                for e in [r["experiment"]] if r["experiment"] is not None else thresholds:
                    one = {"experiment": e, "kind": int(r["experiment"] is None), "block": r["block"], "ids": r["ids"], "y": r["y"], "b": binned(x, thresholds[e]).tobytes()}
                    yield _batch([one], BINNED)

    return run


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
BINNED = "experiment int, kind int, block int, ids array<long>, y array<long>, b binary"
HISTS = "experiment int, tree int, path long, hist binary"
SPLITS = "experiment int, tree int, path long, feature int, bin int, vote int, n_left long, n_right long"
DRAWN = "experiment int, tree int, path long, y binary, w binary, b binary"
ASKED = "experiment int, tree int, path long, slice int, kind int, block int, at binary, b binary"
SUBTREES = "experiment int, tree int, path long, nodes binary"
VOTES = "experiment int, tree int, kind int, block int, at binary, vote binary"
TALLIES = "experiment int, seed int, lot int, kind int, block int, y array<long>, tally binary"


def _schema(kinds: str) -> pa.Schema:
    return pa.schema([(k, KINDS[t]) for k, t in (c.split() for c in kinds.split(", "))])


def _batch(rows: list[dict], kinds: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _schema(kinds))


def _table(rows: list[dict], kinds: str) -> pa.Table:
    return pa.Table.from_pylist(rows, _schema(kinds))


def _paths(top: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    """The node of a tree's upper part (nodes in order, features, bins) that each row ends in."""
    nodes, feature, cut = top
    path, live = np.ones(len(b), np.int64), np.arange(len(b))
    while len(live):
        i = np.searchsorted(nodes, path[live])
        f = feature[i]
        live, i, f = live[f >= 0], i[f >= 0], f[f >= 0]
        path[live] = 2 * path[live] + (b[live, f] > cut[i])
    return path


OPEN, BELOW = -2, -3  # features of nodes that are yet to be split by histograms, and of nodes that grow on in one task


def _blocks(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield r, np.array(r["ids"], np.int64), np.array(r["y"], np.int64), np.frombuffer(r["b"], np.uint8).reshape(len(r["ids"]), -1)


def _histograms(tops: dict, seed: int, classes: int, tried: int):
    """For mapInArrow over training blocks: drawn rows by feature tried, class and bin, for each open node."""

    def run(batches):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        sent = lambda: _batch([{"experiment": e, "tree": t, "path": p, "hist": h.tobytes()} for (e, t, p), h in sums.items()], HISTS)
        for r, ids, y, b in _blocks(batches):
            for (e, tree), top in tops.items():
                if e != r["experiment"] or not (top[1] == OPEN).any():
                    continue
                w = bag(seed, tree, ids)
                path = np.where(w > 0, _paths(top, b), 0)
                for p in top[0][top[1] == OPEN].tolist():
                    if len(at := np.flatnonzero(path == p)):
                        tries = candidates(seed, np.array([tree]), np.array([p]), b.shape[1], tried)[0]
                        hist = np.stack([np.bincount(y[at] * BINS + b[at, f], w[at], classes * BINS) for f in tries])
                        sums[e, tree, p] = sums.get((e, tree, p), 0) + hist
            if len(sums) > 1024:
                yield sent()
                sums.clear()
        yield sent()

    return run


def _decided(seed: int, classes: int, tried: int, features: int, leaf: int, last: bool):
    """For applyInArrow over the histograms of a node: its split as ``grown`` finds it, or -1 for a leaf."""

    def run(table: pa.Table) -> pa.Table:
        e, tree, path = (table.column(k)[0].as_py() for k in ("experiment", "tree", "path"))
        hist = sum(np.frombuffer(h.as_py()) for h in table.column("hist")).reshape(-1, classes, BINS)
        total = hist[0].sum(axis=1)
        size, best, of, by, left = total.sum(), 1e-12, -1, 0, 0
        if not last and (total > 0).sum() > 1 and size >= 2 * leaf:
            parent = size - (total**2).sum() / max(size, 1)
            for f, h in zip(candidates(seed, np.array([tree]), np.array([path]), features, tried)[0], hist):
                low = h.cumsum(axis=1)
                gain = _gains(low, np.broadcast_to(total[:, None], low.shape), parent, leaf)
                if gain[j := int(gain.argmax())] > best + 1e-9:
                    best, of, by, left = gain[j], int(f), j, int(low[:, j].sum())
        return _table([{"experiment": e, "tree": tree, "path": path, "feature": of, "bin": by, "vote": int(total.argmax()), "n_left": left, "n_right": int(size) - left}], SPLITS)

    return run


def _tops(blocks: DataFrame, sets: list[int], seed: int, numbers: list[int], features: int, classes: int, tried: int, leaf: int, held: int) -> tuple[dict, list[tuple]]:
    """The upper part of each tree down to nodes of at most ``held`` draws, and its leaves (experiment, tree, path, vote).

    A tree has some 2 n / ``held`` such nodes; only these, a row each, are on the driver.
    """
    nodes = {(e, t): {1: (OPEN, 0)} for e in sets for t in numbers}
    leaves = []
    for level in range(DEPTH + 1):
        tops = _arrays(nodes)
        if not any((t[1] == OPEN).any() for t in tops.values()):
            break
        sent = blocks.filter("kind = 0").mapInArrow(_histograms(tops, seed, classes, tried), HISTS)
        for r in sent.groupBy("experiment", "tree", "path").applyInArrow(_decided(seed, classes, tried, features, leaf, level == DEPTH), SPLITS).collect():
            of = nodes[r["experiment"], r["tree"]]
            of[r["path"]] = (r["feature"], r["bin"])
            if r["feature"] < 0:
                leaves.append((r["experiment"], r["tree"], r["path"], r["vote"]))
                continue
            for side, n in enumerate((r["n_left"], r["n_right"])):
                of[2 * r["path"] + side] = (OPEN if n > held else BELOW, 0)
    return _arrays(nodes), leaves


def _arrays(nodes: dict) -> dict:
    out = {}
    for key, of in nodes.items():
        paths = sorted(of)
        out[key] = (np.array(paths, np.int64), np.array([of[p][0] for p in paths]), np.array([of[p][1] for p in paths]))
    return out


def _dealt(tops: dict, seed: int, asked: bool):
    """For mapInArrow over blocks: rows by tree and node, those drawn or those that ask for a vote (test rows, and rows that a tree has not drawn)."""

    def run(batches):
        for r, ids, y, b in _blocks(batches):
            for (e, tree), top in tops.items():
                if e != r["experiment"]:
                    continue
                w = bag(seed, tree, ids) if r["kind"] == 0 else np.zeros(len(ids), np.int64)
                path, out = _paths(top, b), []
                mine = (w == 0) if asked else (w > 0) & (top[1][np.searchsorted(top[0], path)] == BELOW)
                for p in np.unique(path[mine]).tolist():
                    at = np.flatnonzero(mine & (path == p)).astype(np.int32)
                    own = {"experiment": e, "tree": tree, "path": p, "b": b[at].tobytes()}
                    out.append(own | ({"slice": r["block"] // SLICE, "kind": r["kind"], "block": r["block"], "at": at.tobytes()} if asked else {"y": y[at].astype(np.int32).tobytes(), "w": w[at].astype(np.uint8).tobytes()}))
                if out:
                    yield _batch(out, ASKED if asked else DRAWN)

    return run


def _subtree(seed: int, classes: int, tried: int, leaf: int, features: int):
    """For applyInArrow over the drawn rows of a node: the nodes below it."""
    import pickle

    def run(table: pa.Table) -> pa.Table:
        e, tree, path = (table.column(k)[0].as_py() for k in ("experiment", "tree", "path"))
        y, w, b = (np.concatenate([np.frombuffer(v.as_py(), t) for v in table.column(c)]) for c, t in (("y", np.int32), ("w", np.uint8), ("b", np.uint8)))
        nodes = _grown_on(b.reshape(len(y), features), y.astype(np.int64), w.astype(np.int64)[None, :], classes, seed, [tree], tried, leaf, top=path)
        slim = {k: nodes[k].astype(c) for k, c in (("feature", np.int32), ("bin", np.uint8), ("left", np.int32), ("vote", np.int32))}
        return _table([{"experiment": e, "tree": tree, "path": path, "nodes": pickle.dumps(slim)}], SUBTREES)

    return run


def _voted(features: int):
    """For cogrouped nodes and the rows that ask there: their votes."""
    import pickle

    def run(made: pa.Table, asked: pa.Table) -> pa.Table:
        nodes, out = pickle.loads(made.column("nodes")[0].as_py()) if len(made) and len(asked) else None, []
        for r in asked.to_pylist():
            b = np.frombuffer(r["b"], np.uint8).reshape(-1, features)
            vote = _followed(nodes, b, np.arange(len(b)), np.zeros(len(b), np.int64))
            out.append({k: r[k] for k in ("experiment", "tree", "kind", "block", "at")} | {"vote": vote.astype(np.int32).tobytes()})
        return _table(out, VOTES)

    return run


def _by_lot(seed: int, classes: int):
    """For cogrouped votes and their block: votes (row, class) of each lot; a lot has at most 255 trees."""

    def run(votes: pa.Table, block: pa.Table) -> pa.Table:
        own, sums = block.to_pylist()[0], {}
        for r in votes.to_pylist():
            tally = sums.setdefault(r["tree"] // LOT, np.zeros((len(own["y"]), classes), np.uint8))
            tally[np.frombuffer(r["at"], np.int32), np.frombuffer(r["vote"], np.int32)] += 1
        keys = {k: own[k] for k in ("experiment", "kind", "block", "y")}
        return _table([keys | {"seed": seed, "lot": n, "tally": t.tobytes()} for n, t in sums.items()], TALLIES)

    return run


def _running(classes: int, lots: int):
    """For applyInArrow over the lots of a block: counts at the end of every lot, over the rows that have votes."""

    def run(table: pa.Table) -> pa.Table:
        rows = {r["lot"]: r for r in table.to_pylist()}
        first = next(iter(rows.values()))
        y, tally, out = np.array(first["y"], np.int64), np.zeros((len(first["y"]), classes), np.int64), []
        for lot in range(lots):
            if lot in rows:
                tally = tally + np.frombuffer(rows[lot]["tally"], np.uint8).reshape(-1, classes)
            there = tally.max(axis=1) > 0
            out.append({"kind": first["kind"]} | _counted(first, lot, y[there], tally.argmax(axis=1)[there], classes))
        return pa.Table.from_arrays([pa.array([first["kind"]] * lots, pa.int32()), *_scored(out).columns], ["kind", *_scored(out).column_names])

    return run


def wide(spark: SparkSession, train: DataFrame, test: DataFrame, sizes: dict[int, int], features: int, seeds: list[int], trees: int, classes: int, tried: int, leaf: int, held: int) -> DataFrame:
    """Rows as of ``growth`` for training sets (experiment: rows) that no task holds; ``held`` are the draws of a node that one does."""
    thresholds = quantiles(train, sizes)
    packed = packed_rows(train, ["experiment"]).unionByName(packed_rows(test.select("id", "y", "x"), []).withColumn("experiment", F.lit(None).cast("int")))
    blocks = kept(packed.mapInArrow(_binned_blocks(thresholds), BINNED), "binned")
    last = blocks.agg(F.max("block")).first()[0] // SLICE
    lots, counts = -(-trees // LOT), []
    several = max(1, ROUND // (LOT * sum(sizes.values())))  # lots of a round, which bounds what rounds write
    for seed in seeds:
        tallies = []
        for lot in range(0, lots, several):
            numbers = list(range(lot * LOT, min(trees, (lot + several) * LOT)))
            tops, leaves = _tops(blocks, list(sizes), seed, numbers, features, classes, tried, leaf, held)
            drawn = blocks.filter("kind = 0").mapInArrow(_dealt(tops, seed, False), DRAWN)
            made = drawn.groupBy("experiment", "tree", "path").applyInArrow(_subtree(seed, classes, tried, leaf, features), SUBTREES)
            made = kept(made.unionByName(_leaf_nodes(spark, leaves)), "subtrees")
            asked = blocks.mapInArrow(_dealt(tops, seed, True), ASKED)
            of = ["experiment", "tree", "path", "slice"]
            copies = made.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(last))))
            votes = copies.groupBy(*of).cogroup(asked.groupBy(*of)).applyInArrow(_voted(features), VOTES)
            of = ["experiment", "kind", "block"]
            tallies.append(kept(votes.groupBy(*of).cogroup(blocks.groupBy(*of)).applyInArrow(_by_lot(seed, classes), TALLIES), "tallies"))
        every = tallies[0]
        for t in tallies[1:]:
            every = every.unionByName(t)
        counts.append(kept(every.groupBy("experiment", "seed", "kind", "block").applyInArrow(_running(classes, lots), f"kind int, {SCORES}"), "counts"))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return _curve(every.filter("kind = 1"), every.filter("kind = 0"), classes, trees)


def _leaf_nodes(spark: SparkSession, leaves: list[tuple]) -> DataFrame:
    import pickle

    one = lambda vote: {"feature": np.array([-1], np.int32), "bin": np.zeros(1, np.uint8), "left": np.zeros(1, np.int32), "vote": np.array([vote], np.int32)}
    return spark.createDataFrame([(e, t, p, bytearray(pickle.dumps(one(v)))) for e, t, p, v in leaves], SUBTREES)
