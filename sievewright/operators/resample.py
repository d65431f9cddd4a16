"""Paired case-level resampling of all metrics of all comparisons.

Predictions collapse to one row a case with its truth and what every run said, and these to blocks of
cases. A task owns a range of the iterations of one (comparison, metric) and reads the blocks
one after another: for each it makes a matrix of weights (how often an iteration draws a case, or
whether it swaps it) and multiplies it with the per-case counts that the metric needs. So a metric of thousands
of iterations is a few matrix products, and memory is one block and the range's sums.

The bootstrap draws as many cases as there are, with replacement: how many fall to each block is one multinomial draw
that every task repeats alike, and within a block draw k of iteration i takes place
``hash(seed, i, k) mod size``. With one block that is plain drawing by place, which SQL repeats. Swaps are bits of
``hash(seed, i, case)``. Differences are compared after rounding to nine digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MIX, WORD
from ..shared import kept, ordinals

#: Cases of a block, iterations of a task.
CASES, RANGE = 16_384, 500
PLACED = "block int, cases array<long>, data binary"


def mixed(seed: int, *ids: np.ndarray) -> np.ndarray:
    """``mix32`` for arrays."""
    x = np.int64(seed & WORD)
    for i in ids:
        for word in (i & WORD, (i >> 32) & WORD, 0):
            x = x ^ word
            x = ((x ^ (x >> 16)) * MIX) & WORD
    return ((x ^ (x >> 16)) * MIX) & WORD


def metrics(labels: int, names: list[str] | None = None) -> list[str]:
    """Accuracy, both averages of F1, and F1 of each label."""
    return ["accuracy", "macro_f1", "weighted_f1", *[f"f1[{n}]" for n in names or range(labels)]]


def case_blocks(predictions: DataFrame, runs: list[tuple[int, int]], cases: int = CASES) -> DataFrame:
    """Blocks of cases in order of case_id: per case its truth and the prediction of each (condition, seed) in ``runs``.

    A case whose truths differ, or that a run lacks or has twice, is an error: the pairing would not hold.
    """
    run = F.struct("condition", "seed", "y_pred")
    by_case = predictions.groupBy("case_id").agg(F.min("y_true").alias("t"), F.max("y_true").alias("u"), F.sort_array(F.collect_list(run)).alias("r"))
    expected = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(s).alias("seed")) for c, s in runs])
    found = F.transform("r", lambda x: F.struct(x["condition"].cast("int").alias("condition"), x["seed"].cast("int").alias("seed")))
    same = (F.col("t") == F.col("u")) & (found == expected)
    checked = by_case.filter(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("runs are not paired at case "), F.col("case_id").cast("string"))).cast("boolean")))
    values = F.concat(F.array(F.col("t").cast("int")), F.transform("r", lambda x: x["y_pred"].cast("int")))
    return placed_blocks(checked.select("case_id", values.alias("v")), cases)


def placed_blocks(rows: DataFrame, cases: int = CASES) -> DataFrame:
    """Rows (case_id, v array<int>) as blocks of consecutive places, in order of case_id."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("case_id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(ids), -1)
        one = {"block": table.column("block")[0].as_py(), "cases": ids[order].tolist(), "data": v[order].tobytes()}
        return pa.Table.from_pylist([one], pa.schema([("block", pa.int32()), ("cases", pa.list_(pa.int64())), ("data", pa.binary())]))

    placed = ordinals(rows.select(F.col("case_id").cast("long").alias("case_id"), "v"), ["case_id"], "place")
    return kept(placed.withColumn("block", F.floor(F.col("place") / cases).cast("int")).groupBy("block").applyInArrow(pack, PLACED), "cases")


def _f1(hit: np.ndarray, said: np.ndarray, true: np.ndarray) -> np.ndarray:
    """2TP / (predicted + true), 0 where there is neither."""
    both = said + true
    return np.where(both > 0, 2 * hit / np.maximum(both, 1), 0.0)


class Measure:
    """The counts of one metric: columns of each case for both conditions, and the mean difference over seeds from their sums."""

    def __init__(self, metric: int, labels: int, seeds: int):
        self.kind = ("accuracy", "macro", "weighted")[metric] if metric < 3 else "label"
        self.of = [metric - 3] if metric >= 3 else list(range(labels))
        self.seeds = seeds

    def columns(self, truth: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns of condition a, of b, and those that both share."""
        if self.kind == "accuracy":
            return (a == truth[:, None]).sum(axis=1, keepdims=True), (b == truth[:, None]).sum(axis=1, keepdims=True), np.ones((len(truth), 1))
        shared = np.stack([truth == c for c in self.of], axis=1)
        side = lambda p: np.concatenate([f for c in self.of for f in ((p == c) & (truth == c)[:, None], p == c)], axis=1)
        return side(a), side(b), shared

    def value(self, sums: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The metric, averaged over seeds, for each row of sums."""
        if self.kind == "accuracy":
            return sums[:, 0] / np.maximum(shared[:, 0], 1) / self.seeds
        parts = sums.reshape(len(sums), len(self.of), 2, self.seeds)
        f1 = _f1(parts[:, :, 0], parts[:, :, 1], shared[:, :, None])
        if self.kind == "weighted":
            return ((f1 * shared[:, :, None]).sum(axis=1) / np.maximum(shared.sum(axis=1), 1)[:, None]).mean(axis=1)
        return f1.mean(axis=(1, 2))


def block_draws(seed: int, iterations: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How many of an iteration's draws fall to each block."""
    if len(sizes) == 1:
        return np.full((len(iterations), 1), sizes[0])
    share = np.array(sizes) / sum(sizes)
    return np.stack([np.random.default_rng([seed, int(i)]).multinomial(sum(sizes), share) for i in iterations])


def drawn(seed: int, iterations: np.ndarray, counts: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Weights (iteration, case) of a block: draws ``first`` and on of each iteration, ``counts`` of them."""
    w = np.zeros((len(iterations), size), np.float64)
    for row, (i, n, f) in enumerate(zip(iterations, counts, first)):
        places = mixed(seed, np.int64(i), f + np.arange(n, dtype=np.int64)) % size
        w[row] = np.bincount(places, minlength=size)
    return w


def swapped(seed: int, iterations: np.ndarray, cases: np.ndarray) -> np.ndarray:
    """1 where an iteration swaps a case."""
    return (mixed(seed, iterations[:, None].astype(np.int64), cases[None, :]) % 2).astype(np.float64)


def _resampled(sizes: list[int], labels: int, seeds: int, where: dict[int, int]):
    """For mapInArrow over a task's blocks, in order: (comparison, metric, it, boot, perm), and it -1 with the plain values of both conditions."""

    def finish(task: dict, m: Measure, sums: list[np.ndarray]) -> pa.RecordBatch:
        boot_a, boot_b, boot_s, perm_a, perm_b, all_a, all_b, all_s = sums
        boot = m.value(boot_a, boot_s) - m.value(boot_b, boot_s)
        whole = np.repeat(all_s[None], len(perm_a), axis=0)
        perm = m.value(perm_a, whole) - m.value(perm_b, whole)
        its = np.arange(task["low"], task["high"])
        plain = [m.value(x[None], all_s[None])[0] for x in (all_a, all_b)]
        rows = ([task["comparison"]] * (len(its) + 1), [task["metric"]] * (len(its) + 1), [*its, -1], [*boot, plain[0]], [*perm, plain[1]])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))], ["comparison", "metric", "it", "boot", "perm"])

    def run(batches: Iterator[pa.RecordBatch]):
        now, m, sums, draws = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                task = row["task"]
                if task != now:
                    if now is not None:
                        yield finish(now, m, sums)
                    now, m, sums = task, Measure(task["metric"], labels, seeds), None
                    draws = block_draws(task["seed"], np.arange(task["low"], task["high"]), sizes)
                its, b = np.arange(task["low"], task["high"]), row["block"]
                cases = np.array(row["cases"], np.int64)
                data = np.frombuffer(row["data"], np.int32).reshape(len(cases), -1)
                a_at, b_at = 1 + where[task["comparison"]] * seeds, 1
                a, base, shared = (x.astype(np.float64) for x in m.columns(data[:, 0], data[:, a_at : a_at + seeds], data[:, b_at : b_at + seeds]))
                w = drawn(task["seed"], its, draws[:, b], draws[:, :b].sum(axis=1), len(cases))
                s = swapped(task["seed"], its, cases)
                moved = s @ (base - a)
                part = [w @ a, w @ base, w @ shared, a.sum(axis=0) + moved, base.sum(axis=0) - moved, a.sum(axis=0), base.sum(axis=0), shared.sum(axis=0)]
                sums = part if sums is None else [x + y for x, y in zip(sums, part)]
        if now is not None:
            yield finish(now, m, sums)

    return run


#: Factors of a task's seed.
BY_COMPARISON, BY_METRIC = 1_000_003, 10_007


def tasks(spark: SparkSession, comparisons: list[int], count: int, base_seed: int, iterations: int) -> DataFrame:
    """One row for each (comparison, metric): index of both, seed, iterations; the seeds of the published study."""
    rows = [(i, m, base_seed + BY_COMPARISON * n + BY_METRIC * (m + 1), iterations) for n, i in enumerate(comparisons) for m in range(count)]
    return spark.createDataFrame(rows, "comparison int, metric int, seed long, iterations int")


def resampled(predictions: DataFrame, todo: DataFrame, conditions: list[int], seeds: list[int], labels: int, cases: int = CASES, span: int = RANGE) -> DataFrame:
    """Rows (comparison, metric, it, boot, perm) of every task in ``todo``; the first of ``conditions`` is the baseline.

    ``it`` -1 holds the metric of the condition (boot) and of the baseline (perm) on the cases as they are.
    """
    blocks = case_blocks(predictions, [(c, s) for c in sorted(conditions) for s in sorted(seeds)], cases)
    sizes = [r["n"] for r in blocks.select("block", F.size("cases").alias("n")).orderBy("block").collect()]  # one number a block
    ranges = F.explode(F.sequence(F.lit(0), F.col("iterations") - 1, F.lit(span))).alias("low")
    each = todo.select("comparison", "metric", "seed", ranges, "iterations").withColumn("high", F.least(F.col("low") + span, F.col("iterations")))
    each = each.select(F.struct("comparison", "metric", "seed", "low", "high").alias("task"), F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("block")) if sizes else each.select(F.struct("comparison", "metric", "seed", "low", "high").alias("task"), F.lit(0).alias("block")).limit(0)
    sent = each.join(blocks, "block").repartition("task").sortWithinPartitions("task", "block").select("task", "block", "cases", "data")
    where = {c: i for i, c in enumerate(sorted(conditions))}
    return sent.mapInArrow(_resampled(sizes, labels, len(seeds), where), "comparison int, metric int, it long, boot double, perm double")


def summary(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """Rows (comparison, metric, mean_a, mean_b, delta, ci_low, ci_high, p_raw, p_holm): percentile interval, two-sided p, Holm over all rows."""
    from .stats import holm

    seen = draws.filter("it < 0").groupBy("comparison", "metric").agg(F.first("boot").alias("mean_a"), F.first("perm").alias("mean_b"))
    seen = seen.withColumn("delta", F.col("mean_a") - F.col("mean_b"))
    low = (1 - level) / 2
    rows = draws.filter("it >= 0").join(seen, ["comparison", "metric"])
    far = (F.round(F.abs("perm"), 9) >= F.round(F.abs("delta"), 9)).cast("int")
    out = rows.groupBy("comparison", "metric").agg(
        F.first("mean_a").alias("mean_a"), F.first("mean_b").alias("mean_b"), F.first("delta").alias("delta"),
        F.percentile("boot", F.lit(low)).alias("ci_low"), F.percentile("boot", F.lit(1 - low)).alias("ci_high"), ((F.sum(far) + 1) / (F.count(F.lit(1)) + 1)).alias("p_raw"),
    )
    return holm(out, "p_raw")


def _ranges(sizes: list[int], seed: int, swap: bool):
    """For mapInArrow over (low, high, block, cases, data) with data (diff, n): for each iteration the mean of drawn cases, or the sum with swapped signs."""

    def made(sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums[:, 0] if swap else sums[:, 0] / sums[:, 1])], ["m"])

    def run(batches: Iterator[pa.RecordBatch]):
        now, sums, draws = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                its = np.arange(r["low"], r["high"])
                if r["low"] != now:
                    if now is not None:
                        yield made(sums)
                    now, sums, draws = r["low"], np.zeros((len(its), 2)), block_draws(seed, its, sizes)
                cases = np.array(r["cases"], np.int64)
                data = np.frombuffer(r["data"], np.int32).reshape(len(cases), 2).astype(float)
                b = r["block"]
                w = 1 - 2 * swapped(seed, its, cases) if swap else drawn(seed, its, draws[:, b], draws[:, :b].sum(axis=1), len(data))
                sums = sums + w @ data
        if now is not None:
            yield made(sums)

    return run


def _by_range(cases: DataFrame, count: int, seed: int, swap: bool, size: int, span: int) -> DataFrame:
    blocks = placed_blocks(cases.select("case_id", F.array(F.col("diff").cast("int"), F.col("n").cast("int")).alias("v")), size)
    sizes = [r["n"] for r in blocks.select("block", F.size("cases").alias("n")).orderBy("block").collect()]  # one number a block
    spans = cases.sparkSession.range(0, count, span).select(F.col("id").alias("low"), F.least(F.col("id") + span, F.lit(count)).alias("high"))
    each = spans.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(max(len(sizes), 1) - 1))).alias("block"))
    sent = each.join(blocks, "block").repartition("low").sortWithinPartitions("low", "block").select("low", "high", "block", "cases", "data")
    return sent.mapInArrow(_ranges(sizes, seed, swap), "m double")


def bootstrap_means(cases: DataFrame, count: int, seed: int, size: int = CASES, span: int = RANGE) -> DataFrame:
    """Column m: the mean difference of each of ``count`` bootstrap draws of cases (case_id, diff, n)."""
    return _by_range(cases, count, seed, False, size, span)


def swapped_sums(cases: DataFrame, count: int, seed: int, size: int = CASES, span: int = RANGE) -> DataFrame:
    """Column m: the sum of differences with the signs of each of ``count`` permutations of cases (case_id, diff, n)."""
    return _by_range(cases, count, seed, True, size, span)
