"""Outlier gate and diversity selection within groups, and distances between feature sets.

Groups are combinations of a few classes, so their number is small; their size is not. Moments are
summed per Arrow batch and merged, distances are a map over rows, percentiles come from ranks of ranges
and the sequential rules from rounds, so no task holds a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept, ordinals
from .neighbours import block_pairs, blocks, centres, close_pairs, compared, earlier, inside


@dataclass
class Geometry:
    """PCA axes of a group's real rows and the scale of each, by which m² is a squared length."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    scale: np.ndarray | None = None

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates whose squared length is m²; plain ones where the spread is not positive."""
        z = self.coordinates(x)
        return z / np.sqrt(self.scale) if (self.scale > 0).all() else z

    def shrink(self, fourth: float) -> None:
        """Ledoit-Wolf shrinkage in the axes' space, where the covariance is diagonal; ``fourth`` is the mean of |z|⁴."""
        d, mu = len(self.values), self.values.mean()
        delta = ((self.values - mu) ** 2).sum() / d
        beta = max(0.0, (fourth - (self.values**2).sum()) / d / self.n)
        share = 0.0 if delta == 0 else min(beta, delta) / delta
        self.scale = (1 - share) * self.values + share * mu + 1e-12


def geometry(n: int, sums: list[float], components: int = 200) -> Geometry:
    """From the count, sums and sums of products of the real rows."""
    d = int((np.sqrt(1 + 4 * len(sums)) - 1) / 2)
    mean = np.array(sums[:d]) / n
    cov = np.array(sums[d:]).reshape(d, d) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    k = max(1, min(n - 1, components, d))
    return Geometry(n, mean, vectors[:, ::-1][:, :k], np.maximum(values[::-1][:k], 0))


def geometries(real: DataFrame, components: int = 200) -> dict[int, Geometry]:
    """The geometry of each group of rows (combo, vector) of which it has two or more; two passes of sums, no task holds a group."""
    models = {r["combo"]: geometry(r["n"], r["sums"], components) for r in moments(real, "vector", ["combo"]).collect() if r["n"] > 1}  # one row a group

    def fourths(batches):
        total: dict[int, float] = {}
        for batch in batches:
            combo = batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(combo):
                if int(c) in models:
                    z = models[int(c)].coordinates(_vectors(batch.column(1).filter(pa.array(combo == c))))
                    total[int(c)] = total.get(int(c), 0.0) + float(((z**2).sum(axis=1) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], ["combo", "s"])

    sums = real.select(F.col("combo").cast("int").alias("combo"), "vector").mapInArrow(fourths, "combo int, s double").groupBy("combo").agg(F.sum("s").alias("s"))
    for r in sums.collect():
        models[r["combo"]].shrink(r["s"] / models[r["combo"]].n)
    return models


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def packed(vector):
    """A column of vectors as packed float64."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, float).tobytes())

    return pack(vector)


MEASURED = "combo int, id long, is_real boolean, m2 double, x binary"


def measured(df: DataFrame, models: dict[int, Geometry], *more: str) -> DataFrame:
    """Rows (combo, id, is_real, m2, x): squared Mahalanobis distance and whitened vector; 0 and the vector itself without a geometry.

    Columns ``more`` of the input go along. Rows are mapped one by one, so ``df`` may be a stream.
    """

    def run(batches):
        for batch in batches:
            combo = batch.column(0).to_numpy(zero_copy_only=False)
            m2, x = np.zeros(len(batch)), [b""] * len(batch)
            for c in np.unique(combo):
                of = np.flatnonzero(combo == c)
                v = _vectors(batch.column(3).take(pa.array(of)))
                if int(c) in models:
                    v = models[int(c)].whitened(v)
                    m2[of] = (v**2).sum(axis=1)
                for i, row in zip(of, v):
                    x[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(m2), pa.array(x, pa.binary())] + [batch.column(c) for c in more], ["combo", "id", "is_real", "m2", "x", *more])

    kinds = "".join(f", `{c}` {t}" for c, t in df.dtypes if c in more)
    return df.select(F.col("combo").cast("int").alias("combo"), F.col("id").cast("long").alias("id"), "is_real", "vector", *more).mapInArrow(run, MEASURED + kinds)


def exact_percentile(df: DataFrame, by: str, value: str, id_col: str, percentile: float) -> DataFrame:
    """Rows (by, n, threshold): the linearly interpolated percentile, from the two ranks it lies between; no group is gathered."""
    placed = ordinals(df.select(by, value, id_col), [value, id_col], "_rank", [by])
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    at = (F.col("n") - 1) * F.lit(percentile / 100)
    near = placed.join(sizes, by).filter((F.col("_rank") == F.floor(at)) | (F.col("_rank") == F.ceil(at)))
    low, high = F.min(value), F.max(value)
    share = F.first(at - F.floor(at))
    return near.groupBy(by).agg(F.first("n").alias("n"), (low + (high - low) * share).alias("threshold"))


def gate(df: DataFrame, percentile: float = 97.5, components: int = 200) -> DataFrame:
    """Rows (combo, id, is_real, vector) to the gate of each other row: (combo, id, n_real, m2, threshold, kept, x).

    The threshold is a percentile of the real rows' own m²; less than two real rows keep all.
    """
    models = geometries(df.filter("is_real"), components)
    rows = kept(measured(df, models), "measured")
    limits = exact_percentile(rows.filter("is_real"), "combo", "m2", "id", percentile)
    limit = F.when(F.col("n") > 1, F.col("threshold")).otherwise(F.lit(float("inf")))
    joined = rows.filter("not is_real").join(limits, "combo", "left").withColumn("threshold", F.coalesce(limit, F.lit(float("inf"))))
    return joined.select("combo", "id", F.coalesce("n", F.lit(0)).alias("n_real"), "m2", "threshold", (F.col("m2") <= F.col("threshold")).alias("kept"), "x")


def ranked(gated: DataFrame, ratios: list[float]) -> DataFrame:
    """The gate's survivors (combo, id, n_real, fps_rank) that the largest ratio takes, in farthest-point order from the real mean.

    A ratio's set is the prefix of round(ratio * n_real) ranks, halves to even.
    """
    from .diversity import farthest_order

    spark, alive = gated.sparkSession, gated.filter("kept")
    sizes = {r["combo"]: r["n"] for r in gated.groupBy("combo").agg(F.max("n_real").alias("n")).collect()}  # one row a group
    order = farthest_order(alive.select("combo", "id", "x"), {c: max(round(r * n) for r in ratios) for c, n in sizes.items()})
    return spark.createDataFrame([(c, i, sizes[c], k) for c, i, k in order], "combo int, id long, n_real long, fps_rank int")


def ratio_sets(ranks: DataFrame, ratios: list[float]) -> DataFrame:
    """Rows (ratio, combo, id, fps_rank): each ratio's nested prefix."""
    from ..functions.scalars import half_even

    each = ranks.select("*", F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio"))
    return each.filter(F.col("fps_rank") <= half_even(F.col("ratio") * F.col("n_real"))).select("ratio", "combo", "id", "fps_rank")


def moments(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Sums, sums of products and counts of vectors by group, merged from partial sums of each batch."""
    names = ", ".join(f"{b} int" for b in by)

    def run(batches):
        for batch in batches:
            keys = pd.MultiIndex.from_arrays([batch.column(b).to_pandas() for b in by])
            x = np.array(batch.column(vector).to_pylist(), float)
            for key in keys.unique():
                part = x[keys == key]
                out = {b: pa.array([k], pa.int32()) for b, k in zip(by, key)}
                out |= {"n": pa.array([len(part)]), "s": pa.array([part.sum(axis=0).tolist()]), "ss": pa.array([(part.T @ part).ravel().tolist()])}
                yield pa.RecordBatch.from_pydict(out)

    partial = df.select(*[F.col(b).cast("int").alias(b) for b in by], vector).mapInArrow(run, f"{names}, n long, s array<double>, ss array<double>")
    size = partial.select(F.posexplode(F.concat("s", "ss")).alias("k", "v"), "n", *by)
    summed = size.groupBy(*by, "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return summed.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("sums"))


def frechet(a: tuple[int, list[float]], b: tuple[int, list[float]]) -> float:
    """Fréchet distance of two sets from their counts and sums."""

    def parts(n, sums):
        d = int((np.sqrt(1 + 4 * len(sums)) - 1) / 2)
        mean = np.array(sums[:d]) / n
        return mean, np.array(sums[d:]).reshape(d, d) / n - np.outer(mean, mean)

    (m1, c1), (m2, c2) = parts(*a), parts(*b)
    values, vectors = np.linalg.eigh(c1)
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T
    middle = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * middle)


def kernel_distance(df: DataFrame, subsets: int, size: int, seed: int) -> DataFrame:
    """Kernel distance (cubic polynomial) per seeded subset of both sides; rows (subset, kid)."""
    counts = {r["side"]: r["n"] for r in df.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    draw = lambda s: F.xxhash64(F.lit(seed), s, F.col("id"))
    # ``size`` draws of least hash lie below this share of the hashes but for a chance of some 1e-15: a vector is copied only to the subsets it can be in
    share = {side: min(1.0, (size + 8 * size**0.5 + 16) / n) for side, n in counts.items()}
    limit = F.lit(2**63 - 1).cast("long")
    for side, p in share.items():
        limit = F.when(F.col("side") == side, F.lit(int(-(2**63) + p * (2**64 - 1)) if p < 1 else 2**63 - 1).cast("long")).otherwise(limit)
    w = Window.partitionBy("subset", "side").orderBy("draw", "id")
    near = F.filter(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda s: draw(s) <= limit)
    drawn = df.select("*", F.explode(near).alias("subset")).withColumn("draw", draw(F.col("subset")))
    chosen = kept(drawn.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= size), "subsets")
    short = chosen.groupBy("subset", "side").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < F.least(F.lit(size), F.lit(min(counts.values(), default=0))))
    if not short.isEmpty():
        raise ValueError("a subset is short: take another seed")

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(rows.loc[rows["side"] == s, "vector"].tolist(), float) for s in (0, 1))
        m, d = min(len(x), len(y)), x.shape[1]
        x, y = x[:m], y[:m]
        k = lambda a, b: (a @ b.T / d + 1) ** 3
        xx, yy, xy = k(x, x), k(y, y), k(x, y)
        value = (xx.sum() - np.trace(xx) + yy.sum() - np.trace(yy)) / (m * (m - 1)) - 2 * xy.mean()
        return pd.DataFrame({"subset": [rows["subset"].iloc[0]], "kid": [value]})

    return chosen.select("subset", "side", "id", "vector").groupBy("subset").applyInPandas(of, "subset int, kid double")


def _in_order(limit: int):
    """For applyInArrow over (combo, id, hash) of one block at most: the ids that are kept in order."""

    def run(table: pa.Table) -> pa.Table:
        ids, h = table.column("id").to_numpy().astype(np.int64), table.column("hash").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(ids, kind="stable")
        ids, h, out = ids[order], h[order], []
        while len(ids):
            out.append(int(ids[0]))
            far = np.bitwise_count(h ^ h[0]) > limit
            ids, h = ids[far], h[far]
        return pa.table({"id": pa.array(out, pa.int64())})

    return run


def first_wins(rows: DataFrame, limit: int, rounds: list | None = None) -> DataFrame:
    """Ids (id) that are kept when rows (combo, id, hash) come in order of id and one within ``limit`` bits of a kept one goes.

    The choice is the first independent set in order of id. A round keeps every open row without an earlier open
    neighbour and removes the open neighbours of those; all of it block against block, so a group of
    any size is shared by many tasks and no pair is a row. What is left of a group is settled in order within one task as
    soon as it fits into one block. Equal hashes are settled before: the first stands for all.
    ``rounds`` receives the number of open rows of each round.
    """
    from . import neighbours
    from .sampling import with_counts

    open_ = kept(rows.groupBy("combo", "hash").agg(F.min("id").alias("id")), "open")
    middles = centres(open_.select("id", F.col("hash").alias("x")), "hamming")
    own = lambda df: blocks(df, "hash", "hamming", group="combo", middles=middles)
    done = None
    while n := open_.count():
        if rounds is not None:
            rounds.append(n)
        sized = with_counts(open_, ["combo"], _n=F.count(F.lit(1)))
        few = sized.filter(F.col("_n") <= neighbours.BLOCK).select("combo", "id", "hash").groupBy("combo").applyInArrow(_in_order(limit), "id long")
        done = kept(few, "kept") if done is None else done.union(kept(few, "kept"))
        open_ = kept(sized.filter(F.col("_n") > neighbours.BLOCK).select("combo", "id", "hash"), "open")
        if open_.isEmpty():
            break
        a = own(open_)
        waiting = compared(close_pairs(block_pairs(a, a, "hamming"), "hamming", limit), a, a, earlier("hamming", limit), "query_id long").distinct()
        first = kept(open_.join(waiting, open_["id"] == waiting["query_id"], "left_anti"), "kept")
        done = done.union(first.select("id"))
        b = own(first)
        gone = compared(close_pairs(block_pairs(a, b, "hamming"), "hamming", limit), a, b, inside("hamming", limit), "query_id long").distinct()
        open_ = kept(open_.join(gone, open_["id"] == gone["query_id"], "left_anti"), "open")
    return rows.select("id").limit(0) if done is None else done


def greedy_gate(df: DataFrame, limit: int, target: int, rounds: list | None = None) -> DataFrame:
    """Candidates (combo, id, quality_ok, m2_ok, ref_near, hash) in order of id: (combo, id, decision), kept or the first reason against.

    Reasons in order: quality, outlier, near a kept one, near the reference; ends at ``target`` kept of a group.
    """
    rows = kept(df.select("combo", "id", "quality_ok", "m2_ok", "ref_near", "hash"), "candidates")
    fit = rows.filter("quality_ok AND m2_ok")
    won = kept(fit.join(first_wins(fit.filter("NOT ref_near").select("combo", "id", "hash"), limit, rounds), "id", "left_semi").select("combo", "id", "hash"), "won")
    a, b = (blocks(x, "hash", "hamming", group="combo") for x in (fit.filter("ref_near"), won))
    near = compared(close_pairs(block_pairs(a, b, "hamming"), "hamming", limit), a, b, earlier("hamming", limit), "query_id long").distinct()
    last = ordinals(won.select("combo", "id"), ["id"], "_place", ["combo"]).filter(F.col("_place") == target - 1).select("combo", F.col("id").alias("last"))
    marked = rows.join(won.select("id", F.lit(True).alias("won")), "id", "left").join(near.select(F.col("query_id").alias("id"), F.lit(True).alias("near")), "id", "left").join(last, "combo", "left")
    decision = (
        F.when(F.col("id") > F.col("last"), "not reached").when(~F.col("quality_ok"), "quality").when(~F.col("m2_ok"), "outlier")
        .when(F.col("won"), "kept").when(F.col("ref_near") & F.col("near").isNull(), "reference duplicate").otherwise("self duplicate")
    )
    return marked.select(F.col("combo").cast("int").alias("combo"), "id", decision.alias("decision"))


def power_spectrum(df: DataFrame, vector: str) -> DataFrame:
    """Mean power spectrum of windowed vectors: partial sums of each batch, then a sum by frequency."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                p = np.abs(np.fft.rfft(x * np.kaiser(x.shape[1], 8))) ** 2
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(p.shape[1]), pa.int32()), "p": p.sum(axis=0), "n": [len(x)] * p.shape[1]})

    parts = df.select(vector).mapInArrow(run, "k int, p double, n long")
    return parts.groupBy("k").agg((F.sum("p") / F.sum("n")).alias("power"))
