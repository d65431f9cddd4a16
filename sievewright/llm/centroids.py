"""Centroid clustering with exact integer arithmetic and annulus search.

The centroids of a round are sorted by norm. A vector's distance to the centroid of nearest norm
bounds its least distance from above; by the triangle inequality only centroids whose norm differs
from the vector's by no more can be as near. Their places are found by binary search in the sorted
norms. A batch goes through the centroids outwards in norm, each with those of its vectors whose
annulus holds it, and every distance found narrows the annulus of the rest. Candidates on the
boundary stay in, so ties are decided by the number of the centroid.

A round is one pass: tasks assign their vectors and send for each centroid a count and the sums of
the components; k rows of sums reach the driver, which divides them as whole numbers. No vector is
shuffled. The last assignment is written to the shared folder, since its totals go to every row.

Defined results: vectors that are null, of another size, or hold a null or non-finite component
take no part, nor do those with an integer component beyond 2^26 in size, as sums of their squared
distances would leave 64 bits; rows of null vec_id are clustered like any other but start no
centroid while there are others; rows that repeat count each; with fewer vectors than centroids
there are as many centroids as vectors; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Largest integer component, and the largest that float64 multiplies exactly in 64 dimensions and more.
LARGEST, IN_FLOAT = 1 << 26, 1 << 20
SLACK = 1e-9


def whole_vectors(embeddings: DataFrame, scale: int, size: int | None = None, largest: int = LARGEST) -> DataFrame:
    """Rows (vec_id, x): floor(scale * component) of the vectors that can take part."""
    x = F.transform(F.col("embedding"), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fine = F.forall(F.col("embedding"), lambda v: v.isNotNull() & (F.abs(v.cast("double")) <= F.lit(largest / scale)))
    fine = F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))
    if size is not None:
        fine &= F.size("embedding") == size
    return embeddings.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("x"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _squared(x: np.ndarray, c: np.ndarray, exact_in_float: bool) -> np.ndarray:
    """Squared distances of rows to one centroid, as int64."""
    if exact_in_float:
        d = x - c
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = x.astype(np.int64) - c.astype(np.int64)
    return (d * d).sum(axis=1)


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For int64 rows: nearest centroid, the smaller number first, squared distance, and how many distances were computed."""
    n, k = len(x), len(centroids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    light = max(np.abs(x).max(), np.abs(centroids).max(), 0) <= IN_FLOAT
    xs, cs = (x.astype(float), centroids.astype(float)) if light else (x, centroids)
    norms = np.sqrt((centroids.astype(float) ** 2).sum(axis=1))
    by_norm = np.argsort(norms, kind="stable")
    order = norms[by_norm]
    own = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    right = np.clip(np.searchsorted(order, own), 0, k - 1)
    left = np.maximum(right - 1, 0)
    seed = np.where(np.abs(order[left] - own) <= np.abs(order[right] - own), left, right)

    best, number, done = np.empty(n, np.int64), by_norm[seed], 0
    for s in np.unique(seed):
        of = np.flatnonzero(seed == s)
        best[of] = _squared(xs[of], cs[by_norm[s]], light)
        done += len(of)
    # Centroids from the middle of the seeds outwards; rows that a centroid's norm is too far from are left out.
    for j in np.argsort(np.abs(np.arange(k) - np.median(seed)), kind="stable"):
        reach = np.sqrt(best) * (1 + SLACK) + SLACK
        low, high = np.searchsorted(order, own - reach, "left"), np.searchsorted(order, own + reach, "right")
        of = np.flatnonzero((low <= j) & (j < high) & (seed != j))
        if not len(of):
            continue
        done += len(of)
        found, name = _squared(xs[of], cs[by_norm[j]], light), by_norm[j]
        better = (found < best[of]) | ((found == best[of]) & (name < number[of]))
        best[of[better]], number[of[better]] = found[better], name
    return number, best, done


def _sums(centroids: np.ndarray):
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]):
        n, s = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), size)
            number = assign(x, centroids)[0]
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                s[c] += x[number == c].sum(axis=0)
        for c in np.flatnonzero(n):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([c] * size, pa.int32()), "j": pa.array(range(size), pa.int32()), "n": pa.array([n[c]] * size, pa.int64()), "s": pa.array(s[c])})

    return run


def _nearest(centroids: np.ndarray):
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            number, distance, _ = assign(matrix(batch.column(1), size), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def centroid_clusters(spark: SparkSession, embeddings: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, size: int = 64, seed: int = 2) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each vector that takes part."""
    kept = whole_vectors(embeddings, scale, size)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select(name.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    now = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        found = kept.select("x").mapInArrow(_sums(now), "cluster int, j int, n long, s long").groupBy("cluster", "j")
        found = found.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k * size rows
        now = now.copy()
        for r in found:
            now[r["cluster"], r["j"]] = int(r["s"]) // r["n"]
    nearest = cut(spark, kept.mapInArrow(_nearest(now), "vec_id long, cluster int, distance long"), "nearest")
    totals = nearest.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # k rows
    named = [(r["cluster"], r["d"], sum(t["d"] for t in totals), hashlib.sha256(",".join(map(str, now[r["cluster"]].tolist())).encode()).hexdigest()) for r in totals]
    whole = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return nearest.join(F.broadcast(whole), "cluster").select(*[c.split()[0] for c in out.split(", ")])


def oracle_sql(k: int = 40, rounds: int = 5, scale: int = 256, size: int = 64, seed: int = 2) -> str:
    """The same rows, one set of expressions for each round."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS cluster, x AS c FROM kept QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS (SELECT row, vec_id, x, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT row, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY row, vec_id, x)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT cluster, list({floor} ORDER BY j) AS c FROM (SELECT cluster, j, count(*) AS n, sum(v) AS s FROM (
    SELECT cluster, unnest(x)::HUGEINT AS v, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY cluster, j) GROUP BY cluster),
c{r + 1} AS (SELECT o.cluster, coalesce(m.c, o.c)::BIGINT[] AS c FROM c{r} o LEFT JOIN m{r} m ON m.cluster = o.cluster)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""
