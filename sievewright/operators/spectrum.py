"""Mean two-dimensional power spectrum of images, and its slices in decibels.

An image is whitened by the mean and deviation of all pixels, weighted by the outer product of a Kaiser window and
transformed on a grid ``interp`` times as fine. Tasks sum the squared magnitudes of their images; what they send
is one grid each, in pieces of rows and ``PIECE`` columns, and pieces are summed by place. The result is a
grid of fixed size, whatever the number of images.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 256


def window(side: int, beta: float = 8.0) -> np.ndarray:
    """Outer product of a Kaiser window of unit energy with itself."""
    w = np.kaiser(side, beta)
    w = w / np.sqrt((w * w).sum())
    return np.outer(w, w)


def pixel_moments(images: DataFrame, pixels: str) -> tuple[int, float, float]:
    """Images, mean and population deviation of all pixels; one row of sums reaches the driver."""
    x = F.col(pixels)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    r = images.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(x)).alias("k"), F.sum(total).alias("s"), F.sum(square).alias("ss")).first()
    if not r["k"]:
        return 0, 0.0, 1.0
    mean = r["s"] / r["k"]
    return r["n"], mean, float(np.sqrt(max(r["ss"] / r["k"] - mean * mean, 0.0)))


def power(images: DataFrame, pixels: str, side: int, interp: int = 4, beta: float = 8.0) -> DataFrame:
    """Rows (v, u, power): mean squared magnitude at each frequency of the grid, from arrays of side * side pixels row by row."""
    n, mean, std = pixel_moments(images, pixels)
    w, grid = window(side, beta), side * interp

    def run(batches: Iterator[pa.RecordBatch]):
        total, seen = np.zeros((grid, grid)), False
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            for x in flat.reshape(len(batch), side, side):
                total += np.abs(np.fft.fft2((x - mean) / (std or 1.0) * w, (grid, grid))) ** 2
                seen = True
        if seen:
            v, at = np.divmod(np.arange(grid * -(-grid // PIECE)), -(-grid // PIECE))
            pieces = [total[i, j * PIECE : (j + 1) * PIECE].tolist() for i, j in zip(v, at)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(at, pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], ["v", "at", "p"])

    parts = images.select(pixels).mapInArrow(run, "v int, at int, p array<double>")
    each = parts.select("v", F.posexplode("p").alias("i", "p"), "at")
    return each.groupBy("v", (F.col("at") * PIECE + F.col("i")).alias("u")).agg((F.sum("p") / max(n, 1)).alias("power"))


def slices(grid: DataFrame, side: int) -> DataFrame:
    """Rows (angle, step, frequency, db): the spectrum in decibels from the zero frequency outwards, along a row and along the diagonal.

    Zero frequency is at (0, 0), and frequencies wrap, so step k of the row is (0, k), of the diagonal (k, k).
    """
    size = grid.agg(F.max("u")).first()[0]
    half = 0 if size is None else (size + 1) // 2
    along = F.array(
        F.struct(F.lit(0).alias("angle"), F.lit(0).alias("v"), F.col("step").alias("u"), (F.col("step") * F.lit(side / 2 / max(half, 1))).alias("frequency")),
        F.struct(F.lit(45).alias("angle"), F.col("step").alias("v"), F.col("step").alias("u"), (F.col("step") * F.lit(side / np.sqrt(2) / max(half, 1))).alias("frequency")),
    )
    wanted = grid.sparkSession.range(half + (size is not None)).select(F.col("id").cast("int").alias("step")).select("step", F.explode(along).alias("a")).select("step", "a.*")
    return wanted.join(grid, ["v", "u"]).select("angle", "step", "frequency", (10 * F.log10("power")).alias("db"))
