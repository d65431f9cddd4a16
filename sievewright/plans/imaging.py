"""Images made of vectors: spectrum, masks, statistics of features."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import imaging
from ..operators import feature_stats, spectrum
from ..session import table
from ..shared import work_folder
from .register import Register

REGISTER = query = Register()
SIDE, INTERP, CAP = 8, 2, 400
#: Enlargement of the vectors' squares to pictures, and the least object in them.
ENLARGED, LEAST = 6, 60


def _pixels(spark, sf):
    v = table(spark, sf, "embeddings").filter(F.size("embedding") == SIDE * SIDE)
    pixel = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(F.lit(128) + F.lit(256) * x.cast("double")), F.lit(0)), F.lit(255)).cast("int"))
    return v.select("vec_id", pixel.alias("pixels"))


def _power_sql() -> str:
    n, g = SIDE, SIDE * INTERP
    w = spectrum.window(n)
    weights = ", ".join(f"{x!r}" for x in w.ravel().tolist())
    return f"""p AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(128 + 256 * x::DOUBLE), 0), 255)) AS px FROM embeddings WHERE len(embedding) = {n * n}),
px AS (SELECT vec_id, unnest(px) AS x, generate_subscripts(px, 1) - 1 AS k FROM p), m AS (SELECT avg(x) AS mean, stddev_pop(x) AS std FROM px),
y AS (SELECT vec_id, k // {n} AS r, k % {n} AS c, (x - mean) / std * ([{weights}])[k + 1] AS y FROM px, m),
f AS (SELECT vec_id, v, u, sum(y * cos(2 * pi() * (v * r + u * c) / {g})) AS re, sum(y * sin(2 * pi() * (v * r + u * c) / {g})) AS im FROM y, range({g}) a(v), range({g}) b(u) GROUP BY 1, 2, 3),
grid AS (SELECT v, u, avg(re * re + im * im) AS power FROM f GROUP BY 1, 2)"""


@query(f"WITH {_power_sql()} SELECT v::INT AS v, u::INT AS u, round(power, 6) AS power FROM grid")
def spectrum_grid(spark, sf):
    """Mean two-dimensional power spectrum of all vectors as pictures."""
    return spectrum.power(_pixels(spark, sf), "pixels", SIDE, INTERP).select("v", F.col("u").cast("int").alias("u"), F.round("power", 6).alias("power"))


@query(
    f"""WITH {_power_sql()} SELECT 0 AS angle, u::INT AS step, round(u * {SIDE / 2} / {SIDE * INTERP // 2}, 6)::DOUBLE AS frequency, round(10 * log10(power), 6) AS db FROM grid WHERE v = 0 AND u <= {SIDE * INTERP // 2}
    UNION ALL SELECT 45, u::INT, round(u * {SIDE} / sqrt(2) / {SIDE * INTERP // 2}, 6)::DOUBLE, round(10 * log10(power), 6) FROM grid WHERE v = u AND u <= {SIDE * INTERP // 2}"""
)
def spectrum_slices(spark, sf):
    """The spectrum in decibels along a row and along the diagonal."""
    out = spectrum.slices(spectrum.power(_pixels(spark, sf), "pixels", SIDE, INTERP), SIDE)
    return out.select("angle", "step", F.round("frequency", 6).alias("frequency"), F.round("db", 6).alias("db"))


@query(
    f"""WITH o AS (SELECT embedding, row_number() OVER (ORDER BY vec_id % 3, vec_id) AS place FROM embeddings), k AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT AS k FROM o WHERE place <= {CAP})
    SELECT k, count(*) AS n, round(avg(x), 9) AS mean, round(var_pop(x), 9) AS variance FROM k GROUP BY k"""
)
def feature_states(spark, sf):
    """Mean and variance of features summed in three batches that are saved and merged, with a cap that the second or third reaches."""
    path = work_folder(spark, "features")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    for batch in range(3):
        feature_stats.append(v.filter(F.col("id") % 3 == batch), path, batch, CAP)
    n, mean, cov = feature_stats.merged(spark, path)
    return spark.createDataFrame([(k + 1, n, round(float(m), 9), round(float(c), 9)) for k, (m, c) in enumerate(zip(mean, np.diag(cov)))], "k int, n long, mean double, variance double")


@query(name="normalised_images")
def normalised_images(spark, sf):
    """Every vector's picture through mask, levels and frame: the attempt, its coverage and the digest of the result."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(batch), SIDE, SIDE)
            made = [imaging.normalised(np.kron(p, np.ones((ENLARGED, ENLARGED), np.uint8)), 32, LEAST) for p in x]
            digest = [hashlib.sha256(m[0].tobytes()).hexdigest() for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[1] for m in made], pa.int32()), pa.array([round(m[2], 9) for m in made]), pa.array(digest)], ["vec_id", "attempt", "coverage", "sha256"])

    return _pixels(spark, sf).mapInArrow(run, "vec_id long, attempt int, coverage double, sha256 string")
