"""Mean and covariance of feature vectors from saved partial sums, with an exact cap on the number of items.

Each batch adds one file of sums (n, sum, sum of products) to a folder; sums of batches are associative, so a run that was cut
off goes on with the batches that are missing. The cap counts items in order of batch and id: the batch in which it is
reached gives its first items by place, later ones give none. A batch that is written again replaces itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ordinals
from .selection import moments

STATE = "batch long, n long, sums array<double>"


def saved(spark: SparkSession, path: str) -> DataFrame:
    """Rows (batch, n, sums) of the folder; none where there is no folder yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(path)


def append(rows: DataFrame, path: str, batch: int, cap: int | None = None, vector: str = "vector", id_col: str = "id") -> int:
    """Adds the sums of a batch of (id, vector); returns how many of its items counted."""
    spark = rows.sparkSession
    before = saved(spark, path).filter(F.col("batch") < batch).agg(F.sum("n")).first()[0] or 0
    slim = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).dropna()
    if cap is not None:
        room = max(0, cap - before)
        slim = ordinals(slim, ["id"], "place").filter(F.col("place") < room)
    sums = moments(slim.withColumn("one", F.lit(0)), "vector", ["one"]).select(F.lit(batch).cast("long").alias("batch"), "n", "sums")
    sums.write.mode("overwrite").parquet(f"{path}/batch-{batch:08d}")
    return spark.read.parquet(f"{path}/batch-{batch:08d}").agg(F.sum("n")).first()[0] or 0


def merged(spark: SparkSession, path: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and population covariance over all saved batches; their sums, whose size is that of a covariance, meet by place."""
    each = saved(spark, path).select("n", F.posexplode("sums").alias("k", "s"))
    rows = each.groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("k").collect()
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, s = rows[0]["n"], np.array([r["s"] for r in rows])
    d = int((np.sqrt(1 + 4 * len(s)) - 1) / 2)
    mean = s[:d] / n
    return n, mean, s[d:].reshape(d, d) / n - np.outer(mean, mean)


def stream(rows: DataFrame, path: str, checkpoint: str, cap: int | None = None, vector: str = "vector", id_col: str = "id"):
    """A streaming query that adds every micro-batch; its number names the sums, so a repeated batch counts once."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: append(df, path, n, cap, vector, id_col)).start()
