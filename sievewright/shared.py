"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where a local session names none, any other session is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not (made := getattr(work_folder, "own", None)):
            made = work_folder.own = tempfile.mkdtemp(prefix="sievewright-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        top = f"file://{made}"
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordinals(df: DataFrame, order: list[str], name: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """Places from 0 in ``order``, within groups ``by`` if named.

    Rows are dealt by range and written with their place in the range; the counts of the ranges, some
    for each task, then shift them. No task sorts a whole group.
    """
    keys = list(by or [])
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = kept(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ordered")
    pieces = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = F.col("_part") == F.col("_of")
    for s in same:
        on = on & s
    return ranged.join(pieces, on).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
