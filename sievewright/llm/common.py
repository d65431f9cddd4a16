"""Shared pieces: the shared folder, lineage cuts and a look at the columns of the input."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
SPACES = r"[ \t\n\x0B\f\r]"


_made: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a temporary one serves a session that runs in one process;
    any other session is refused, since its executors would each see an empty folder of their own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not (made := getattr(shared_folder, "own", None)):
            made = shared_folder.own = tempfile.mkdtemp(prefix="sievewright-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        top = f"file://{made}"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(top)
    _made.append(f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def cut(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: a lost executor costs no recomputation."""
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession) -> None:
    """Removes all folders that operators of this driver have made below the shared folder.

    For the end of a job: results that have not been written elsewhere read from these folders.
    """
    jvm = spark.sparkContext._jvm
    while _made:
        place = jvm.org.apache.hadoop.fs.Path(_made.pop())
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def text_of(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def bucket(column: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as remainder null."""
    return F.crc32(F.col(column).cast("string")) % folds
