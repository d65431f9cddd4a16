"""Writers: manifests, histories, sharded request files with an index, plot data, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import ordinals


def manifest(df: DataFrame, path: str, fields: list[str], order: list[str] | None = None) -> None:
    """CSV with a header and explicit field order, sorted by ``order``; an empty table writes its header."""
    rows = df.select(*fields)
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("header", True).csv(path)


def history(parts: list[DataFrame], path: str, by: list[str]) -> None:
    """Rows of differing columns as JSON lines with sorted keys and as CSV, with the union of columns in first-seen order."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows.select(sorted_json(rows).alias("value"), *by).write.mode("overwrite").partitionBy(*by).text(f"{path}/jsonl")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def sorted_json(df: DataFrame) -> Column:
    """A row as compact JSON, keys sorted, nulls left out."""
    return F.to_json(F.struct(*sorted(df.columns)))


def append_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Adds records to a folder of JSON lines, in order within what is added; what is there stays."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.select(sorted_json(df).alias("value")).write.mode("append").text(path)


def stream_lines(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that adds records as JSON lines, each micro-batch once: its number names its folder."""

    def put(df: DataFrame, batch: int) -> None:
        df.select(sorted_json(df).alias("value")).write.mode("overwrite").text(f"{path}/batch={batch:08d}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def document(df: DataFrame, path: str) -> None:
    """One row, nested as it is, as one JSON document with sorted keys; any other number of rows is an error."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError("a document is one row")
    df.select(sorted_json(df).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def features(df: DataFrame, path: str, order: str, vector: str, overwrite: bool = False) -> None:
    """Vectors in order of a column as one .npy file, with lineage beside it: rows, width and the hash of the file.

    Tasks write their rows as raw floats; the commit puts the header before them and renames the whole.
    """
    from .arrays import FeatureSink

    df.sparkSession.dataSource.register(FeatureSink)
    rows = ordinals(df.select(F.col(order).alias("_order"), F.col(vector).cast("array<float>").alias("vector")), ["_order"], "row_id")
    rows = rows.select("row_id", "vector").repartitionByRange("row_id").sortWithinPartitions("row_id")
    rows.write.format("feature_file").mode("overwrite" if overwrite else "append").save(path)


def shards(df: DataFrame, path: str, order: list[Column], cap: int, groups: list[str]) -> DataFrame:
    """Rows as JSON lines in shards of at most ``cap`` records; returns the index (groups, shard, n).

    Numbers are given within ``groups``, so no sort spans the whole table.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    rows = df.withColumn("shard", F.floor((F.row_number().over(w) - 1) / cap))
    rows.write.mode("overwrite").partitionBy(*groups, "shard").json(path)
    written = df.sparkSession.read.json(path)
    index = written.groupBy(*groups, "shard").agg(F.count(F.lit(1)).alias("n"))
    over = index.filter(F.col("n") > cap).limit(1).count()
    if over or written.count() != df.count():
        raise ValueError("shards do not hold what was written")
    return index


def plot_data(df: DataFrame, path: str, decimals: int = 6) -> None:
    """Space-delimited numbers with fixed decimals."""
    columns = [F.format_string(f"%.{decimals}f", F.col(c).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("header", True).option("sep", " ").csv(path)


def registry(df: DataFrame, path: str, plot: str, order: list[str]) -> None:
    """A record of metadata, then the data; a record of availability where there is none."""
    spark = df.sparkSession
    head = spark.createDataFrame([(plot, "plot_metadata", 0)], "plot string, record_type string, position int").select("position", F.to_json(F.struct("record_type", "plot")).alias("value"))
    body = df.select(F.lit(1).alias("position"), F.to_json(F.struct(F.lit("data").alias("record_type"), *order, *[c for c in df.columns if c not in order])).alias("value"))
    if df.isEmpty():
        body = spark.createDataFrame([(1, '{"record_type":"data_availability","available":false}')], "position int, value string")
    head.unionAll(body).repartitionByRange("position", "value").sortWithinPartitions("position", "value").select("value").write.mode("overwrite").text(path)


def report(row: dict, title: str, warn: dict[str, float] | None = None) -> str:
    """A markdown table of one summary row, with a line for each value over its limit."""
    lines = [f"# {title}", "", "| measure | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in row.items()]]
    over = [k for k, most in (warn or {}).items() if row.get(k) is not None and row[k] > most]
    return "\n".join([*lines, *([""] if over else []), *[f"**{k} exceeds {warn[k]}**" for k in over]]) + "\n"


def lineage(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: number of rows and an order-independent fingerprint of (key, value) pairs."""
    mixed = F.xxhash64(key, value).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(mixed).cast("string").alias("fingerprint"))
