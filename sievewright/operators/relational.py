"""Joins, sets, groupings and top-k over relations with an explicit row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import ordinals


def exact_overlap(left: DataFrame, right: DataFrame, key: str | list[str], id_col: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` has, with the number of links and the least id there; ``right`` is counted before it is joined."""
    keys = [key] if isinstance(key, str) else key
    return left.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("links"), F.min(id_col).alias("first_id")), keys)


#: What names of columns that identify a person or a recording contain.
IDENTIFYING = ("patient", "subject", "case", "study", "series")


def identifier_columns(df: DataFrame) -> list[str]:
    """Names of columns that look like identifiers of persons or recordings, in order; no row is read."""
    return sorted(c for c in df.columns if any(x in c.lower() for x in IDENTIFYING))


def without(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``left``, repeats kept, whose keys ``right`` lacks."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def only(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def over_domain(domain: DataFrame, rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Aggregates by key over the whole domain, 0 where it has no rows."""
    counted = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in values.items()])
    return domain.join(counted, keys, "left").select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in values])


def first_k(df: DataFrame, by: list[str], order: list[Column], k: Column | int) -> DataFrame:
    """The first k rows of each group; k may be a column of the row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def guard_unique(df: DataFrame, key: str) -> DataFrame:
    """The rows, failing if a key is null or occurs twice."""
    w = Window.partitionBy(key)
    bad = F.col(key).isNull() | (F.count(F.lit(1)).over(w) > 1)
    return df.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit(f"{key} is null or repeated: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)).filter("_ok").drop("_ok")


def chunk(df: DataFrame, order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    """``chunk`` number of each row in groups of ``size``, in order, within ``by`` if named; no task sorts a group."""
    return ordinals(df, order, "_place", by).withColumn("chunk", F.floor(F.col("_place") / size)).drop("_place")


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two relations, also those that only one has."""
    both = left.select(key, F.col(value).alias("expected")).join(right.select(key, F.col(value).alias("found")), key, "full")
    return both.filter(~F.col("expected").eqNullSafe(F.col("found")))


def mode_policy(df: DataFrame, valid: Column, mode: str) -> DataFrame:
    """Bad rows by policy: dropped, kept with a flag, or an error."""
    if mode == "drop":
        return df.filter(valid)
    if mode == "permissive":
        return df.withColumn("valid", F.coalesce(valid, F.lit(False)))
    if mode == "failfast":
        return df.filter(F.when(valid, True).otherwise(F.raise_error(F.lit("a row is not valid")).cast("boolean")))
    raise ValueError(f"unknown mode {mode}")


def required(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """A lookup in which a key that ``right`` lacks is an error."""
    found = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"{key} is not there: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return found.filter(F.coalesce("_there", missing)).drop("_there")


def zip_rows(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of two relations at equal places; relations of unequal length are an error, before anything is joined."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows of one side and {b} of the other")
    clash = [c for c in right.columns if c in left.columns]
    other = ordinals(right, [right_order], "_place").drop(*clash)
    return ordinals(left, [left_order], "_place").join(other, "_place").drop("_place")
