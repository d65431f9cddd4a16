"""Relations of the study, read from the supplied tables, with the SQL that names the same rows.

Vectors stand for features (``combo`` is the label, every third is real, every fifth is test),
labelled documents for cases, five conditions by ten seeds of seeded predictions for trained
models, days of events for training ticks, and months of orders for checkpoints.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_rank, sign_hash
from ..session import table


def sql_mix(seed: int, *ids: str) -> str:
    """SQL of ``hash_rank``."""
    x = f"{seed}::BIGINT"
    for i in ids:
        x = f"((({x} * 48271 + ({i})::BIGINT * 69621 + 12345) % 2147483647 + 2147483647) % 2147483647)"
        x = f"(({x} * 48271 + 11) % 2147483647)"
    return x


def sql_mix32(seed: str, *ids: str) -> str:
    """SQL of ``mix32``."""
    words = ", ".join(f"({i})::BIGINT & 4294967295, (({i})::BIGINT >> 32) & 4294967295, 0" for i in ids)
    return f"list_reduce([({seed})::BIGINT & 4294967295, {words}, 0], lambda x, i: (xor(xor(x, i), xor(x, i) >> 16) * 73244475) & 4294967295)"


def vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select(
        F.col("vec_id").alias("id"), F.col("label").alias("combo"), "embedding", (F.col("vec_id") % 3 == 0).alias("is_real"), (F.col("vec_id") % 5 == 4).alias("is_test")
    )


def hashes(spark, sf):
    return vectors(spark, sf).withColumn("hash", sign_hash(F.col("embedding")))


VECTORS = """vectors AS (SELECT vec_id AS id, label AS combo, embedding::DOUBLE[] AS e, vec_id % 3 = 0 AS is_real, vec_id % 5 = 4 AS is_test FROM embeddings),
hashes AS (SELECT *, list_transform(e, lambda x: x > list_aggregate(e, 'median')) AS bits FROM vectors)"""
HAMMING = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda p: (p[1] <> p[2])::INT))::INT"
COSINE = "round(1 - list_dot_product(a.e, b.e) / (greatest(sqrt(list_dot_product(a.e, a.e)), 1e-12) * greatest(sqrt(list_dot_product(b.e, b.e)), 1e-12)), 9)"


def predictions(spark, sf):
    """Rows (condition, seed, case_id, y_true, y_pred) of four classes."""
    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") * 2 + F.col("toxic")).alias("y_true"))
    runs = spark.range(50).select((F.col("id") % 5).cast("int").alias("condition"), F.floor(F.col("id") / 5).cast("int").alias("seed"))
    x = hash_rank(17, F.col("condition"), F.col("seed"), F.col("case_id"))
    wrong = (F.floor(x / 1000) % 4).cast("int")
    return cases.crossJoin(F.broadcast(runs)).select("condition", "seed", "case_id", "y_true", F.when(x % 100 < 75 + 3 * F.col("condition"), F.col("y_true")).otherwise(wrong).alias("y_pred"))


_X = sql_mix(17, "condition", "seed", "case_id")
PREDICTIONS = f"""cases AS (SELECT doc_id AS case_id, quality * 2 + toxic AS y_true FROM labels),
runs AS (SELECT (i % 5)::INT AS condition, (i // 5)::INT AS seed FROM range(50) t(i)),
predictions AS (SELECT condition, seed, case_id, y_true, CASE WHEN {_X} % 100 < 75 + 3 * condition THEN y_true ELSE (({_X} // 1000) % 4)::INT END AS y_pred FROM cases, runs)"""


def ticks(spark, sf):
    """Rows (name, tick, value, n): mean value and number of events of each type and day."""
    e = table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(F.col("event_type").alias("name"), day.alias("tick")).agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n"))


TICKS = "ticks AS (SELECT event_type AS name, datediff('day', DATE '2024-01-01', ts::DATE)::INT AS tick, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2)"


def checkpoints(spark, sf):
    """Rows (model, kimg, fid, precision, recall) by priority and month of orders."""
    o = table(spark, sf, "orders")
    kimg = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")
    return o.groupBy(F.col("o_orderpriority").alias("model"), kimg.alias("kimg")).agg(
        F.round(F.avg("o_totalprice") / 5000, 4).alias("fid"),
        F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 4).alias("precision"),
        F.round(F.avg((F.col("o_custkey") % 2 == 0).cast("double")), 4).alias("recall"),
    )


CHECKPOINTS = """checkpoints AS (SELECT o_orderpriority AS model, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate))::INT AS kimg, round(avg(o_totalprice) / 5000, 4) AS fid,
    round(avg((o_orderstatus = 'F')::INT::DOUBLE), 4) AS precision, round(avg((o_custkey % 2 = 0)::INT::DOUBLE), 4) AS recall FROM orders GROUP BY 1, 2)"""
