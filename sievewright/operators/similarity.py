"""Similarity joins and nearest neighbours under Hamming and cosine distance.

A band join finds all pairs within a Hamming distance t without comparing all rows. Up to ``BANDED``
bits, 64 bits fall into t + 1 bands, of which one at least is equal. Up to ``ERRORS`` bits, they fall into
four bands of 16 bits, and one of them differs by a quarter of t at most: one side sends every band with
up to so many bits turned, the other as it is. Wider limits would send more candidates than there are
pairs; there, and for nearest neighbours, rows are compared block against block (``neighbours``).
All of it goes by shuffle; the driver sees no row but the bounded sample that cells are made of.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hamming
from . import neighbours

BROADCAST_ROWS = 50_000
#: Widest limits of the band joins: bands of eight bits, and two turned bits in one of four bands.
BANDED, ERRORS = 7, 11


def bands(column: Column, limit: int) -> list[Column]:
    """The limit + 1 bands of a 64-bit hash."""
    n, at, found = limit + 1, 0, []
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        found.append(F.shiftrightunsigned(column, at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)))
        at += width
    return found


def turned(width: int, errors: int) -> list[int]:
    """All masks of ``width`` bits with at most ``errors`` set."""
    return [sum(1 << i for i in c) for e in range(errors + 1) for c in combinations(range(width), e)]


def hamming_join(left: DataFrame, right: DataFrame, limit: int, id_col: str = "id", hash_col: str = "hash") -> DataFrame:
    """Rows (left_id, right_id, distance) of all pairs within ``limit`` bits, each once; rows of null hash have none."""
    if limit > ERRORS:
        found = neighbours.pairs_within(left, right, hash_col, "hamming", limit, id_col)
        return found.select(F.col("query_id").alias("left_id"), F.col("base_id").alias("right_id"), F.col("distance").cast("int").alias("distance")).distinct()
    n = limit + 1 if limit <= BANDED else 4
    masks = [0] if limit <= BANDED else turned(16, limit // 4)

    def banded(df: DataFrame, side: str, masks: list[int]) -> DataFrame:
        rows = df.select(F.col(id_col).alias(f"{side}_id"), F.col(hash_col).alias(f"{side}_hash")).filter(F.col(f"{side}_hash").isNotNull())
        keys = F.array(*[F.struct(F.lit(k).alias("band"), b.alias("value")) for k, b in enumerate(bands(F.col(f"{side}_hash"), n - 1))])
        rows = rows.select(f"{side}_id", f"{side}_hash", F.explode(keys).alias("k"))
        if len(masks) == 1:
            return rows.select(f"{side}_id", f"{side}_hash", "k.band", "k.value")
        wrong = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("k.value").bitwiseXOR(m))
        return rows.select(f"{side}_id", f"{side}_hash", "k.band", F.explode(wrong).alias("value"))

    pairs = banded(left, "left", masks).join(banded(right, "right", [0]), ["band", "value"])
    near = pairs.withColumn("distance", hamming(F.col("left_hash"), F.col("right_hash"))).filter(F.col("distance") <= limit)
    return near.select("left_id", "right_id", "distance").distinct()


def near_rows(left: DataFrame, right: DataFrame, limit: int, id_col: str = "id", hash_col: str = "hash") -> DataFrame:
    """The ids (id) of ``left`` that have a row of ``right`` within ``limit`` bits, each once; copies are not expanded into pairs."""
    if limit > ERRORS:
        return neighbours.with_neighbour(left, right, hash_col, "hamming", limit, id_col).select(F.col("query_id").alias(id_col))
    distinct = right.groupBy(hash_col).agg(F.min(id_col).alias(id_col))
    return hamming_join(left, distinct, limit, id_col, hash_col).select(F.col("left_id").alias(id_col)).distinct()


def nearest(queries: DataFrame, base: DataFrame, value: str, metric: str, id_col: str = "id", group: str | None = None) -> DataFrame:
    """Rows (query_id, base_id, distance): nearest base row by ``hamming`` or ``cosine``, within a group if named."""
    kind = "int" if metric == "hamming" else "double"
    return neighbours.nearest_k(queries, base, value, metric, 1, id_col, group).select("query_id", "base_id", F.col("distance").cast(kind).alias("distance"))
