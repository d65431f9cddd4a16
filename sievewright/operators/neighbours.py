"""Neighbours under Hamming, cosine and Euclidean distance, block against block.

Both sides are dealt to blocks of about ``BLOCK`` rows: by the nearest of at most ``CELLS`` centres from
a bounded sample, and by hash within a crowded cell. A block is one row of a table in the shared folder, with its
middle and the radius around it. Pairs of blocks meet by equi-joins on the block's number, never
through the driver; by the triangle inequality a pair of blocks that lie farther apart than their radii
and the distance sought cannot hold a neighbour and is left out before any vector is sent.

For the k nearest, each block is first compared with the block of nearest middle; the worst of what its
rows found there bounds the second, full search. The kernel of a pair returns k rows for each query, and the
best k of all pairs are merged by rank, cut on the map side. No pair of rows is ever a row.

Unit vectors under cosine distance c have Euclidean distance sqrt(2 c), so cells are cut there
in the same way. Ties go to the smaller id; distances are rounded to nine digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

#: Rows of a block, centres at most, and rows that centres are chosen from.
BLOCK, CELLS, SAMPLE = 1024, 64, 1024
BLOCKS = "g string, block int, n int, ids array<long>, x binary, extra array<double>, widest double, centre binary, radius double"
SLACK = 1e-6


def matrix(kind: str, column: pa.Array) -> np.ndarray:
    """Hashes as unsigned integers; vectors as rows, of length one for cosine (a norm counts as 1e-12 at least)."""
    if kind == "hamming":
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    if kind == "cosine":
        x = x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)
    return x


def unpacked(kind: str, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint64) if kind == "hamming" else np.frombuffer(data, float).reshape(n, -1)


def gaps(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Metric distances of rows to one row."""
    if kind == "hamming":
        return np.bitwise_count(x ^ y).astype(float)
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def reach(kind: str, distance):
    """The metric distance within which ``distance`` lies."""
    if kind == "cosine":
        return np.sqrt(2 * np.maximum(distance, 0)) + SLACK
    return np.asarray(distance, float) + (0 if kind == "hamming" else SLACK)


def rough(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances of two blocks, to within ``SLACK`` of their scale."""
    if kind == "hamming":
        return np.bitwise_count(x[:, None] ^ y[None, :]).astype(np.int16)
    if kind == "cosine":
        return 1 - x @ y.T
    square = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def exact(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances row by row."""
    if kind == "hamming":
        return np.bitwise_count(x ^ y).astype(float)
    if kind == "cosine":
        return np.round(1 - np.einsum("ij,ij->i", x, y), 9) + 0.0
    return np.round(np.sqrt(((x - y) ** 2).sum(axis=1)), 9)


def _wide(kind: str, d: np.ndarray) -> float:
    """Room for the rounding of ``rough``: squared distances lose half the digits near zero."""
    return 0.0 if kind == "hamming" else 1e-8 if kind == "cosine" else 1e-5 * (1 + float(d.max(initial=0)))


def group_key(column: Column | None) -> Column:
    """Groups as text; a null group is a group."""
    return F.lit("") if column is None else F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("null"))


def centres(rows: DataFrame, kind: str) -> np.ndarray:
    """At most ``CELLS`` rows far from each other among at most ``SAMPLE`` rows of least hash."""
    some = rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not some.num_rows:
        return np.zeros(0, np.uint64) if kind == "hamming" else np.zeros((0, 1))
    x = matrix(kind, some.column(1).combine_chunks())
    chosen, near = [0], gaps(kind, x, x[0])
    while len(chosen) < min(CELLS, max(1, len(x) // 16)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, gaps(kind, x, x[chosen[-1]]))
    return x[chosen]


def _placed(kind: str, middles: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = matrix(kind, batch.column(2))
            cell, best = np.zeros(len(batch), np.int32), np.full(len(batch), np.inf)
            for c, m in enumerate(middles):
                d = gaps(kind, x, m)
                cell[d < best], best = c, np.minimum(best, d)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 3)] + [pa.array(cell), pa.array([v.tobytes() for v in x], pa.binary())], ["g", "id", "extra", "cell", "x"])

    return run


def _packed(kind: str):
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        x = unpacked(kind, b"".join(table.column("x").to_pylist()), len(ids))[order]
        if kind == "hamming":
            middle = x[len(x) // 2]
        else:
            middle = x.mean(axis=0)
        extra = table.column("extra").to_numpy(zero_copy_only=False).astype(float)[order]
        row = {"g": table.column("g")[0].as_py(), "block": table.column("block")[0].as_py(), "n": len(ids), "ids": ids[order].tolist(), "x": x.tobytes(), "extra": extra.tolist()}
        row |= {"widest": float(extra.max()), "centre": middle.tobytes(), "radius": float(gaps(kind, x, middle).max())}
        kinds = [("g", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("extra", pa.list_(pa.float64())), ("widest", pa.float64()), ("centre", pa.binary()), ("radius", pa.float64())]
        return pa.Table.from_pylist([row], pa.schema(kinds))

    return pack


def blocks(df: DataFrame, value: str, kind: str, id_col: str = "id", group: str | None = None, extra: Column | None = None, middles: np.ndarray | None = None) -> DataFrame:
    """Rows as ``BLOCKS`` says; rows of null id or value have no block, ``extra`` is a number that goes with each."""
    rows = df.select(group_key(F.col(group) if group else None).alias("g"), F.col(id_col).cast("long").alias("id"), F.col(value).alias("x"), (F.lit(0.0) if extra is None else extra).cast("double").alias("extra")).dropna()
    middles = centres(rows, kind) if middles is None else middles
    placed = rows.select("g", "id", "x", "extra").mapInArrow(_placed(kind, middles), "g string, id long, extra double, cell int, x binary")
    sizes = placed.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("slices"))
    first = F.sum("slices").over(Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    dealt = placed.join(sizes.withColumn("first", F.coalesce(first, F.lit(0))), ["g", "cell"])
    number = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("slices"))).cast("int")
    return kept(dealt.select("g", number.alias("block"), "id", "x", "extra").groupBy("g", "block").applyInArrow(_packed(kind), BLOCKS), "blocks")


def _gap_of(kind: str):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            p, q = (unpacked(kind, b"".join(batch.column(c).to_pylist()), len(batch)) for c in ("p", "q"))
            d = np.bitwise_count(p ^ q).astype(float) if kind == "hamming" else np.sqrt(((p - q) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("g", "i", "j", "r", "s")] + [pa.array(d)], ["g", "i", "j", "r", "s", "gap"])

    return run


def block_pairs(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """Rows (g, i, j, r, s, gap): pairs of blocks of a group, their radii and the distance of their middles; no vector but the middles."""
    sizes = right.groupBy("g").agg(F.max("block").alias("last"))
    a = left.select("g", F.col("block").alias("i"), F.col("centre").alias("p"), F.col("radius").alias("r")).join(sizes, "g")
    a = a.select("g", "i", "p", "r", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("j"))
    b = right.select("g", F.col("block").alias("j"), F.col("centre").alias("q"), F.col("radius").alias("s"))
    return kept(a.join(b, ["g", "j"]).select("g", "i", "j", "r", "s", "p", "q").mapInArrow(_gap_of(kind), "g string, i int, j int, r double, s double, gap double"), "pairs")


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, kernel, schema: str) -> DataFrame:
    """The kernel's rows for each pair (g, i, j) of blocks."""

    def side(df: DataFrame, number: str, name: str) -> DataFrame:
        return df.select("g", F.col("block").alias(number), F.struct("n", "ids", "x", "extra").alias(name))

    sent = pairs.select("g", "i", "j").join(side(left, "i", "a"), ["g", "i"]).join(side(right, "j", "b"), ["g", "j"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in range(len(batch)):
                yield kernel(batch.column(0)[row].as_py(), batch.column(1)[row].as_py())

    return sent.mapInArrow(run, schema)


def _side(kind: str, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(block["ids"], np.int64), unpacked(kind, block["x"], block["n"]), np.array(block["extra"], float)


def _rows(*columns) -> pa.RecordBatch:
    names = ("query_id", "base_id", "distance")
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(names[: len(columns)]))


def best(kind: str, k: int):
    """Kernel: the k nearest of each row."""

    def kernel(a: dict, b: dict) -> pa.RecordBatch:
        (ids, x, _), (other, y, _) = _side(kind, a), _side(kind, b)
        d = rough(kind, x, y)
        last = min(k, len(other)) - 1
        limit = np.partition(d, last, axis=1)[:, last : last + 1] + _wide(kind, d)
        r, c = np.nonzero(d <= limit)
        e = exact(kind, x[r], y[c])
        order = np.lexsort((other[c], e, r))
        r, c, e = r[order], c[order], e[order]
        first = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        keep = rank < k
        return _rows(ids[r[keep]], other[c[keep]], e[keep])

    return kernel


def within(kind: str, limit: float):
    """Kernel: the pairs within ``limit``."""

    def kernel(a: dict, b: dict) -> pa.RecordBatch:
        (ids, x, _), (other, y, _) = _side(kind, a), _side(kind, b)
        d = rough(kind, x, y)
        r, c = np.nonzero(d <= limit + _wide(kind, d))
        e = exact(kind, x[r], y[c])
        keep = e <= limit
        return _rows(ids[r[keep]], other[c[keep]], e[keep])

    return kernel


def inside(kind: str, limit: float | None = None):
    """Kernel: the rows of the left block with a row of the right one within ``limit``, or within that row's own radius."""

    def kernel(a: dict, b: dict) -> pa.RecordBatch:
        (ids, x, _), (_, y, radius) = _side(kind, a), _side(kind, b)
        d, most = rough(kind, x, y), radius[None, :] if limit is None else limit
        wide = _wide(kind, d)
        sure = (d <= most - wide).any(axis=1)
        r, c = np.nonzero((np.abs(d - most) <= wide) & ~sure[:, None])
        near = exact(kind, x[r], y[c]) <= (radius[c] if limit is None else limit)
        sure[r[near]] = True
        return _rows(ids[sure])

    return kernel


def earlier(kind: str, limit: float):
    """Kernel: the rows of the left block with a row of the right one of smaller id within ``limit``."""

    def kernel(a: dict, b: dict) -> pa.RecordBatch:
        (ids, x, _), (other, y, _) = _side(kind, a), _side(kind, b)
        before = other[None, :] < ids[:, None]
        d = rough(kind, x, y)
        r, c = np.nonzero(before & (d <= limit + _wide(kind, d)))
        return _rows(np.unique(ids[r[exact(kind, x[r], y[c]) <= limit]]))

    return kernel


def nearest_k(queries: DataFrame, base: DataFrame, value: str, kind: str, k: int = 1, id_col: str = "id", group: str | None = None) -> DataFrame:
    """Rows (query_id, base_id, distance, rank): the k nearest base rows, within a group if named; ties go to the smaller id."""
    b = blocks(base, value, kind, id_col, group)
    q = blocks(queries, value, kind, id_col, group)
    return _merged(*searched(q, b, kind, k)[:2], k)


def searched(q: DataFrame, b: DataFrame, kind: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What the nearest block gives, what the others add, the pairs of blocks, and those that were compared."""
    schema = "query_id long, base_id long, distance double"
    pairs = block_pairs(q, b, kind)
    first = pairs.groupBy("g", "i").agg(F.min(F.struct("gap", "j")).alias("m")).select("g", "i", "m.j")
    found = kept(compared(first, q, b, best(kind, k), schema), "nearest")
    worst = found.groupBy("query_id").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n"))
    owner = q.select("g", F.col("block").alias("i"), F.explode("ids").alias("query_id"))
    bounds = owner.join(worst, "query_id", "left").groupBy("g", "i").agg(F.when(F.min(F.coalesce("n", F.lit(0))) >= k, F.max("d")).alias("d"))
    limit = F.sqrt(2 * F.greatest("d", F.lit(0.0))) if kind == "cosine" else F.col("d")
    open_ = pairs.join(first.withColumn("done", F.lit(True)), ["g", "i", "j"], "left").filter("done IS NULL").join(bounds, ["g", "i"])
    open_ = open_.filter(F.col("d").isNull() | (F.col("gap") - F.col("r") - F.col("s") <= limit + SLACK)).select("g", "i", "j")
    more = compared(open_, q, b, best(kind, k), schema)
    return found, more, pairs, first.union(open_)


def _merged(found: DataFrame, more: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "base_id"))
    return found.union(more).withColumn("rank", rank).filter(F.col("rank") <= k)


def close_pairs(pairs: DataFrame, kind: str, limit: float) -> DataFrame:
    return pairs.filter(F.col("gap") - F.col("r") - F.col("s") <= float(reach(kind, limit)))


def pairs_within(left: DataFrame, right: DataFrame, value: str, kind: str, limit: float, id_col: str = "id", group: str | None = None) -> DataFrame:
    """Rows (query_id, base_id, distance) of all pairs within ``limit``."""
    a, b = blocks(left, value, kind, id_col, group), blocks(right, value, kind, id_col, group)
    return compared(close_pairs(block_pairs(a, b, kind), kind, limit), a, b, within(kind, limit), "query_id long, base_id long, distance double")


def with_neighbour(left: DataFrame, right: DataFrame, value: str, kind: str, limit: float, id_col: str = "id", group: str | None = None) -> DataFrame:
    """The ids of ``left`` (query_id) with a row of ``right`` within ``limit``, each once; no pair is returned."""
    a, b = blocks(left, value, kind, id_col, group), blocks(right, value, kind, id_col, group)
    return compared(close_pairs(block_pairs(a, b, kind), kind, limit), a, b, inside(kind, limit), "query_id long").distinct()


def in_manifold(probes: DataFrame, manifold: DataFrame, value: str, radius: str, kind: str = "euclid", id_col: str = "id", group: str | None = None) -> DataFrame:
    """The ids of ``probes`` (query_id) that lie within the radius of any row of ``manifold``, each once."""
    a, b = blocks(probes, value, kind, id_col, group), blocks(manifold, value, kind, id_col, group, F.col(radius))
    widest = b.select("g", F.col("block").alias("j"), "widest")
    pairs = block_pairs(a, b, kind).join(widest, ["g", "j"]).filter(F.col("gap") - F.col("r") - F.col("s") <= F.col("widest") + SLACK)
    return compared(pairs, a, b, inside(kind), "query_id long").distinct()
