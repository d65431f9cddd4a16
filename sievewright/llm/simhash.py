"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has one bit for each bit of the 64-bit shingle hashes: set if it is set in over
half of them. Bit i of a fingerprint has a vector m(i) of radius + 1 bits, and there is one mask
for each non-zero vector v: it holds the bits i with <m(i), v> even removed, odd kept. Two
fingerprints that differ in at most ``radius`` bits give ``radius`` equations over radius + 1
unknowns, so some v makes all differing bits even: below its mask the two are equal. Hence every
pair within the radius shares a bucket of some table, with no exception.

Copies collapse to one fingerprint before any table is built. Inside a bucket a search along
unvisited fingerprints returns a spanning forest of the links, never all pairs; a bucket of many
distinct fingerprints is divided again by an independent covering family of the same guarantee.

Defined results: a null or empty text has fingerprint zero and links like any other; a text of any
length counts whole, its shingles in blocks; a bit set in exactly half the hashes is 0; rows that
repeat keep one row each, an empty table gives none; rows with a null id get a component by their text; further columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_of
from .components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
BLOCK = 65_536
#: Distinct fingerprints of a bucket that are compared directly; larger ones are divided again.
DIRECT = 4096


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a lower-cased text, in blocks."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return
    size = min(size, len(words))
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words) - size + 1
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(at + BLOCK, n)], starts[at + size : min(at + BLOCK, n) + size])
        yield np.fromiter((xxh64_intdigest(joined[s : e - 1], SEED) for s, e in pairs), np.uint64)


def fingerprint(text: bytes, size: int = 4) -> int:
    """The fingerprint as an unsigned integer."""
    return majority(shingle_hashes(text, size))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            texts = (x.as_buffer() for x in batch.column(1).cast(pa.binary()))
            fps = np.fromiter((fingerprint(x.to_pybytes(), size) for x in texts), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


@cache
def covering_masks(radius: int, family: int = 0) -> tuple[int, ...]:
    """The masks of one covering family; another ``family`` assigns other vectors to the bits."""
    vectors = np.arange(64) % ((1 << (radius + 1)) - 1) + 1
    np.random.default_rng(1000 + family).shuffle(vectors)
    return tuple(
        sum(1 << i for i in range(64) if (int(vectors[i]) & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))
    )


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints, by direct comparison."""
    left, ups, downs = fps, [], []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            fresh = []
            for at in range(0, len(frontier), 256):
                part = frontier[at : at + 256]
                near = np.bitwise_count(left[:, None] ^ part[None, :]) <= radius
                hit = near.any(axis=1)
                ups.append(part[near[hit].argmax(axis=1)])
                downs.append(left[hit])
                fresh.append(left[hit])
                left = left[~hit]
                if not len(left):
                    break
            frontier = np.concatenate(fresh)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *ups]), np.concatenate([none, *downs])


def links(fps: np.ndarray, radius: int, family: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is linked among distinct fingerprints of one bucket."""
    if len(fps) <= DIRECT or family > 3:
        yield forest(fps, radius)
        return
    for mask in covering_masks(radius, family):
        keys = fps & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for group in np.split(fps[order], cuts):
            if len(group) > 1:
                yield from links(group, radius, family + 1)


def bucket_links(radius: int):
    """For mapInArrow over rows (table, key, fp) sorted by table and key: edges (a, b)."""

    def edges(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        sizes = ends - starts
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        yield a[near], b[near]
        for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
            yield from links(fps[s:e], radius)

    def run(batches):
        held: list[np.ndarray] = []  # rows of the last, perhaps unfinished group
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if held and rows.shape[1] and (held[-1][:2, -1] != rows[:2, 0]).any():
                yield from made(np.concatenate(held, axis=1))
                held = []
            if not rows.shape[1]:
                continue
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
            if len(change):
                yield from made(np.concatenate([*held, rows[:, : change[-1] + 1]], axis=1))
                held = [rows[:, change[-1] + 1 :]]
            else:
                held.append(rows)
        if held:
            yield from made(np.concatenate(held, axis=1))

    def made(rows: np.ndarray):
        cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, rows.shape[1]]
        for a, b in edges(rows[2].view(np.uint64), starts, ends):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all that are within the radius."""
    tables = [F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for v, mask in enumerate(covering_masks(radius))]
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("k")).select("k.table", "k.key", "fp")
    return rows.repartition("table", "key").sortWithinPartitions("table", "key", "fp").mapInArrow(bucket_links(radius), "a long, b long")


def simhash_components(
    spark: SparkSession, docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    ``component_id`` is the least doc_id that can be reached over links of at most ``radius``
    differing bits.
    """
    marked = cut(spark, fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = cut(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(spark, near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
