"""SimHash near-dedup at a similarity: links are pairs whose shingle sets have a Jaccard index of 0.8.

Rows of equal shingle sets collapse to one node. Candidates come from the covering search of
``simhash`` over the nodes' fingerprints: nodes of one fingerprint, and fingerprints within the
radius, all of which it guarantees to find. Sixty-four bits cannot carry a similarity of 0.8 (two
such texts differ in some ten of them, and a covering family of that radius has two thousand
tables), so nodes have ``BANDS`` keys of ``ROWS`` minimum hashes beside it: a pair of resemblance J
shares none with probability ``(1 - J ** ROWS) ** BANDS``, 5e-8 at 0.8. Every candidate of either
kind is then decided on its whole sets, so no link is below the threshold. Only nodes that are
candidates have their sets sent.

Defined results: words are those of ``simhash``; a text of fewer words than a shingle has itself as
its one shingle; null and empty texts are one node; rows are numbered, so ids may repeat or be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_of
from .components import components
from .simhash import majority, near_links, shingle_hashes
from .wordhash import U64, mix

SIZE, THRESHOLD, RADIUS = 5, 0.8, 4
BANDS, ROWS = 32, 4
BLOCK = 2048
#: Nodes of a key whose pairs are sent; nodes of a block, and shingles counted at once, where there are more.
CROWD, BLOCK_NODES, COLUMNS = 16, 256, 4096

_rng = np.random.default_rng(5)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=U64)
_FOLD = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=U64) * U64(2) + U64(1)


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """Distinct shingle hashes of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, U64), *shingle_hashes(text, size)]))


def set_hash(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes())


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a shingle set; a key tells its band."""
    least = np.full(len(_TIMES), np.iinfo(U64).max, U64)
    for at in range(0, len(own), BLOCK):
        np.minimum(least, (own[None, at : at + BLOCK] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return mix((mix(least).reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=U64))


def _texts(column: pa.Array):
    return (x.as_buffer().to_pybytes() for x in column.cast(pa.binary()))


def marks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (row, node, n, fp, keys) of rows (row, t)."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            sets, fps = [], []
            for t in _texts(batch.column(1)):
                blocks = list(shingle_hashes(t, size))
                sets.append(np.unique(np.concatenate([np.zeros(0, U64), *blocks])))
                fps.append(majority([sets[-1]]))  # of the set: rows of one node have one fingerprint
            node = np.fromiter(map(set_hash, sets), U64, len(sets)).view(np.int64)
            flat = np.concatenate([band_keys(s) for s in sets]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(fps, U64).view(np.int64)), keys], ["row", "node", "n", "fp", "keys"])

    return rows.mapInArrow(run, "row long, node long, n long, fp long, keys array<long>")


def near_fingerprints(spark: SparkSession, nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of (node, fp): each node with the least one of its fingerprint, and the least ones of near fingerprints."""
    least = cut(spark, nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(least, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = (least.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    near = near_links(least.select("fp"), radius)
    for x, end in zip("ab", ends):
        near = near.join(end, x)
    return same.union(near.select("first_a", "first_b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def node_sets(rows: DataFrame, size: int) -> DataFrame:
    """Rows (node, hashes) of rows (row, t)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, size) for t in _texts(batch.column(1))]
            node = np.fromiter(map(set_hash, sets), U64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes binary")


def verified(threshold: float):
    """For mapInArrow over rows (a, b, x, y) with the nodes' sets: the pairs that reach the threshold."""

    def reaches(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared >= threshold * (len(x) + len(y) - shared) - 1e-9

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            keep = pa.array([reaches(x.as_buffer(), y.as_buffer()) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return run


def crossing(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """The rows (node, n, root, key) whose key still joins several roots, with the key's number of nodes."""
    keys = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high")
    return cut(spark, keyed.join(keys.select("key", "size"), "key"), "crossing")


def _pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    sizes = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
    return pairs.filter("root <> top").filter(sizes).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def hub_pairs(live: DataFrame, threshold: float) -> DataFrame:
    """Each node with the hub of its key: the node whose keys are shared most, an original among its variants."""
    drawn = live.groupBy("node").agg(F.sum("size").alias("drawn"))
    rank = F.struct("drawn", (-F.col("node")).alias("first"))
    hubs = live.join(drawn, "node").groupBy("key").agg(F.max_by(F.struct("node", "n", "root"), rank).alias("h")).select("key", "h.*").toDF("key", "other", "m", "top")
    return _pairs(live.join(hubs, "key"), threshold)


def small_pairs(live: DataFrame, threshold: float) -> DataFrame:
    """All pairs of the keys of at most CROWD nodes."""
    few = live.filter(F.col("size") <= CROWD)
    return _pairs(few.join(few.select("key", "node", "n", "root").toDF("key", "other", "m", "top"), "key").filter("root < top"), threshold)


def block_links(threshold: float):
    """For applyInArrow over (node, root, hashes) of two blocks of a key: a spanning forest of the links between roots."""

    def run(table: pa.Table) -> pa.Table:
        node, root = (table.column(c).to_numpy() for c in ("node", "root"))
        sets = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets])
        flat, column, times = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_inverse=True, return_counts=True)
        row, often = np.repeat(np.arange(len(sets)), size), np.cumsum(times > 1) - 1
        keep = times[column] > 1
        row, column = row[keep], often[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int((times > 1).sum()), COLUMNS):  # exact: whole numbers far below 2 ** 24
            own = slice(*np.searchsorted(column, (at, at + COLUMNS)))
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[row[own], column[own] - at] = 1
            shared += part @ part.T
        near = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
        near &= root[:, None] != root[None, :]
        a, b, left = [], [], np.arange(len(sets))
        while len(left):
            frontier, left = left[:1], left[1:]
            while len(frontier) and len(left):
                some = near[np.ix_(left, frontier)]
                hit = some.any(axis=1)
                a.append(frontier[some[hit].argmax(axis=1)])
                b.append(left[hit])
                frontier, left = left[hit], left[~hit]
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b))
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return run


def crowd_links(live: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links within the keys of over CROWD nodes, which are dealt to blocks; a task has two blocks and returns no pair but links."""
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    dealt = live.filter(F.col("size") > CROWD).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    both = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root").join(sets, "node")
    return both.groupBy("key", "i", "j").applyInArrow(block_links(threshold), "a long, b long")


def resemblance_components(spark: SparkSession, rows: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """Rows (row, component) for rows (row, text): linked are rows whose resemblance reaches the threshold.

    The first round takes the pairs of near fingerprints, the second joins each node with the hub
    of each of its keys; by then most of a large group is one component. The third compares what
    shares a key and is not in one component yet: by pairs where the key has at most CROWD nodes,
    and within tasks of two blocks where it has more.
    """
    rows = rows.select("row", text_of().alias("t"))
    marked = cut(spark, marks(rows, size), "resemblance")
    nodes = marked.groupBy("node").agg(F.min_by("keys", "row").alias("keys"), F.max("n").alias("n"), F.min("fp").alias("fp"), F.min("row").alias("row"))
    nodes, edges, roots = cut(spark, nodes, "nodes"), None, None
    for kind in ("fingerprints", "hubs", "all"):
        if kind == "fingerprints":
            found = near_fingerprints(spark, nodes.select("node", "fp"), radius)
        else:
            rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            live = crossing(spark, rooted.select("node", "n", "root", F.explode("keys").alias("key")))
            found = hub_pairs(live, threshold) if kind == "hubs" else small_pairs(live, threshold)
        pairs = cut(spark, found, "candidates")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
        if kind == "all":
            wanted = wanted.union(live.filter(F.col("size") > CROWD).select("node"))
        first = nodes.join(wanted.distinct(), "node", "left_semi").select("row")
        sets = cut(spark, node_sets(rows.join(first, "row", "left_semi").select("row", "t"), size), "sets")
        x, y = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("a", "x"), ("b", "y")))
        linked = cut(spark, pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verified(threshold), "a long, b long"), "links")
        if kind == "all":
            linked = linked.union(cut(spark, crowd_links(live, sets, threshold), "crowds"))
        edges = linked if edges is None else edges.union(linked)
        roots = components(spark, edges)
    return marked.join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("component"))
