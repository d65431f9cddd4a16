"""Exact top-k by inner product with a forest of M-trees.

Inner products become distances when every vector x gets one more coordinate, sqrt(M - |x|^2) with
M the largest squared norm, and every query a zero: |q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest
are those of highest score. In that metric the vectors are indexed by M-trees. A node is a page:
a leaf page holds vectors and their distances to the page's routing vector, an inner page holds child
pages with their routing vectors, covering radii and distances to its own routing vector. Pages are
rows of a table in the shared folder; a tree has at most ``TREE`` vectors.

A query goes through the pages best first. A page or entry whose stored distance to its parent already
proves, by the triangle inequality, that it lies beyond the k-th best is passed over before its own
distance is computed; next its covering radius is looked at. Bounds are strict, so that equal scores
remain and the smaller vec_id decides; scores are whole numbers computed exactly.

Equal vectors share one entry that keeps the k + 1 smallest ids (one may be the query itself): no other
can be in a result, so a vector of any number of copies is reduced where it is read. Vectors are dealt
to trees by the nearest of at most ``PIVOTS`` pivots from a bounded sample; a pivot with more than a tree
holds gets several, by hash. The sample also gives every query a first bound. Queries travel in blocks to
those pivots' trees that the bound lets in, and the best of each tree are merged by query; no task holds
more than a tree and a block.

Defined results: null vectors, vectors with null or non-finite components and rows of null vec_id
take no part; a vector shorter than others counts as followed by zeros; of rows that repeat, a
query leaves out one row of its id, itself, and each query row has its own result; components whose integer exceeds
2^26 in size take no part; no other row, no result; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .centroids import IN_FLOAT, whole_vectors
from .common import cut

#: Vectors of a tree, of a leaf page, children of an inner page, queries of a block.
TREE, LEAF, FANOUT, BLOCK = 16_384, 128, 16, 1024
#: Queries that go through one copy of a tree, in one task.
SLICE = 1 << 20
#: Vectors that pivots and first bounds are taken from, and pivots at most.
SAMPLE, PIVOTS = 4096, 1024
SLACK = 1e-7
PAGES = "tree long, page int, inner boolean, pivot binary, vectors binary, radii array<double>, away array<double>, child array<int>, ids array<array<long>>"


def _dots(x: np.ndarray, q: np.ndarray, light: bool) -> np.ndarray:
    """Inner products as int64; float64 is exact below ``IN_FLOAT``."""
    return (x.astype(float) @ q.astype(float).T).astype(np.int64) if light else x @ q.T


def _last(x: np.ndarray, most: int) -> np.ndarray:
    """The added coordinate."""
    f = x.astype(float)
    return np.sqrt(np.maximum(most - np.einsum("ij,ij->i", f, f), 0))


def _gaps(x: np.ndarray, last: np.ndarray, y: np.ndarray, y_last: float | np.ndarray) -> np.ndarray:
    """Distances of rows to one vector, or each to its own, in the metric with the added coordinate."""
    d = x.astype(float) - y
    return np.sqrt(np.einsum("ij,ij->i", d, d) + (last - y_last) ** 2)


def build(x: np.ndarray, last: np.ndarray) -> list[dict]:
    """Pages of one tree over distinct vectors, the root first; entries of leaves are rows of ``x``."""
    pages: list[dict] = []

    def middle(rows: np.ndarray) -> int:
        centre = x[rows].mean(axis=0)
        return int(rows[_gaps(x[rows], last[rows], centre, last[rows].mean()).argmin()])

    def grow(rows: np.ndarray, pivot: int) -> int:
        at, away = len(pages), _gaps(x[rows], last[rows], x[pivot], last[pivot])
        pages.append({"pivot": pivot})
        if len(rows) <= LEAF:
            pages[at] |= {"inner": False, "entries": rows, "away": away, "radii": np.zeros(len(rows)), "child": []}
            return at
        parts = [p for p in divide(rows) if len(p)]
        pivots = [middle(p) for p in parts]
        children = [grow(p, v) for p, v in zip(parts, pivots)]
        radii = [float(_gaps(x[p], last[p], x[v], last[v]).max()) for p, v in zip(parts, pivots)]
        pages[at] |= {"inner": True, "entries": np.array(pivots), "away": _gaps(x[pivots], last[pivots], x[pivot], last[pivot]), "radii": np.array(radii), "child": children}
        return at

    def divide(rows: np.ndarray) -> list[np.ndarray]:
        """By the nearest of seeds that are chosen far from each other among some rows; evenly where that does not divide."""
        n = min(FANOUT, -(-len(rows) // LEAF))
        some = rows[:: max(1, len(rows) // (64 * n))]
        seeds, near = [], np.full(len(some), np.inf)
        for _ in range(n):
            seeds.append(int(some[near.argmax()]))
            near = np.minimum(near, _gaps(x[some], last[some], x[seeds[-1]], last[seeds[-1]]))
        own = np.stack([_gaps(x[rows], last[rows], x[s], last[s]) for s in seeds]).argmin(axis=0)
        if np.bincount(own, minlength=n).max() > 0.9 * len(rows):
            return np.array_split(rows[np.argsort(own, kind="stable")], n)
        return [rows[own == s] for s in range(n)]

    rows = np.arange(len(x))
    grow(rows, middle(rows))
    return pages


class Tree:
    """A tree read back from its pages."""

    def __init__(self, pages: list[dict], size: int, most: int):
        self.most, self.pages, biggest = most, {}, 0
        for p in pages:
            v = np.frombuffer(p["vectors"], np.int64).reshape(-1, size)
            biggest = max(biggest, int(np.abs(v).max(initial=0)))
            own = {"x": v, "away": np.array(p["away"]), "radii": np.array(p["radii"]), "child": p["child"], "inner": p["inner"], "ids": p["ids"]}
            self.pages[p["page"]] = own
            if p["page"] == 0:
                self.pivot = np.frombuffer(p["pivot"], np.int64)
        self.light = biggest <= IN_FLOAT
        for p in self.pages.values():
            p["f"] = p["x"].astype(float) if self.light else p["x"]

    def search(self, q: np.ndarray, k: int, bound: float) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (-score, id) of at least ``bound``, and how many scores were computed."""
        light = self.light and int(np.abs(q).max(initial=0)) <= IN_FLOAT
        f = q.astype(float) if light else q
        square = float((q.astype(float) ** 2).sum()) + self.most
        computed = 1

        def gap(score) -> float:
            return np.sqrt(np.maximum(square - 2.0 * np.asarray(score, float), 0))

        best: list[tuple[int, int]] = []  # heap, the worst of the k first: (score, -id)
        wide = SLACK * (1 + np.sqrt(square))  # rounding of distances
        limit = gap(bound) + wide if np.isfinite(bound) else np.inf
        heap = [(0.0, 0, float(gap(int(self.pivot @ q))))]
        while heap:
            least, at, parent = heapq.heappop(heap)
            if least > limit:
                break
            page = self.pages[at]
            near = np.flatnonzero(np.abs(parent - page["away"]) - page["radii"] <= limit)
            if not len(near):
                continue
            computed += len(near)
            scores = ((page["f"] if light else page["x"])[near] @ f).astype(np.int64)
            if page["inner"]:
                gaps = gap(scores)
                low = np.maximum(gaps - page["radii"][near], 0)
                for j in np.flatnonzero(low <= limit):
                    heapq.heappush(heap, (float(low[j]), page["child"][near[j]], float(gaps[j])))
                continue
            floor = best[0][0] if len(best) == k else bound
            for j in np.flatnonzero(scores >= floor):
                score = int(scores[j])
                for i in page["ids"][near[j]]:
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                    else:
                        break
            if len(best) == k:
                limit = min(limit, gap(best[0][0]) + wide)
        return [(-s, -i) for s, i in best], computed


def _nearest(x: np.ndarray, last: np.ndarray, pivots: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """The pivot nearest to each row: all have the same norm with the added coordinate, so it has the largest product."""
    return (x.astype(float) @ pivots.astype(float).T + np.outer(last, lasts)).argmax(axis=1).astype(np.int32)


def _place(pivots: np.ndarray, lasts: np.ndarray, size: int, most: int):
    """For mapInArrow over (x, ids): each vector's nearest pivot and its distance."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = _matrix(batch.column(0), size)
            last = _last(x, most)
            own = np.concatenate([np.empty(0, np.int32), *[_nearest(x[at : at + 2048], last[at : at + 2048], pivots, lasts) for at in range(0, len(x), 2048)]])
            best = _gaps(x, last, pivots[own], lasts[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(best)], ["x", "ids", "pivot", "gap"])

    return run


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _paged(size: int, most: int):
    """For mapInArrow over (tree, x, ids) sorted by tree: the pages of each tree."""

    def run(batches: Iterator[pa.RecordBatch]):
        for tree, rows in _groups(batches):
            x = np.concatenate([_matrix(r.column(1), size) for r in rows])
            ids = [i for r in rows for i in r.column(2).to_pylist()]
            out = []
            for n, p in enumerate(build(x, _last(x, most))):
                e = p["entries"]
                out.append({
                    "tree": tree, "page": n, "inner": p["inner"], "pivot": x[p["pivot"]].tobytes(), "vectors": x[e].tobytes(), "radii": p["radii"].tolist(),
                    "away": p["away"].tolist(), "child": list(p["child"]), "ids": [] if p["inner"] else [ids[i] for i in e],
                })
            kind = pa.schema([("tree", pa.int64()), ("page", pa.int32()), ("inner", pa.bool_()), ("pivot", pa.binary()), ("vectors", pa.binary()), ("radii", pa.list_(pa.float64())), ("away", pa.list_(pa.float64())), ("child", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int64())))])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of equal first column, as slices of the batches."""
    now, held = None, []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if s == e:
                continue
            if held and key[s] != now:
                yield now, held
                held = []
            now = int(key[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield now, held


def _searched(size: int, most: int, k: int):
    """For mapInArrow over a tree's pages, then its blocks of queries: (q, score, vec_id)."""

    def run(batches: Iterator[pa.RecordBatch]):
        tree, pages, name = None, [], None
        for batch in batches:
            for row in range(len(batch)):
                of, block = (batch.column("tree")[row].as_py(), batch.column("slice")[row].as_py()), batch.column("block")[row].as_py()
                if of != name:
                    name, tree, pages = of, None, []
                if block < 0:
                    pages.append(batch.slice(row, 1).to_pylist()[0]["node"])
                    continue
                if tree is None and not pages:
                    continue  # a tree that no vector's hash named
                if tree is None:
                    tree, pages = Tree(pages, size, most), []
                sent = batch.column("queries")[row]
                numbers, x, bounds = (np.frombuffer(sent[c].as_py(), t) for c, t in (("numbers", np.int64), ("x", np.int64), ("bounds", np.float64)))
                out: list[tuple[int, int, int]] = []
                for q, v, bound in zip(numbers.tolist(), x.reshape(-1, size), bounds):
                    out.extend((q, -s, i) for s, i in tree.search(v, k, bound)[0])
                c = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in c], ["q", "score", "vec_id"])

    return run


def _blocked(sample: np.ndarray, pivots: np.ndarray, radii: np.ndarray, size: int, most: int, k: int):
    """For mapInArrow over (q, x): blocks of queries with their first bounds, one for each pivot that the bounds let in."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                numbers, x = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(some.column(1), size)
                light = max(np.abs(x).max(initial=0), np.abs(sample).max(initial=0)) <= IN_FLOAT
                scores = _dots(x, sample, light)
                bounds = np.full(len(x), -np.inf)
                if len(sample) >= k:
                    bounds[:] = np.partition(scores, -k, axis=1)[:, -k]
                square = (x.astype(float) ** 2).sum(axis=1) + most
                reach = np.where(np.isfinite(bounds), np.sqrt(np.maximum(square - 2 * bounds, 0)) + SLACK * (1 + np.sqrt(square)), np.inf)
                for p in range(len(pivots)):
                    gaps = np.sqrt(np.maximum(square - 2 * (x.astype(float) @ pivots[p].astype(float)), 0))
                    if len(of := np.flatnonzero(gaps - radii[p] - SLACK * (1 + gaps) <= reach)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p], pa.int32()), pa.array([numbers[of].min()]), pa.array([numbers[of].tobytes()], pa.binary()), pa.array([x[of].tobytes()], pa.binary()), pa.array([bounds[of].tobytes()], pa.binary())],
                            ["pivot", "block", "numbers", "x", "bounds"],
                        )

    return run


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """Rows (x, ids): distinct vectors with their ``k`` smallest ids; ranks are cut before the shuffle."""
    w = Window.partitionBy("h", "x").orderBy("vec_id")
    least = vectors.select("vec_id", "x", F.xxhash64("x").alias("h")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return least.groupBy("h", "x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).drop("h")


def _least(classes: DataFrame, n: int) -> list:
    """The SAMPLE rows of least hash. Each task sends its own least ones, so hashes are first cut where some twice SAMPLE of all ``n`` rows lie below."""
    h, share = F.xxhash64("x"), 2 * SAMPLE / max(1, n)
    while True:
        below = classes if share >= 0.5 else classes.filter(h < F.lit(int(share * (1 << 64)) - (1 << 63)))
        some = below.orderBy(h, "x").limit(SAMPLE).select("x").collect()  # SAMPLE rows at most
        if len(some) == SAMPLE or share >= 0.5:
            return some
        share *= 4


def index(spark: SparkSession, classes: DataFrame, size: int, most: int, tree: int = TREE) -> tuple[DataFrame, DataFrame, dict]:
    """Pages, trees (tree, pivot) and what queries need to start: sample, pivots, radii, and the names of the trees of column ``pivot``."""
    n = classes.count()
    some = _least(classes, n)
    sample = np.array([r["x"] for r in some], np.int64).reshape(len(some), size)
    wanted, last = min(PIVOTS, -(-n // max(1, tree // 2))), _last(sample, most)
    chosen, near = [0], _gaps(sample, last, sample[0], last[0])
    while len(chosen) < min(wanted, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _gaps(sample, last, sample[chosen[-1]], last[chosen[-1]]))
    pivots, lasts = sample[chosen], last[chosen]
    placed = cut(spark, classes.mapInArrow(_place(pivots, lasts, size, most), "x array<long>, ids array<long>, pivot int, gap double"), "placed")
    counts = {r["pivot"]: (r["n"], r["far"]) for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("far")).collect()}  # PIVOTS rows
    several = F.element_at(F.create_map(*[F.lit(v) for p, (c, _) in counts.items() for v in (p, -(-c // tree))]), F.col("pivot"))
    first = F.col("pivot").cast("long") * (1 << 40)
    name = (first + F.pmod(F.xxhash64("x"), several)).alias("tree")
    dealt = placed.select(name, "x", "ids").repartition("tree").sortWithinPartitions("tree")
    pages = cut(spark, dealt.mapInArrow(_paged(size, most), PAGES), "pages")
    start = {"sample": sample, "pivots": pivots, "radii": np.array([counts.get(p, (0, -np.inf))[1] for p in range(len(pivots))])}
    start["names"] = F.transform(F.sequence(F.lit(0), several - 1), lambda i: first + i)
    return pages, pages.filter("page = 0").select("tree", F.floor(F.col("tree") / (1 << 40)).cast("int").alias("pivot")), start


def top_scores(spark: SparkSession, embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, tree: int = TREE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of all other rows for each row whose vec_id is divisible by ``every``."""
    out = "query_id long, rank int, vec_id long, score long"
    vectors = whole_vectors(embeddings.filter(F.col("vec_id").isNotNull()), scale)
    seen = vectors.agg(F.max(F.size("x")).alias("size"), F.max(F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)).alias("most")).first()
    if seen["most"] is None:
        return spark.createDataFrame([], out)
    size, most = max(1, seen["size"]), seen["most"]
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x")))
    vectors = vectors.select("vec_id", padded.alias("x"))
    classes = cut(spark, _distinct(vectors, k + 1), "classes")
    pages, _, start = index(spark, classes, size, most, tree)
    names = start.pop("names")

    asked = cut(spark, vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "x"), "queries")
    queries = cut(spark, asked.select("x").distinct().select("x", F.monotonically_increasing_id().alias("q")), "asked")
    blocks = queries.select("q", "x").mapInArrow(_blocked(**start, size=size, most=most, k=k + 1), "pivot int, block long, numbers binary, x binary, bounds binary")
    node = F.struct(*[c.split()[0] for c in PAGES.split(", ") if c.split()[0] != "tree"]).alias("node")
    slices = max(1, -(-queries.count() // SLICE))
    part = F.pmod("block", F.lit(slices)).cast("int").alias("slice")
    # trees are named, not joined: a planner that takes blocks for as small as the queries' file would send all of them to the driver
    sent = blocks.select(F.explode(names).alias("tree"), part, "block", F.struct("numbers", "x", "bounds").alias("queries"), F.lit(0).alias("page"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    rows = pages.select("tree", copies, F.lit(-1).cast("long").alias("block"), "page", node).unionByName(sent, allowMissingColumns=True)
    rows = rows.repartition("tree", "slice").sortWithinPartitions("tree", "slice", "block", "page").select("tree", "slice", "block", "node", "queries")
    found = rows.mapInArrow(_searched(size, most, k + 1), "q long, score long, vec_id long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = cut(spark, found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1), "found")

    named = asked.hint("merge").join(queries, "x").select(F.col("vec_id").alias("query_id"), "q")
    return _ranked(named, found, k)


def _ranked(named: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Each query row's own result: without one row of its own id, at most ``k``."""
    lists = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))  # k + 1 entries
    own = F.coalesce(F.array_position(F.transform("found", lambda f: f["vec_id"]), F.col("query_id")), F.lit(0))
    rest = F.slice(F.filter("found", lambda f, i: i + 1 != own), 1, k)
    each = named.hint("merge").join(lists, "q").select("query_id", F.posexplode(rest).alias("i", "f"))
    return each.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "f.vec_id", (-F.col("f.s")).alias("score"))


def oracle_sql(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    return f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, v.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score FROM v q JOIN v ON v.row <> q.row WHERE q.vec_id % {every} = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
