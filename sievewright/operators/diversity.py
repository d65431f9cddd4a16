"""Farthest-point order of large groups, several picks a pass.

The order starts at the point nearest to the origin; each next point is the one farthest from all that are
taken, the smaller id first, until a distance is exactly 0. Every row keeps its least distance to the
taken ones, which only falls. In a pass each task names, for each group, the rows of largest least distance and the
largest it does not name. The driver goes on choosing among the named rows, whose distances it
updates itself, as long as the best of them exceeds what any unnamed row can have; then the next pass
updates all rows by the points chosen. A prefix of the order is the choice of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import kept

#: Rows that a task names for each group.
NAMED = 64
STATE = "combo int, id long, x binary, near double"


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_pylist()


def _updated(taken: dict[int, np.ndarray]):
    """For mapInArrow over ``STATE``: least distances after the points ``taken`` of each group."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            combo, _, raw = _rows(batch)
            near = batch.column(3).to_numpy(zero_copy_only=False).copy()
            for c in np.unique(combo):
                if int(c) not in taken:
                    continue
                of = np.flatnonzero(combo == c)
                x = np.frombuffer(b"".join(raw[i] for i in of)).reshape(len(of), -1)
                for p in taken[int(c)]:
                    near[of] = np.minimum(near[of], _lengths(x - p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near)], ["combo", "id", "x", "near"])

    return run


def _named(most: int):
    """For mapInArrow over ``STATE``: of each group the ``most`` rows of largest near, and the largest of the rest as a row of null id."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list[tuple[float, int, bytes]]] = {}
        rest: dict[int, float] = {}
        for batch in batches:
            combo, ids, raw = _rows(batch)
            near = batch.column(3).to_numpy(zero_copy_only=False)
            for c in np.unique(combo):
                of = np.flatnonzero(combo == c)
                of = of[np.lexsort((ids[of], -near[of]))]
                rows = held.get(int(c), []) + [(-float(near[i]), int(ids[i]), raw[i]) for i in of[: most + 1]]
                rows.sort(key=lambda r: r[:2])
                if len(rows) > most:
                    rest[int(c)] = max(rest.get(int(c), 0.0), -rows[most][0])
                held[int(c)] = rows[:most]
        out = [(c, i, x, -d) for c, rows in held.items() for d, i, x in rows] + [(c, None, None, d) for c, d in rest.items()]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.float64()))], ["combo", "id", "x", "near"])

    return run


def chosen(rows: list[tuple[int, bytes, float]], bound: float, most: int) -> tuple[list[int], list[np.ndarray], bool]:
    """Picks among named (id, x, near), while none can be farther than ``bound``; whether the order ends here."""
    ids = np.array([r[0] for r in rows])
    x, near = np.stack([np.frombuffer(r[1]) for r in rows]), np.array([r[2] for r in rows])
    order = np.argsort(ids)
    ids, x, near = ids[order], x[order], near[order]
    taken, points = [], []
    while len(taken) < most:
        j = int(near.argmax())
        if near[j] == 0:
            return taken, points, bound == 0 or not taken
        if taken and near[j] <= bound:
            break
        taken.append(int(ids[j]))
        points.append(x[j])
        near = np.minimum(near, _lengths(x - x[j]))
    return taken, points, len(taken) >= most


def farthest_order(points: DataFrame, targets: dict[int, int], named: int | None = None) -> list[tuple[int, int, int]]:
    """(combo, id, rank) of the first ``targets[combo]`` points of each group, from rows (combo, id, x) with packed float64 x.

    What reaches the driver in a pass is ``named`` rows for each task and group.
    """
    named = named or NAMED
    packed = points.select(F.col("combo").cast("int").alias("combo"), "id", "x")

    def squares(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            d = [float((np.frombuffer(v) ** 2).sum()) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.sqrt(np.array(d)), pa.float64())], ["combo", "id", "x", "near"])

    state = kept(packed.mapInArrow(squares, STATE), "points")
    first = state.groupBy("combo").agg(F.min(F.struct("near", "id", "x")).alias("m")).select("combo", "m.*").collect()
    out = [(r["combo"], r["id"], 1) for r in first if targets.get(r["combo"], 0) > 0]
    taken = {r["combo"]: [np.frombuffer(r["x"])] for r in first if targets.get(r["combo"], 0) > 1}
    done = {r["combo"]: 1 for r in first}
    state = state.withColumn("near", F.lit(float("inf")))
    while taken:
        groups = list(taken)
        state = kept(state.filter(F.col("combo").isin(groups)).mapInArrow(_updated({c: np.stack(p) for c, p in taken.items()}), STATE), "points")
        found: dict[int, list] = {c: [] for c in groups}
        bound = dict.fromkeys(groups, 0.0)
        for r in state.mapInArrow(_named(named), STATE).collect():
            if r["id"] is None:
                bound[r["combo"]] = max(bound[r["combo"]], r["near"])
            else:
                found[r["combo"]].append((r["id"], bytes(r["x"]), r["near"]))
        taken = {}
        for c in groups:
            ids, points_, over = chosen(found[c], bound[c], targets[c] - done[c])
            out += [(c, i, done[c] + n + 1) for n, i in enumerate(ids)]
            done[c] += len(ids)
            if not over:
                taken[c] = points_
    return out
