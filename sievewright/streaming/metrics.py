"""Structured Streaming forms of the metric stream: moments, ticks, held means, controller, gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def moments(stream: DataFrame, name: str, value: str) -> DataFrame:
    """Count, sum and sum of squares by name: partial sums merge across tasks and batches."""
    v = F.col(value)
    out = stream.filter(v.isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    mean = F.col("s") / F.col("n")
    return out.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))))


def ticks(stream: DataFrame, name: str, value: str, time: str, width: str = "1 day", late: str = "2 days", names: str = ".*") -> DataFrame:
    """Moments by name and tumbling tick; names are filtered by a full match, late rows by a watermark."""
    rows = stream.filter(F.rlike(F.col(name), F.lit(f"^(?:{names})$"))).withWatermark(time, late)
    v = F.col(value)
    return rows.groupBy(F.window(time, width).alias("tick"), name).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def _in_order(parts: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    rows = [p for p in parts if len(p)]
    return pd.concat(rows).sort_values(order, kind="stable") if rows else pd.DataFrame()


def held_mean(stream: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """Running mean of a name; a report without a value leaves the last mean as it is."""

    def step(key, parts, state: GroupState):
        n, s = state.get if state.exists else (0, 0.0)
        out = []
        for r in _in_order(parts, order).itertuples(index=False):
            x = getattr(r, value)
            if x is not None and x == x:
                n, s = n + 1, s + float(x)
            out.append((key[0], getattr(r, order), n, s / n if n else None))
        state.update((n, s))
        yield pd.DataFrame(out, columns=["name", "at", "n", "mean"])

    return stream.groupBy(name).applyInPandasWithState(step, "name string, at long, n long, mean double", "n long, s double", "append", GroupStateTimeout.NoTimeout)


def controller(stream: DataFrame, name: str, value: str, order: str, target: float, step_size: float) -> DataFrame:
    """p moves by ``step_size`` towards the target at every report and stays at 0 or more."""

    def step(key, parts, state: GroupState):
        (p,) = state.get if state.exists else (0.0,)
        out = []
        for r in _in_order(parts, order).itertuples(index=False):
            gap = float(getattr(r, value)) - target
            p = max(0.0, p + ((gap > 0) - (gap < 0)) * step_size)
            out.append((key[0], getattr(r, order), p))
        state.update((p,))
        yield pd.DataFrame(out, columns=["name", "at", "p"])

    return stream.groupBy(name).applyInPandasWithState(step, "name string, at long, p double", "p double", "append", GroupStateTimeout.NoTimeout)


def greedy_gate(stream: DataFrame, group: str, limit: int, target: int) -> DataFrame:
    """Candidates (group, id, quality_ok, hash) in order of id: kept, or the first reason against; with a column m2_ok outliers too.

    The state of a group is the hashes it kept, at most ``target`` of them.
    """
    import numpy as np

    outliers = "m2_ok" in stream.columns

    def step(key, parts, state: GroupState):
        kept = np.array(state.get[0] if state.exists else [], np.int64)
        out = []
        for r in _in_order(parts, "id").itertuples(index=False):
            if len(kept) >= target:
                decision = "not reached"
            elif not r.quality_ok:
                decision = "quality"
            elif outliers and not r.m2_ok:
                decision = "outlier"
            elif (np.bitwise_count((kept ^ np.int64(r.hash)).view(np.uint64)) <= limit).any():
                decision = "self duplicate"
            else:
                kept = np.append(kept, np.int64(r.hash))
                decision = "kept"
            out.append((key[0], r.id, decision))
        state.update((kept.tolist(),))
        yield pd.DataFrame(out, columns=["combo", "id", "decision"])

    return stream.groupBy(group).applyInPandasWithState(step, "combo int, id long, decision string", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, user: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of a user's events; an addition to the metric stream."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), user).agg(F.count(F.lit(1)).alias("n"))
