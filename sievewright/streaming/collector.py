"""The metric collector as a stream: what was reported since the last tick, or what the last tick with reports left.

Reports of a name add to the open counters of their tick (count, sum, sum of squares). When the watermark has
passed a tick's end, a timer turns its counters into the visible averages and drops them; a tick without reports repeats the
last ones, as a collector does that keeps previous averages. State is the open ticks of a name, bounded by the
watermark's delay, and one row of averages, in values and maps of the state store, so a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Named states and timers are column families, which Spark's default store does not have.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TICKS = "name string, tick long, num long, mean double, std double, fresh boolean"


def averages(n: int, s: float, ss: float) -> tuple[int, float, float]:
    """Count, mean and population deviation, clamped at 0; a single value deviates by 0."""
    mean = s / n
    return n, mean, 0.0 if n == 1 else float(np.sqrt(max(ss / n - mean * mean, 0.0)))


class Collector(StatefulProcessor):
    """Ticks of ``width`` milliseconds."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "tick long", "n long, s double, ss double")
        self.held = handle.getValueState("held", "tick long, num long, mean double, std double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        met: dict[int, tuple[int, float, float]] = {}  # of this call, so that a tick's state is read once and not for every part
        for part in rows:
            value = part["value"].astype(float)
            for tick, v in value[value.notna()].groupby(part["at"] // self.width):
                n, s, ss = met.get(int(tick), (0, 0.0, 0.0))
                met[int(tick)] = (int(n + len(v)), float(s + v.sum()), float(ss + (v * v).sum()))
        first = not self.held.exists()
        for tick, own in met.items():
            n, s, ss = self.open.getValue((tick,)) if self.open.containsKey((tick,)) else (0, 0.0, 0.0)
            self.open.updateValue((tick,), (n + own[0], s + own[1], ss + own[2]))
            if first:
                self.handle.registerTimer((tick + 1) * self.width)
        yield pd.DataFrame(columns=["name", "tick", "num", "mean", "std", "fresh"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, out = timerValues.getCurrentWatermarkInMs() // self.width, []
        last = self.held.get() if self.held.exists() else None
        tick = expiredTimerInfo.getExpiryTimeInMs() // self.width - 1
        if last is not None:
            tick = max(tick, last[0] + 1) if tick > last[0] else until
        while tick < until:
            if self.open.containsKey((tick,)):
                last = (tick, *averages(*self.open.getValue((tick,))))
                self.open.removeKey((tick,))
                out.append((key[0], *last, True))
            elif last is not None:
                last = (tick, *last[1:])
                out.append((key[0], *last, False))
            tick += 1
        if out:
            self.held.update(tuple(last))
            self.handle.registerTimer((until + 1) * self.width)
        yield pd.DataFrame(out, columns=["name", "tick", "num", "mean", "std", "fresh"])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in ``PROVIDER``; the session's own setting is there again afterwards."""
    key, value = PROVIDER
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def collected(stream: DataFrame, name: str, value: str, time: str, width_ms: int = 86_400_000, late: str = "2 days", names: str = ".*") -> DataFrame:
    """Rows as ``TICKS`` says for every closed tick of every name whose whole name matches; to be started inside ``state_store``."""
    rows = stream.filter(F.rlike(F.col(name), F.lit(f"^(?:{names})$"))).withWatermark(time, late)
    slim = rows.select(F.col(name).alias("name"), F.col(value).cast("double").alias("value"), F.col(time).alias("time"), F.unix_millis(F.col(time)).alias("at"))
    return slim.groupBy("name").transformWithStateInPandas(statefulProcessor=Collector(width_ms), outputStructType=TICKS, outputMode="Append", timeMode="EventTime")
