"""Named metrics, parts by dotted name, replaceable hooks, row transforms that may drop, and abort callbacks."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Metrics:
    """Metrics by name: functions of a DataFrame; those of columns are known to SQL too."""

    def __init__(self):
        self._made: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, f: Callable) -> Callable:
        if not callable(f) or f.__name__ in self._made:
            raise ValueError(f"{f!r} is not callable or its name is taken")
        self._made[f.__name__] = f
        return f

    def valid(self, name: str) -> bool:
        return name in self._made

    def names(self) -> list[str]:
        return sorted(self._made)

    def calc(self, name: str, df: DataFrame) -> DataFrame:
        if not self.valid(name):
            raise KeyError(f"unknown metric {name}; known are {', '.join(self.names())}")
        return self._made[name](df)

    def expose(self, spark: SparkSession, df: DataFrame, prefix: str = "metric_") -> list[str]:
        """Every metric of ``df`` as a view, for SQL."""
        for name in self.names():
            self.calc(name, df).createOrReplaceTempView(prefix + name)
        return [prefix + name for name in self.names()]


def by_name(dotted: str, *args, **kwargs):
    """What a dotted name stands for, called with the arguments if there are any."""
    module, _, name = dotted.rpartition(".")
    found = import_module(module)
    for part in name.split("."):
        found = getattr(found, part)
    return found(*args, **kwargs) if args or kwargs else found


class Hooks:
    """Steps of a procedure by name, of which a backend replaces some; unknown names are refused."""

    def __init__(self, **steps: Callable):
        self._steps = dict(steps)

    def with_(self, **steps: Callable) -> Hooks:
        if unknown := set(steps) - set(self._steps):
            raise KeyError(f"no such step: {', '.join(sorted(unknown))}")
        return Hooks(**{**self._steps, **steps})

    def __getattr__(self, name: str) -> Callable:
        try:
            return self.__dict__["_steps"][name]
        except KeyError:
            raise AttributeError(name) from None


def transformed(df: DataFrame, make: Callable[[], Callable[[dict], dict | None]], schema: str) -> DataFrame:
    """Rows through a transform that each task makes for itself; rows for which it returns None are dropped."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        each = make()
        for batch in batches:
            rows = [r for r in map(each, batch.to_pylist()) if r is not None]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return df.mapInArrow(run, schema)


class Watch(StreamingQueryListener):
    """Calls back with the rows of each batch of a stream, and stops the stream when asked to."""

    def __init__(self, spark: SparkSession, progress: Callable[[str, int], None], abort: Callable[[], bool] = lambda: False):
        self.spark, self.progress, self.abort = spark, progress, abort

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.progress(str(event.progress.id), event.progress.numInputRows)
        if self.abort() and (query := self.spark.streams.get(str(event.progress.id))):
            query.stop()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
