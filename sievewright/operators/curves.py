"""Learning curves: quantiles, intervals, smoothing, plateaus, patience, exposure."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact linear-interpolated quartiles and the count."""
    q = [F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return df.groupBy(*by).agg(*q, F.count(value).alias("n"))


def normal_interval(df: DataFrame, by: list[str], value: str, z: float = 1.96) -> DataFrame:
    """Mean, sample deviation (0 for one value) and z times the standard error."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))
    return out.withColumn("half_ci", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(z * F.col("sd") / F.sqrt("n")))


def box(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, Tukey whiskers (the outermost values within 1.5 interquartile ranges) and outliers."""
    q = quartiles(df, by, value)
    step = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - step) & (F.col(value) <= F.col("q3") + step)
    return df.join(q, by).groupBy(*by, "q1", "median", "q3", "n").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.avg(value).alias("mean"), F.sum((~inside).cast("int")).alias("outliers"),
        (student_975(F.count(value) - 1) * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half_ci"),
    )


def student_975(df: Column) -> Column:
    """The 97.5 % point of Student's t: halving of an interval in which its built-in tail falls through 2.5 %; null without a degree of freedom."""
    from .stats import student_upper

    low, high = F.lit(1.9), F.lit(12.8)
    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(48)), F.struct(low.alias("a"), high.alias("b")),
        lambda s, _: F.when(student_upper((s["a"] + s["b"]) / 2, df) > 0.025, F.struct(((s["a"] + s["b"]) / 2).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), ((s["a"] + s["b"]) / 2).alias("b"))),
    )
    return F.when(df >= 1, (span["a"] + span["b"]) / 2)


def moving_average(df: DataFrame, by: list[str], order: str, value: str, width: int = 15) -> DataFrame:
    """Centred mean over ``width`` rows with zeros beyond the ends; series shorter than that stay."""
    w, half = Window.partitionBy(*by), width // 2
    centred = F.sum(value).over(w.orderBy(order).rowsBetween(-half, half)) / width
    return df.withColumn("smoothed", F.when(F.count(F.lit(1)).over(w) < width, F.col(value)).otherwise(centred))


def plateau(df: DataFrame, by: list[str], order: str, value: str, back: int = 25, least: float = 0.01) -> DataFrame:
    """Last place that improved by more than ``least`` over ``back`` places before, else 60 % of the last."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.coalesce(F.lag(value, back).over(w), F.first(value).over(w))
    rows = df.withColumn("gain", (before - F.col(value)) / F.nullif(F.abs(before), F.lit(0.0))).withColumn("place", F.row_number().over(w))
    improved = F.max(F.when((F.col("gain") > least) & (F.col("place") > 1), F.col(order)))
    return rows.groupBy(*by).agg(F.coalesce(improved.cast("double"), 0.6 * F.max(order)).alias("plateau_at"))


def patience(df: DataFrame, by: list[str], order: str, loss: str) -> DataFrame:
    """Evaluations since the last strict improvement, and the best step so far."""
    w = Window.partitionBy(*by).orderBy(order)
    best_before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = best_before.isNull() | (F.col(loss) < best_before)
    rows = df.withColumn("place", F.row_number().over(w)).withColumn("better", better)
    last = F.max(F.when(F.col("better"), F.col("place"))).over(w)
    step = F.max(F.when(F.col("better"), F.col(order))).over(w)
    return rows.withColumn("waited", F.col("place") - last).withColumn("best_step", step).drop("place", "better")


def patience_with_margin(df: DataFrame, by: list[str], order: str, loss: str, margin: float, schema: str) -> DataFrame:
    """As ``patience``, where only a gain of ``margin`` counts; sequential within each series."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        best, waited, out = np.inf, 0, []
        for x in rows.sort_values(order)[loss]:
            better = x <= best - margin
            best, waited = (x, 0) if better else (best, waited + 1)
            out.append((waited, best))
        return rows.sort_values(order).assign(waited=[o[0] for o in out], best=[o[1] for o in out])

    return df.groupBy(*by).applyInPandas(of, schema)


def trimmed_mean(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Mean of the values between two order statistics (lower at ``low``, higher at ``high``), inclusive.

    The statistics come from counts by distinct value, so no window holds the rows themselves.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = kept(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "counts")
    parts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.sum("n").alias("n")).collect())  # one row a range
    total = sum(n for _, n in parts)
    if not total:
        return ranged.agg(F.avg(value).alias("trimmed_mean"), F.lit(0).cast("long").alias("n"))

    def statistic(rank: int):
        """The value at a rank: its range is known from the counts, and only that range is sorted."""
        before = 0
        for part, n in parts:
            if rank < before + n:
                upto = F.sum("n").over(Window.partitionBy("_part").orderBy(value)) + before
                return ranged.filter(F.col("_part") == part).withColumn("upto", upto).filter(F.col("upto") > rank).agg(F.min(value)).first()[0]
            before += n

    lo, hi = statistic(math.floor((total - 1) * low)), statistic(math.ceil((total - 1) * high))
    return ranged.filter(F.col(value).between(F.lit(lo), F.lit(hi))).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("trimmed_mean"), F.sum("n").alias("n"))


def exposure(df: DataFrame, by: list[str], order: str, seen: Column, size: int) -> DataFrame:
    """Cumulative examples seen and epochs of a set of ``size``."""
    total = F.sum(seen).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("examples_seen", total).withColumn("real_epoch", total / size)


def log_cubic(df: DataFrame, by: list[str], x: str, y: str, points: int, schema: str) -> DataFrame:
    """Cubic fit over log x, evaluated on ``points`` geometric places; x and y of each group only."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        u = np.log(rows[x].to_numpy(float))
        fit = np.polyfit(u - u.mean(), rows[y].to_numpy(float), min(3, len(u) - 1))
        grid = np.unique(np.round(np.geomspace(rows[x].min(), rows[x].max(), points)))
        return pd.DataFrame({**{b: rows[b].iloc[0] for b in by}, x: grid, "fitted": np.polyval(fit, np.log(grid) - u.mean())})

    return df.groupBy(*by).applyInPandas(of, schema)
