"""Paired resampling tests, step-down correction and intervals.

Resampling is a join of iterations with per-case sums, not with predictions: seeds collapse to
one row a case first, and each iteration weighs or flips cases by a seeded integer mixing, so
the result does not depend on partitions and SQL repeats it exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import bootstrap_means, swapped_sums


def holm(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p-values in column ``p_holm``; one window a family of comparisons."""
    family = Window.partitionBy(*(by or [F.lit(0)]))
    order = family.orderBy(p)
    m = F.count(F.lit(1)).over(family)
    raw = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def case_differences(base: DataFrame, other: DataFrame) -> DataFrame:
    """Per case: seeds, and the sum over seeds of (other correct - base correct). Truths must agree."""
    pair = base.select("seed", "case_id", F.col("y_true").alias("t"), F.col("y_pred").alias("a")).join(
        other.select("seed", "case_id", F.col("y_true").alias("u"), F.col("y_pred").alias("b")), ["seed", "case_id"]
    )
    ok = F.when(F.col("t") == F.col("u"), F.lit(True)).otherwise(F.raise_error(F.lit("truths differ between paired runs")).cast("boolean"))
    delta = (F.col("b") == F.col("t")).cast("int") - (F.col("a") == F.col("t")).cast("int")
    return pair.filter(ok).groupBy("case_id").agg(F.sum(delta).alias("diff"), F.count(F.lit(1)).alias("n"))


def permutation_p(cases: DataFrame, count: int, seed: int) -> DataFrame:
    """Two-sided permutation p: signs of whole cases are flipped; (k + 1) / (n + 1)."""
    seen = abs(cases.agg(F.sum("diff")).first()[0] or 0)
    return swapped_sums(cases, count, seed).agg(((F.count_if(F.abs("m") >= seen) + 1) / (count + 1)).alias("p_value"))


def bootstrap_ci(cases: DataFrame, count: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean difference; cases are drawn with replacement by their place."""
    means = bootstrap_means(cases, count, seed)
    low = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(low)).alias("ci_low"), F.percentile("m", F.lit(1 - low)).alias("ci_high"))


def sign_flip(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact two-sided paired sign-flip p over the 2**n sign patterns of each group's n values (n <= 20)."""
    w = Window.partitionBy(*by).orderBy("seed")
    rows = df.withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    rows = rows.filter(F.when(F.col("n") > 20, F.raise_error(F.lit("more than 20 values have too many sign patterns")).cast("boolean")).otherwise(True))
    patterns = rows.withColumn("pattern", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("n").cast("int")) - 1)))
    bit = F.call_function("shiftright", F.col("pattern"), F.col("k").cast("int")).bitwiseAND(F.lit(1))
    sums = patterns.groupBy(*by, "pattern").agg(F.round(F.sum(F.col(value) * (1 - 2 * bit)), 9).alias("s"))
    seen = df.groupBy(*by).agg(F.round(F.sum(value), 9).alias("seen"))
    return sums.join(seen, by).groupBy(*by).agg(F.avg((F.abs("s") >= F.abs("seen")).cast("double")).alias("p_value"))


def paired_t(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Paired t statistic, degrees of freedom, and p of the one-sided test of a mean above 0."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    out = out.withColumn("t", F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)))
    return out.withColumn("p_one_sided", student_upper(F.col("t"), F.col("n") - 1))


def student_upper(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t with integer degrees of freedom, as a finite sum of built-in functions."""
    theta = F.atan(t / F.sqrt(df))
    cos2 = F.pow(F.cos(theta), 2)
    odd = df % 2 == 1
    steps = F.when(df > 1, F.sequence(F.lit(1), F.greatest(F.floor((df - 1) / 2), F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    even_steps = F.when(df > 2, F.sequence(F.lit(1), F.greatest(F.floor((df - 2) / 2), F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = lambda: F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    odd_sum = F.aggregate(steps, start(), lambda a, k: F.struct((a["term"] * F.when(k == 1, F.lit(1.0)).otherwise((2.0 * k - 2) / (2 * k - 1) * cos2)).alias("term"), (a["sum"] + a["term"] * F.when(k == 1, F.lit(1.0)).otherwise((2.0 * k - 2) / (2 * k - 1) * cos2)).alias("sum")), lambda a: a["sum"])
    even_sum = F.aggregate(even_steps, start(), lambda a, k: F.struct((a["term"] * (2.0 * k - 1) / (2 * k) * cos2).alias("term"), (a["sum"] + a["term"] * (2.0 * k - 1) / (2 * k) * cos2).alias("sum")), lambda a: a["sum"])
    central = F.when(odd, 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * odd_sum)).otherwise(F.sin(theta) * (1 + even_sum))
    return (1 - central) / 2


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p of k successes in n fair draws, null for null: terms follow one another by a ratio, from the largest down.

    The sum ends where a term no longer counts, so a row costs some ten steps for each unit of the square root of n.
    """
    k, n = (F.col(x) if isinstance(x, str) else x for x in (k, n))
    low = F.least(k, n - k)
    steps = F.least(low, F.ceil(12 * F.sqrt(n.cast("double")) + 50).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    down = F.when(steps > 0, F.sequence(F.lit(0).cast("long"), F.greatest(steps - 1, F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * (low - i) / (n - low + i + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.aggregate(down, start, add, lambda a: a["sum"])
    p = 2 * F.exp(log_choose(n, low) - n * math.log(2)) * tail
    return F.when(k.isNotNull() & n.isNotNull(), F.when(2 * low >= n - 1, 1.0).otherwise(F.least(F.lit(1.0), p)))


def log_factorial(n: Column) -> Column:
    """log n!: by Stirling's series with terms enough for double precision from 10 on, by the products below."""
    x = F.greatest(n, F.lit(10)).cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < 10, F.log(F.factorial(F.least(n, F.lit(10)).cast("int")).cast("double"))).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)
