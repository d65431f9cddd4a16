"""Deterministic samples: a seeded integer mixing of the id ranks rows, in Spark and in SQL alike.

Ranks within a stratum come from ranges of (stratum, rank) and their counts, so a stratum of any size spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_even, hash_rank, mix32
from ..shared import ordinals


def _ranked(df: DataFrame, by: list[str], seed: int, id_col: str) -> DataFrame:
    """Column _r: the seeded rank from 1 within ``by``."""
    rows = ordinals(df.withColumn("_h", hash_rank(seed, F.col(id_col))), ["_h", id_col], "_place", by)
    return rows.withColumn("_r", F.col("_place") + 1).drop("_h", "_place")


def with_counts(df: DataFrame, by: list[str], **counts: Column) -> DataFrame:
    """Aggregates of each group beside its rows; a null is a group."""
    sums = df.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()]).select(*[F.col(b).alias(f"_by_{b}") for b in by], *counts)
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return df.join(sums, on).drop(*[f"_by_{b}" for b in by])


def balanced(df: DataFrame, stratum: list[str], source: str, sources: list[str], seed: int, id_col: str) -> DataFrame:
    """As many rows of each source within a stratum as its rarest source has; strata that lack one are left out."""
    ranked = _ranked(df.filter(F.col(source).isin(sources)), [*stratum, source], seed, id_col)
    counts = {f"_n{i}": F.count_if(F.col(source) == x) for i, x in enumerate(sources)}
    quota = F.least(*counts) if len(counts) > 1 else F.col("_n0")
    return with_counts(ranked, stratum, **counts).filter(F.col("_r") <= quota).drop("_r", *counts)


def fixed(df: DataFrame, stratum: list[str], n: int, seed: int, id_col: str, strict: bool = False) -> DataFrame:
    """n rows of each stratum; with ``strict`` a stratum with less is an error."""
    rows = _ranked(df, stratum, seed, id_col)
    if strict:
        rows = with_counts(rows, stratum, _n=F.count(F.lit(1)))
        rows = rows.filter(F.when(F.col("_n") >= n, True).otherwise(F.raise_error(F.lit("a stratum is short")).cast("boolean"))).drop("_n")
    return rows.filter(F.col("_r") <= n).drop("_r")


def split(df: DataFrame, stratum: list[str], shares: list[tuple[str, float]], seed: int, id_col: str) -> DataFrame:
    """Column ``split`` by seeded rank within strata: cumulative half-even shares of each stratum."""
    rows = with_counts(_ranked(df, stratum, seed, id_col), stratum, _n=F.count(F.lit(1)))
    share, case = 0.0, None
    for name, part in shares[:-1]:
        share += part
        hit = F.col("_r") <= half_even(F.col("_n") * F.lit(share))
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return rows.withColumn("split", case.otherwise(shares[-1][0])).drop("_r", "_n")


def ratio_prefix(df: DataFrame, combo: str, source: str, real: str, ratio: float, order: str) -> DataFrame:
    """All real rows of a combo and the first round(ratio * real) others in order; halves go to even."""
    rows = with_counts(ordinals(df, [order], "_place", [combo, source]), [combo], _n=F.count_if(F.col(source) == real))
    return rows.filter((F.col(source) == real) | (F.col("_place") < half_even(F.col("_n") * F.lit(ratio)))).drop("_n", "_place")


def draws(steps: DataFrame, pool: DataFrame, quota: str, seed: int, id_col: str) -> DataFrame:
    """Rows (step, draw, id_col) drawn with replacement: ``quota`` rows of the pool for each step of ``steps`` (step, quota).

    Draw k of a step takes the place that the mix of (seed, step, k) names; draws meet the pool by place.
    """
    placed = ordinals(pool.select(id_col), [id_col], "_place")
    n = placed.count()
    each = steps.filter(F.col(quota) > 0).select("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col(quota).cast("long") - 1)).alias("draw"))
    named = each.withColumn("_place", mix32(seed, F.col("step"), F.col("draw")) % max(n, 1))
    return named.join(placed, "_place").select("step", "draw", id_col)


def with_stratum(df: DataFrame, levels: list[list[str]], least: int) -> DataFrame:
    """Column ``stratum``: the finest of the given strata that has ``least`` rows, by name; ``all`` where none has. No group is gathered."""
    rows, case = df, None
    for i, columns in enumerate(levels):
        rows = with_counts(rows, columns, **{f"_n{i}": F.count(F.lit(1))})
        hit, name = F.col(f"_n{i}") >= least, F.concat_ws("/", *columns)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return rows.withColumn("stratum", case.otherwise("all")).drop(*[f"_n{i}" for i in range(len(levels))])


def round_robin(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Columns shard, place and wrapped: rows dealt in turn, the shards filled up to one size with the first rows again."""
    placed = ordinals(df, order, "place")
    n = placed.count()
    over = -n % shards if n else 0
    rows = placed.withColumn("wrapped", F.lit(False))
    for turn in range(-(-over // n) if n else 0):  # one, unless there are fewer rows than shards
        again = placed.filter(F.col("place") < over - turn * n).withColumn("place", F.col("place") + (turn + 1) * n)
        rows = rows.unionByName(again.withColumn("wrapped", F.lit(True)))
    return rows.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("place", F.floor(F.col("place") / shards))


def label_grid(df: DataFrame, label: str, order: str, columns: int, rows: int) -> DataFrame:
    """Rows (row, column, ...) of a grid with one label a row, labels in turn; the label's rows go on where it was last shown."""
    placed = ordinals(df, [order], "_place", [label])
    labels = ordinals(df.select(label).distinct(), [label], "_k")
    n = labels.count()
    if not n:
        return df.withColumn("row", F.lit(0)).withColumn("column", F.lit(0)).limit(0)
    cells = with_counts(placed.join(labels, label), [label], _n=F.count(F.lit(1)))
    turns = F.floor((F.lit(rows) - 1 - F.col("_k")) / n)
    shown = cells.filter(F.col("_k") < rows).withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), turns)))
    slots = F.filter(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: (F.col("_turn") * columns + c) % F.col("_n") == F.col("_place"))
    each = shown.withColumn("column", F.explode(slots)).withColumn("row", (F.col("_turn") * n + F.col("_k")).cast("int"))
    return each.select(*df.columns, "row", "column")
