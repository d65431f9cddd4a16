"""Scores of predictions: confusion, F1, balanced accuracy, AUROC, summaries over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(preds: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts over the whole square of labels, 0 where none."""
    by = by or []
    square = labels.select(F.col("label").alias("y_true")).crossJoin(labels.select(F.col("label").alias("y_pred")))
    domain = preds.select(*by).distinct().crossJoin(square) if by else square
    counted = preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counted, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def normalised(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of a confusion matrix as shares; rows of zeros stay 0."""
    total = F.sum("n").over(Window.partitionBy(*(by or []), "y_true"))
    return matrix.withColumn("share", F.coalesce(F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)))


def class_scores(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F1, recall and support of each label from a full confusion matrix; F1 is 0 where undefined."""
    by = by or []
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = matrix.select(*by, F.explode(F.array(F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    both = F.col("support") + F.col("predicted")
    return sums.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(both, F.lit(0)), F.lit(0.0))).withColumn("recall", F.col("tp") / F.nullif(F.col("support"), F.lit(0)))


def averaged(scores: DataFrame, observed: bool, by: list[str] | None = None) -> DataFrame:
    """Macro and weighted F1, over all labels or over those that occur in truth or prediction."""
    rows = scores.filter("support + predicted > 0") if observed else scores
    weighted = F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    return rows.groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"), F.avg("recall").alias("balanced_accuracy"))


def auroc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Mann-Whitney AUROC with mean ranks for ties; null if a class is missing.

    Ranks come from counts by distinct score, so that ties never meet in one window row by row.
    """
    counts = df.groupBy(*by, score).agg(F.sum(F.col(label)).alias("pos"), F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2)
    total = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"))
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("m"), F.lit(0))
    return total.select(*by, area.alias("auroc"))


def class_weights(counts: DataFrame, cap: float = 5.0) -> DataFrame:
    """Mean count over own count, at most ``cap``."""
    mean = F.avg("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("weight", F.least(mean / F.greatest("n", F.lit(1)), F.lit(cap)))


def over_seeds(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Mean, sample deviation and number of seeds."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n_seeds"))
