"""Selection of checkpoints: tiers by FID, composite score, recall tie-break, plain minimum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tier names with the half-open FID ranges that define them.
TIERS = (("EXTRAORDINARY", 0.0, 30.0), ("EXCELLENT", 30.0, 50.0), ("GOOD", 50.0, 75.0))
LAST_TIER = "FAIR"
RECALL_GAP = 0.005


def tier_rank(fid: Column) -> Column:
    out = None
    for k, (_, low, high) in enumerate(TIERS):
        hit = (fid >= low) & (fid < high)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(len(TIERS))


def tier_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(t[0]) for t in TIERS], F.lit(LAST_TIER)), rank)


def three_stage(df: DataFrame, model: str = "model") -> DataFrame:
    """Best tier, then composite score of precision and recall; the second takes over within
    RECALL_GAP of the first if its recall is strictly greater. Only the two best are compared."""
    tier = df.withColumn("tier_rank", tier_rank(F.col("fid")))
    best = tier.withColumn("_b", F.min("tier_rank").over(Window.partitionBy(model))).filter("tier_rank = _b").drop("_b")
    score = F.round(0.5 * F.coalesce("precision", F.lit(0.0)) + 0.5 * F.coalesce("recall", F.lit(0.0)), 9)
    ranked = best.withColumn("score", score)
    w = Window.partitionBy(model).orderBy(F.desc("score"), "kimg")
    ahead = {c: F.lead(c).over(w) for c in ("score", "recall", "kimg", "fid")}
    rows = ranked.select("*", F.row_number().over(w).alias("rn"), *[v.alias(f"next_{c}") for c, v in ahead.items()]).filter("rn = 1")
    swap = (F.round(F.col("score") - F.col("next_score"), 9) <= RECALL_GAP) & (F.col("next_recall") > F.col("recall"))
    pick = lambda c: F.when(F.coalesce(swap, F.lit(False)), F.col(f"next_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(model, pick("kimg"), pick("fid"), pick("score"), tier_name(F.col("tier_rank")).alias("tier"), F.coalesce(swap, F.lit(False)).alias("by_recall"))


def pure_fid(df: DataFrame, model: str = "model") -> DataFrame:
    return df.groupBy(model).agg(F.min(F.struct("fid", "kimg")).alias("m")).select(model, "m.kimg", "m.fid")
