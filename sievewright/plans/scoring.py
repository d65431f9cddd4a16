"""Confusion matrices, F1 variants, AUROC, seed summaries, checkpoints, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import wilson
from ..operators import checkpoint, metrics
from ..session import table
from .inputs import CHECKPOINTS, PREDICTIONS, checkpoints, predictions
from .register import Register

REGISTER = query = Register()
_SQUARE = "square AS (SELECT a.i::INT AS y_true, b.i::INT AS y_pred FROM range(4) a(i), range(4) b(i))"
_MATRIX = f"""{PREDICTIONS}, {_SQUARE}, runs2 AS (SELECT DISTINCT condition, seed FROM predictions),
matrix AS (SELECT condition, seed, y_true, y_pred, coalesce(n, 0) AS n FROM runs2 CROSS JOIN square LEFT JOIN (SELECT condition, seed, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL) c USING (condition, seed, y_true, y_pred))"""
_SCORES = f"""{_MATRIX}, scores AS (SELECT condition, seed, label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted,
    coalesce(2 * sum(tp) / nullif(sum(support) + sum(predicted), 0), 0)::DOUBLE AS f1, sum(tp)::DOUBLE / nullif(sum(support), 0) AS recall
    FROM (SELECT condition, seed, y_true AS label, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM matrix UNION ALL SELECT condition, seed, y_pred, 0, 0, n FROM matrix) GROUP BY 1, 2, 3)"""
RUN = ["condition", "seed"]


def _labels(spark):
    return spark.range(4).select(F.col("id").cast("int").alias("label"))


def _matrix(spark, sf):
    return metrics.confusion(predictions(spark, sf), F.broadcast(_labels(spark)), RUN)


@query(f"WITH {_MATRIX} SELECT * FROM matrix")
def confusion_counts(spark, sf):
    return _matrix(spark, sf)


@query(f"WITH {_MATRIX} SELECT condition, y_true, y_pred, round(sum(n) / count(DISTINCT seed), 6)::DOUBLE AS mean_n FROM matrix GROUP BY 1, 2, 3")
def confusion_mean(spark, sf):
    return _matrix(spark, sf).groupBy("condition", "y_true", "y_pred").agg(F.round(F.sum("n") / F.count_distinct("seed"), 6).alias("mean_n"))


@query(f"WITH {_MATRIX} SELECT condition, seed, y_true, y_pred, round(coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY condition, seed, y_true), 0), 0), 6) AS share FROM matrix")
def confusion_normalised(spark, sf):
    return metrics.normalised(_matrix(spark, sf), RUN).select(*RUN, "y_true", "y_pred", F.round("share", 6).alias("share"))


@query(f"WITH {PREDICTIONS} SELECT condition, seed, round(avg((y_true = y_pred)::INT), 6) AS accuracy, count(*) AS n FROM predictions GROUP BY 1, 2")
def accuracy(spark, sf):
    return predictions(spark, sf).groupBy(*RUN).agg(F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SCORES} SELECT condition, seed, label, round(f1, 6) AS f1, support::BIGINT AS support FROM scores")
def class_f1(spark, sf):
    return metrics.class_scores(_matrix(spark, sf), RUN).select(*RUN, "label", F.round("f1", 6).alias("f1"), "support")


def _averages(spark, sf, observed):
    out = metrics.averaged(metrics.class_scores(_matrix(spark, sf), RUN), observed, RUN)
    return out.select(*RUN, *[F.round(c, 6).alias(c) for c in ("macro_f1", "weighted_f1", "balanced_accuracy")])


_AVERAGE = "SELECT condition, seed, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall), 6) AS balanced_accuracy FROM scores {where} GROUP BY 1, 2"


@query(f"WITH {_SCORES} " + _AVERAGE.format(where="WHERE support + predicted > 0"))
def macro_f1_observed(spark, sf):
    return _averages(spark, sf, True)


@query(f"WITH {_SCORES} " + _AVERAGE.format(where=""))
def macro_f1_fixed(spark, sf):
    return _averages(spark, sf, False)


@query(f"WITH {PREDICTIONS}, a AS (SELECT condition, seed, avg((y_true = y_pred)::INT) AS accuracy FROM predictions GROUP BY 1, 2) SELECT condition, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, count(*) AS n_seeds FROM a GROUP BY 1")
def seed_summary(spark, sf):
    runs = predictions(spark, sf).groupBy(*RUN).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))
    return metrics.over_seeds(runs, ["condition"], F.col("accuracy")).select("condition", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_seeds")


@query(
    """WITH r AS (SELECT l.quality, l.toxic, length(d.text) AS s, rank() OVER (PARTITION BY l.toxic ORDER BY length(d.text)) + (count(*) OVER (PARTITION BY l.toxic, length(d.text)) - 1) / 2 AS rk FROM labels l JOIN documents d USING (doc_id))
    SELECT toxic, round((sum(rk) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / nullif(sum(quality) * sum(1 - quality), 0), 6)::DOUBLE AS auroc FROM r GROUP BY 1"""
)
def auroc(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("score")), "doc_id")
    return metrics.auroc(rows, "score", "quality", ["toxic"]).select("toxic", F.round("auroc", 6).alias("auroc"))


@query("WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round(least(avg(n) OVER () / greatest(n, 1), 5), 6)::DOUBLE AS weight FROM c")
def class_weights(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.class_weights(counts).withColumn("weight", F.round("weight", 6))


@query("SELECT label, round(avg(x), 6) AS mean, round(greatest(stddev_samp(x), 1e-8), 6) AS std FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 3 = 0) GROUP BY 1")
def channel_stats(spark, sf):
    x = table(spark, sf, "embeddings").filter("vec_id % 3 = 0").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return x.groupBy("label").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.greatest(F.stddev_samp("x"), F.lit(1e-8)), 6).alias("std"))


_TIER = "CASE WHEN fid >= 0 AND fid < 30 THEN 0 WHEN fid >= 30 AND fid < 50 THEN 1 WHEN fid >= 50 AND fid < 75 THEN 2 ELSE 3 END"
_THREE = f"""{CHECKPOINTS}, t AS (SELECT *, {_TIER} AS tier_rank, round(0.5 * coalesce(precision, 0) + 0.5 * coalesce(recall, 0), 9) AS score FROM checkpoints),
b AS (SELECT * FROM t QUALIFY tier_rank = min(tier_rank) OVER (PARTITION BY model)),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS ns, lead(recall) OVER w AS nr, lead(kimg) OVER w AS nk, lead(fid) OVER w AS nf FROM b WINDOW w AS (PARTITION BY model ORDER BY score DESC, kimg)),
picked AS (SELECT model, CASE WHEN s THEN nk ELSE kimg END AS kimg, CASE WHEN s THEN nf ELSE fid END AS fid, CASE WHEN s THEN ns ELSE score END AS score, ['EXTRAORDINARY', 'EXCELLENT', 'GOOD', 'FAIR'][tier_rank + 1] AS tier, s AS by_recall
    FROM (SELECT *, coalesce(round(score - ns, 9) <= 0.005 AND nr > recall, false) AS s FROM r WHERE rn = 1))"""


@query(f"WITH {_THREE} SELECT * FROM picked")
def checkpoint_three_stage(spark, sf):
    return checkpoint.three_stage(checkpoints(spark, sf))


@query(f"WITH {CHECKPOINTS} SELECT model, kimg, fid FROM checkpoints QUALIFY row_number() OVER (PARTITION BY model ORDER BY fid, kimg) = 1")
def checkpoint_pure_fid(spark, sf):
    return checkpoint.pure_fid(checkpoints(spark, sf))


@query(f"WITH {_THREE}, f AS (SELECT model, kimg AS fid_kimg FROM checkpoints QUALIFY row_number() OVER (PARTITION BY model ORDER BY fid, kimg) = 1) SELECT model, kimg, fid_kimg, kimg = fid_kimg AS agree FROM picked JOIN f USING (model)")
def checkpoint_disagreement(spark, sf):
    f = checkpoint.pure_fid(checkpoints(spark, sf)).select("model", F.col("kimg").alias("fid_kimg"))
    return checkpoint.three_stage(checkpoints(spark, sf)).join(f, "model").select("model", "kimg", "fid_kimg", F.col("kimg").eqNullSafe(F.col("fid_kimg")).alias("agree"))


@query(f"WITH {CHECKPOINTS} SELECT model, ['EXTRAORDINARY', 'EXCELLENT', 'GOOD', 'FAIR'][{_TIER} + 1] AS tier, count(*) AS n FROM checkpoints GROUP BY 1, 2")
def tier_distribution(spark, sf):
    tier = checkpoint.tier_name(checkpoint.tier_rank(F.col("fid")))
    return checkpoints(spark, sf).groupBy("model", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, k, n, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM (SELECT event_type, count(*) FILTER (value > 50)::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1)")
def wilson_ci(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rows.select("event_type", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("WITH p AS (SELECT vec_id, label, split, i, e[i]::DOUBLE AS p FROM (SELECT vec_id, label, vec_id % 5 AS split, list_transform(embedding::DOUBLE[], lambda x: exp(x) / list_sum(list_transform(embedding::DOUBLE[], lambda y: exp(y)))) AS e FROM embeddings), range(1, 65) t(i)), m AS (SELECT split, i, avg(p) AS q FROM p GROUP BY 1, 2), k AS (SELECT p.split, p.vec_id, sum(p * (ln(p) - ln(q))) AS kl FROM p JOIN m ON p.split = m.split AND p.i = m.i GROUP BY 1, 2), s AS (SELECT split, exp(avg(kl)) AS score FROM k GROUP BY 1) SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s")
def inception_score(spark, sf):
    """exp of the mean KL divergence of rows from their split's mean distribution, over five splits."""
    from ..functions.scalars import let

    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.exp(x))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    dist = let(e, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("split"), F.posexplode(dist).alias("i", "p"))
    q = rows.groupBy("split", "i").agg(F.avg("p").alias("q"))
    kl = rows.join(q, ["split", "i"]).groupBy("split", "vec_id").agg(F.sum(F.col("p") * (F.log("p") - F.log("q"))).alias("kl"))
    return kl.groupBy("split").agg(F.exp(F.avg("kl")).alias("score")).agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"))


@query("SELECT round(10 * log10(count(*) / sum(l_discount * l_discount)), 6) AS psnr FROM lineitem")
def psnr(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(10 * F.log10(F.count(F.lit(1)) / F.sum(F.col("l_discount") * F.col("l_discount"))), 6).alias("psnr"))
