"""Gates, diversity selection and distances between sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import diversity, forest, selection
from ..session import table
from ..shared import kept, ordinals
from .inputs import HAMMING, VECTORS, hashes, vectors
from .register import Register

REGISTER = query = Register()
#: As in the reference: subsets and their size at most, trees and seeds.
KID_SUBSETS, KID_SIZE = 100, 1000
RF_TREES, RF_SEEDS = 500, 10
#: Generated rows for each real one.
RATIOS = [0.5, 1.0, 2.5]


def _gated(spark, sf):
    return selection.gate(vectors(spark, sf).select(F.col("combo").cast("int").alias("combo"), "id", "is_real", F.col("embedding").cast("array<double>").alias("vector")))


@query(name="mahalanobis_gate")
def mahalanobis_gate(spark, sf):
    g = _gated(spark, sf)
    return g.select("combo", "id", F.round("m2", 4).alias("m2"), F.round("threshold", 4).alias("threshold"), "kept")


@query(name="fps_rank")
def fps_rank(spark, sf):
    """Survivors of the gate in farthest-point order, as many as the largest ratio takes."""
    return selection.ranked(kept(_gated(spark, sf), "gated"), RATIOS).select("combo", "id", "fps_rank")


@query(name="ratio_sets")
def ratio_sets(spark, sf):
    """The survivors that each ratio takes: nested prefixes of one order."""
    return selection.ratio_sets(selection.ranked(kept(_gated(spark, sf), "gated"), RATIOS), RATIOS)


_FPS = f"""WITH RECURSIVE {VECTORS}, v AS (SELECT combo, id, e FROM vectors WHERE NOT is_real),
r AS (SELECT combo, 1 AS fps_rank, arg_min(id, (list_dot_product(e, e), id)) AS id, [arg_min(id, (list_dot_product(e, e), id))] AS taken FROM v GROUP BY combo
UNION ALL SELECT r.combo, r.fps_rank + 1, f.id, list_append(r.taken, f.id) FROM r, LATERAL (SELECT id FROM (
    SELECT a.id, min(list_distance(a.e, b.e)) AS near FROM v a JOIN v b ON b.combo = a.combo WHERE a.combo = r.combo AND list_contains(r.taken, b.id) GROUP BY a.id) WHERE near > 0 ORDER BY near DESC, id LIMIT 1) f WHERE r.fps_rank < 12)
SELECT combo, id, fps_rank FROM r"""


@query(_FPS)
def fps_order(spark, sf):
    """The first twelve generated vectors of each group in farthest-point order, from the one nearest to the origin."""
    v = vectors(spark, sf).filter("not is_real").select("combo", "id", selection.packed(F.col("embedding")).alias("x"))
    groups = {r["combo"]: 12 for r in v.select("combo").distinct().collect()}
    return spark.createDataFrame(diversity.farthest_order(v, groups), "combo int, id long, fps_rank int")


@query(f"""WITH {VECTORS}, n AS (SELECT combo, count(*) FILTER (is_real) AS n_real, count(*) FILTER (NOT is_real) AS n_synth FROM vectors GROUP BY 1)
SELECT combo, ratio, round_even(ratio * n_real, 0)::BIGINT AS n_target, n_synth, least(round_even(ratio * n_real, 0), n_synth)::BIGINT AS n_kept FROM n, (VALUES {", ".join(f"({r}::DOUBLE)" for r in (0.5, 1.0, 2.5))}) t(ratio)""")
def ratio_quotas(spark, sf):
    """What each ratio asks for and gets without a gate: counts of the nested prefixes."""
    v = vectors(spark, sf)
    n = v.groupBy("combo").agg(F.count_if("is_real").alias("n_real"), F.count_if(~F.col("is_real")).alias("n_synth"))
    order = ordinals(v.filter("not is_real").select("combo", "id"), ["id"], "place", ["combo"]).withColumn("fps_rank", F.col("place") + 1)
    got = selection.ratio_sets(order.join(n, "combo"), RATIOS).groupBy("combo", "ratio").agg(F.count(F.lit(1)).alias("n_kept"))
    asked = n.select("*", F.explode(F.array(*[F.lit(r) for r in RATIOS])).alias("ratio")).withColumn("n_target", half_even(F.col("ratio") * F.col("n_real")))
    return asked.join(got, ["combo", "ratio"], "left").select("combo", "ratio", "n_target", "n_synth", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query(name="filter_funnel")
def filter_funnel(spark, sf):
    """The filter of each group: sizes, threshold, medians and what each ratio keeps."""
    g = kept(_gated(spark, sf), "gated")
    took = selection.ratio_sets(selection.ranked(g, RATIOS), RATIOS).groupBy("combo").agg(*[F.count_if(F.col("ratio") == r).alias(f"kept_{str(r).replace('.', '_')}") for r in RATIOS])
    median = selection.exact_percentile(g, "combo", "m2", "id", 50).select("combo", F.round("threshold", 4).alias("median_m2_synth"))
    n, out = F.count(F.lit(1)), F.count_if(~F.col("kept"))
    sums = g.groupBy("combo").agg(F.max("n_real").alias("n_real"), n.alias("n_synth"), out.alias("n_rejected"), F.count_if("kept").alias("n_after"), F.round(F.max("threshold"), 4).alias("threshold"), F.round(100 * out / n, 2).alias("dropped_pct"))
    return sums.join(median, "combo").join(took, "combo", "left").na.fill(0, [c for c in took.columns if c != "combo"])


GREEDY = f"""WITH RECURSIVE {VECTORS}, near AS (SELECT a.id AS i, b.id AS j FROM hashes a JOIN hashes b ON a.combo = b.combo AND b.id < a.id AND {HAMMING} <= 22),
o AS (SELECT id, combo, row_number() OVER (PARTITION BY combo ORDER BY id) AS k FROM vectors),
r AS (SELECT combo, k, [id] AS kept, id, true AS keep FROM o WHERE k = 1 UNION ALL SELECT o.combo, o.k, CASE WHEN x.hit THEN r.kept ELSE list_append(r.kept, o.id) END, o.id, NOT x.hit
    FROM r JOIN o ON o.combo = r.combo AND o.k = r.k + 1, LATERAL (SELECT EXISTS (SELECT 1 FROM near WHERE near.i = o.id AND list_contains(r.kept, near.j)) AS hit) x)
SELECT combo, id, CASE WHEN keep THEN 'kept' ELSE 'self duplicate' END AS decision FROM r"""


def _candidates(spark, sf):
    return hashes(spark, sf).select(F.col("combo").cast("int").alias("combo"), "id", F.lit(True).alias("quality_ok"), F.lit(True).alias("m2_ok"), F.lit(False).alias("ref_near"), "hash")


@query(GREEDY)
def greedy_dedup(spark, sf):
    return selection.greedy_gate(_candidates(spark, sf), 22, 1 << 30)


@query(name="fid")
def fid(spark, sf):
    """Fréchet distance of real and generated vectors; two rows of sums reach the driver."""
    v = vectors(spark, sf).select(F.col("is_real").cast("int").alias("side"), F.col("embedding").cast("array<double>").alias("vector"))
    sums = {r["side"]: (r["n"], r["sums"]) for r in selection.moments(v, "vector", ["side"]).collect()}
    value = selection.frechet(sums[0], sums[1]) if len(sums) == 2 else None
    return spark.createDataFrame([(None if value is None else round(value, 4),)], "fid double")


@query(name="kid")
def kid(spark, sf):
    v = vectors(spark, sf).select("id", F.col("is_real").cast("int").alias("side"), F.col("embedding").cast("array<double>").alias("vector"))
    return selection.kernel_distance(v, KID_SUBSETS, KID_SIZE, 1).agg(F.round(F.avg("kid"), 6).alias("kid"))


@query(
    f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), w AS (SELECT vec_id, i, x * ([{", ".join(repr(v) for v in np.kaiser(64, 8).tolist())}])[i + 1] AS y FROM x),
    f AS (SELECT vec_id, k, sum(y * cos(2 * pi() * k * i / 64)) AS re, sum(y * sin(2 * pi() * k * i / 64)) AS im FROM w, range(33) t(k) GROUP BY 1, 2) SELECT k::INT AS k, round(avg(re * re + im * im), 6) AS power FROM f GROUP BY 1""",
    name="power_spectrum",
)
def power_spectrum(spark, sf):
    return selection.power_spectrum(table(spark, sf, "embeddings"), "embedding").select("k", F.round("power", 6).alias("power"))


#: Training sets: real rows, with more and more of the others, and all.
EXPERIMENTS = ["baseline", "r0.5", "r1", "r2.5", "augmented"]


def _grown(spark, sf):
    v = vectors(spark, sf)
    train = v.filter("not is_test").select("id", "is_real", F.col("combo").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"), "combo")
    n = train.groupBy("combo").agg(F.count_if("is_real").alias("n_real"))
    other = ordinals(train.filter("not is_real").select("combo", "id"), ["id"], "place", ["combo"])
    placed = kept(train.join(n, "combo").join(other, ["combo", "id"], "left"), "training")
    takes = [F.col("place") < half_even(F.col("n_real") * F.lit(r)) for r in RATIOS]
    sets = F.array(F.lit(0), *[F.when(F.col("is_real") | t, F.lit(e + 1)) for e, t in enumerate(takes)], F.lit(4))
    sets = F.when(F.col("is_real"), F.array(*[F.lit(e) for e in range(5)])).otherwise(F.filter(F.slice(sets, 2, 4), lambda e: e.isNotNull()))
    rows = placed.select(F.explode(sets).alias("experiment"), "id", "y", "x")
    test = v.filter("is_test").select("id", F.col("combo").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    classes = (v.agg(F.max("combo")).first()[0] or 0) + 1
    out = forest.scores(spark, rows, test, list(range(RF_SEEDS)), RF_TREES, classes)
    return out.withColumn("experiment", F.element_at(F.array(*[F.lit(e) for e in EXPERIMENTS]), F.col("experiment") + 1))


@query(name="forest_growth")
def forest_growth(spark, sf):
    """Forests of five training sets and ten seeds as they grow from 25 to 500 trees: out-of-bag and test scores."""
    f1 = F.transform("f1", lambda x: F.round(x, 6)).alias("f1")
    return _grown(spark, sf).select("experiment", "seed", "n_estimators", *[F.round(c, 6).alias(c) for c in ("oob_score", "test_accuracy", "test_macro_f1", "test_weighted_f1")], f1)


@query(name="rf_seed_scores")
def rf_seed_scores(spark, sf):
    """Accuracy of the whole forests on held-out vectors by seed and training set."""
    full = _grown(spark, sf).filter(F.col("n_estimators") == RF_TREES)
    return full.select(F.col("experiment").alias("condition"), "seed", F.round("test_accuracy", 6).alias("accuracy"))
