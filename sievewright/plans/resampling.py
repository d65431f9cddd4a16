"""Paired tests between conditions, with seeded hashes in place of a generator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_rank
from ..operators import resample, stats
from ..shared import kept
from .inputs import PREDICTIONS, predictions, sql_mix, sql_mix32
from .register import Register

REGISTER = query = Register()
#: As the reference's default.
ITERATIONS = 5000
#: First seed of the resampling tasks, and labels of the cases.
SEED, LABELS = 100, 4
_CASES = f"""{PREDICTIONS}, cases2 AS (SELECT case_id, sum((b.y_pred = b.y_true)::INT - (a.y_pred = a.y_true)::INT)::BIGINT AS diff, count(*) AS n
    FROM predictions a JOIN predictions b USING (seed, case_id) WHERE a.condition = 0 AND b.condition = 4 GROUP BY 1)"""
_SEEDS = f"""{PREDICTIONS}, deltas AS (SELECT b.condition, seed, round(avg((b.y_pred = b.y_true)::INT - (a.y_pred = a.y_true)::INT), 9) AS delta
    FROM predictions a JOIN predictions b USING (seed, case_id) WHERE a.condition = 0 AND b.condition > 0 GROUP BY 1, 2)"""


def _cases(spark, sf):
    p = predictions(spark, sf)
    return stats.case_differences(p.filter("condition = 0"), p.filter("condition = 4"))


def _deltas(spark, sf):
    p = predictions(spark, sf).withColumn("ok", (F.col("y_true") == F.col("y_pred")).cast("int"))
    base = p.filter("condition = 0").select("seed", "case_id", F.col("ok").alias("base"))
    return p.filter("condition > 0").join(base, ["seed", "case_id"]).groupBy("condition", "seed").agg(F.round(F.avg(F.col("ok") - F.col("base")), 9).alias("delta"))


@query(f"WITH {_CASES} SELECT * FROM cases2")
def paired_cases(spark, sf):
    return _cases(spark, sf)


@query(f"WITH {_CASES}, s AS (SELECT it, sum(diff * CASE WHEN {sql_mix32('5', 'it', 'case_id')} % 2 = 0 THEN 1 ELSE -1 END) AS s FROM cases2, range({ITERATIONS}) t(it) GROUP BY 1) SELECT round((sum((abs(s) >= abs((SELECT sum(diff) FROM cases2)))::INT) + 1) / {ITERATIONS + 1}, 6)::DOUBLE AS p_value FROM s")
def permutation_p(spark, sf):
    return stats.permutation_p(_cases(spark, sf), ITERATIONS, 5).select(F.round("p_value", 6).alias("p_value"))


@query(
    f"""WITH {_CASES}, placed AS (SELECT diff, n, row_number() OVER (ORDER BY case_id) - 1 AS place FROM cases2), size AS (SELECT count(*) AS m FROM cases2),
    draws AS (SELECT it, {sql_mix32('7', 'it', 'k')} % m AS place FROM range({ITERATIONS}) t(it), size, (SELECT place AS k FROM placed)),
    means AS (SELECT it, sum(diff) / sum(n) AS mean FROM draws JOIN placed USING (place) GROUP BY 1)
    SELECT round(quantile_cont(mean::DOUBLE, 0.025), 6) AS ci_low, round(quantile_cont(mean::DOUBLE, 0.975), 6) AS ci_high FROM means"""
)
def bootstrap_ci(spark, sf):
    return stats.bootstrap_ci(_cases(spark, sf), ITERATIONS, 7).select(F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query(f"WITH {_SEEDS} SELECT * FROM deltas")
def seed_deltas(spark, sf):
    return _deltas(spark, sf)


@query(
    f"""WITH {_SEEDS}, k AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY seed) - 1 AS k FROM deltas), s AS (SELECT condition, pattern, round(sum(delta * (1 - 2 * ((pattern >> k) & 1))), 9) AS s FROM k, range(1024) t(pattern) GROUP BY 1, 2),
    o AS (SELECT condition, round(sum(delta), 9) AS seen FROM deltas GROUP BY 1) SELECT condition, round(avg((abs(s) >= abs(seen))::INT), 6) AS p_value FROM s JOIN o USING (condition) GROUP BY 1"""
)
def sign_flip(spark, sf):
    return stats.sign_flip(_deltas(spark, sf), "delta", ["condition"]).select("condition", F.round("p_value", 6).alias("p_value"))


@query(f"WITH {_SEEDS} SELECT condition, round(avg(delta), 6) AS mean, count(*) AS n, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 4) AS t FROM deltas GROUP BY 1")
def paired_t(spark, sf):
    return stats.paired_t(_deltas(spark, sf), "delta", ["condition"]).select("condition", F.round("mean", 6).alias("mean"), "n", F.round("t", 4).alias("t"))


@query(
    f"""WITH {_SEEDS}, s AS (SELECT condition, atan(avg(delta) / (stddev_samp(delta) / sqrt(count(*))) / 3) AS a FROM deltas GROUP BY 1)
    SELECT condition, round((1 - 2 / pi() * (a + sin(a) * (cos(a) + cos(a) ** 3 * 2 / 3 + cos(a) ** 5 * 8 / 15 + cos(a) ** 7 * 16 / 35))) / 2, 6) AS p_value FROM s""",
    name="paired_t_p",
)
def paired_t_p(spark, sf):
    return stats.paired_t(_deltas(spark, sf), "delta", ["condition"]).select("condition", F.round("p_one_sided", 6).alias("p_value"))


_P = f"round(({sql_mix(3, 'n_nationkey')} % 1000) / 20000.0, 6)::DOUBLE"


@query(f"WITH p AS (SELECT n_regionkey AS family, n_nationkey AS id, {_P} AS p FROM nation), r AS (SELECT *, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p) + 1) * p) AS raw FROM p) SELECT family, id, round(max(raw) OVER (PARTITION BY family ORDER BY p), 6) AS p_holm FROM r")
def holm(spark, sf):
    from ..session import table

    p = table(spark, sf, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("id"), F.round(hash_rank(3, F.col("n_nationkey")) % 1000 / 20000.0, 6).alias("p"))
    return stats.holm(p, "p", ["family"]).select("family", "id", F.round("p_holm", 6).alias("p_holm"))


_TASKS = f"""conditions AS (SELECT condition, row_number() OVER (ORDER BY condition) - 1 AS i FROM (SELECT DISTINCT condition FROM predictions) WHERE condition > 0),
tasks AS (SELECT condition AS comparison, metric, {SEED} + 1000003 * i + 10007 * (metric + 1) AS seed FROM conditions, range(7) m(metric))"""


@query(f"WITH {PREDICTIONS}, {_TASKS} SELECT comparison, metric::INT AS metric, seed::BIGINT AS seed FROM tasks")
def resampling_tasks(spark, sf):
    """One row a task, with the seed of its resampling; the comparisons are the conditions that there are predictions of."""
    return _tasks(spark, predictions(spark, sf), ITERATIONS).select("comparison", "metric", "seed")


def _tasks(spark, p, iterations):
    conditions = sorted(r["condition"] for r in p.select("condition").distinct().collect())  # a handful
    return resample.tasks(spark, [c for c in conditions if c], 3 + LABELS, SEED, iterations)


def _resampled(spark, sf, iterations):
    p = predictions(spark, sf)
    conditions, seeds = (sorted(r[0] for r in p.select(c).distinct().collect()) for c in ("condition", "seed"))
    draws = resample.resampled(p, _tasks(spark, p, iterations), conditions, seeds, LABELS)
    out = resample.summary(kept(draws, "draws"))
    return out.select("comparison", "metric", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta", "ci_low", "ci_high", "p_raw", "p_holm")])


@query(name="resampled_metrics")
def resampled_metrics(spark, sf):
    """Seven metrics of four comparisons: interval, p and Holm's p, 5,000 bootstrap draws and swaps each."""
    return _resampled(spark, sf, ITERATIONS)


def _resampled_sql(n: int) -> str:
    f1 = "CASE WHEN said + truth > 0 THEN 2.0 * hit / (said + truth) ELSE 0 END"
    label = "range(4) l(c)"
    value = "CASE metric WHEN 0 THEN max(acc) WHEN 1 THEN avg(f1) WHEN 2 THEN sum(f1 * truth) / sum(truth) ELSE max(f1) FILTER (c = metric - 3) END"

    def metric(source: str, keys: str) -> str:
        """Mean over seeds of a task's metric from weighted rows (keys, side, seed, t, p, w)."""
        own = f"{keys}, comparison, metric, side"
        return f"""SELECT {own}, avg(v) AS v FROM (SELECT {own}, rseed, {value} AS v FROM (
        SELECT *, {f1} AS f1 FROM (SELECT {own}, rseed, c, sum(w * (t = c AND p = c)::INT) AS hit, sum(w * (p = c)::INT) AS said, sum(w * (t = c)::INT) AS truth, sum(w * (t = p)::INT) / sum(w) AS acc
        FROM {source}, {label} GROUP BY {own}, rseed, c)) GROUP BY {own}, rseed) GROUP BY {own}"""

    return f"""WITH {PREDICTIONS}, {_TASKS}, sides AS (SELECT k.comparison, k.metric, k.seed AS s, p.seed AS rseed, p.case_id, (p.condition > 0)::INT AS side, p.y_true AS t, p.y_pred AS p
    FROM tasks k JOIN predictions p ON p.condition IN (0, k.comparison)),
placed AS (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS place, count(*) OVER () AS m FROM (SELECT DISTINCT case_id FROM predictions)),
draws AS (SELECT comparison, metric, it, place, count(*) AS w FROM (SELECT comparison, metric, it, {sql_mix32('seed', 'it', 'k')} % m AS place FROM tasks, range({n}) i(it), (SELECT place AS k, m FROM placed)) GROUP BY comparison, metric, it, place),
boot_rows AS (SELECT x.comparison, x.metric, d.it, x.side, x.rseed, x.t, x.p, d.w FROM sides x JOIN placed USING (case_id) JOIN draws d ON d.comparison = x.comparison AND d.metric = x.metric AND d.place = placed.place),
boot AS ({metric("boot_rows", "it")}),
perm_rows AS (SELECT x.comparison, x.metric, it, CASE WHEN {sql_mix32('x.s', 'it', 'case_id')} % 2 = 1 THEN 1 - side ELSE side END AS side, rseed, t, p, 1 AS w FROM sides x, range({n}) i(it)),
perm AS ({metric("perm_rows", "it")}),
plain_rows AS (SELECT comparison, metric, 0 AS it, side, rseed, t, p, 1 AS w FROM sides), plain AS ({metric("plain_rows", "it")}),
seen AS (SELECT comparison, metric, max(v) FILTER (side = 1) AS mean_a, max(v) FILTER (side = 0) AS mean_b FROM plain GROUP BY comparison, metric),
b AS (SELECT comparison, metric, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high FROM (SELECT comparison, metric, it, (max(v) FILTER (side = 1) - max(v) FILTER (side = 0))::DOUBLE AS d FROM boot GROUP BY comparison, metric, it) GROUP BY comparison, metric),
q AS (SELECT comparison, metric, (count(*) FILTER (round(abs(d), 9) >= round(abs(mean_a - mean_b), 9)) + 1) / ({n} + 1) AS p_raw FROM (SELECT comparison, metric, it, max(v) FILTER (side = 1) - max(v) FILTER (side = 0) AS d FROM perm GROUP BY comparison, metric, it) JOIN seen USING (comparison, metric) GROUP BY comparison, metric),
o AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p_raw) + 1) * p_raw) AS raw FROM q)
SELECT comparison, metric::INT AS metric, round(mean_a, 6)::DOUBLE AS mean_a, round(mean_b, 6)::DOUBLE AS mean_b, round(mean_a - mean_b, 6)::DOUBLE AS delta, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_raw, 6)::DOUBLE AS p_raw, round(max(raw) OVER (ORDER BY p_raw), 6)::DOUBLE AS p_holm
FROM o JOIN seen USING (comparison, metric) JOIN b USING (comparison, metric)"""


@query(_resampled_sql(20))
def resampled_preview(spark, sf):
    """The same with 20 draws and swaps, which SQL can repeat."""
    return _resampled(spark, sf, 20)
