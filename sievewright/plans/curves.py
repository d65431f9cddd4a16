"""Training curves over days of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves, relational
from ..session import table
from .inputs import TICKS, ticks
from .register import Register

REGISTER = query = Register()
#: Fixed value: the 97.5 % point of Student's t with nine degrees of freedom, from printed tables.
T_POINTS = "points AS (SELECT 9 AS df, 2.2621571628::DOUBLE AS t)"


def _r(df, *columns, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM (SELECT event_type, value FROM events) GROUP BY 1".replace("quantile_cont(value, 0.25)", "round(quantile_cont(value, 0.25), 6)").replace("quantile_cont(value, 0.5)", "round(quantile_cont(value, 0.5), 6)").replace("quantile_cont(value, 0.75)", "round(quantile_cont(value, 0.75), 6)"))
def curve_quartiles(spark, sf):
    return _r(curves.quartiles(table(spark, sf, "events"), ["event_type"], "value"), "q1", "median", "q3")


@query(f"WITH {TICKS} SELECT name, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE 1.96 * stddev_samp(value) / sqrt(count(*)) END, 6) AS half_ci FROM ticks GROUP BY 1")
def curve_ci(spark, sf):
    return _r(curves.normal_interval(ticks(spark, sf), ["name"], "value"), "mean", "sd", "half_ci")


@query(
    f"""WITH {TICKS}, q AS (SELECT name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM ticks GROUP BY 1),
    i AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM (SELECT name, value FROM ticks) JOIN q USING (name))
    SELECT name, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, n, min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high, round(avg(value), 6) AS mean, count(*) FILTER (NOT inside) AS outliers,
    n >= 2 AS has_interval FROM i GROUP BY name, q1, median, q3, n"""
)
def box_summary(spark, sf):
    box = _r(curves.box(ticks(spark, sf).drop("n"), ["name"], "value"), "q1", "median", "q3", "mean")
    return box.withColumn("has_interval", F.col("half_ci").isNotNull()).drop("half_ci")


@query(f"WITH {TICKS}, {T_POINTS} SELECT name, count(*) AS n, round(max(t) * stddev_samp(value) / sqrt(count(*)), 4) AS half_ci FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tick) AS k FROM ticks QUALIFY k <= 10) JOIN points ON df = 9 GROUP BY 1 HAVING count(*) = 10")
def box_interval(spark, sf):
    """Half the 95 % interval of the mean, by Student's t, over the first ten ticks of each series (as over ten seeds)."""
    first = relational.first_k(ticks(spark, sf).drop("n"), ["name"], [F.col("tick")], 10)
    return curves.box(first, ["name"], "value").filter("n = 10").select("name", "n", F.round("half_ci", 4).alias("half_ci"))


@query(f"WITH {TICKS} SELECT name, tick, round(CASE WHEN count(*) OVER (PARTITION BY name) < 15 THEN value ELSE sum(value) OVER (PARTITION BY name ORDER BY tick ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15 END, 6) AS smoothed FROM ticks")
def moving_avg15(spark, sf):
    return curves.moving_average(ticks(spark, sf), ["name"], "tick", "value").select("name", "tick", F.round("smoothed", 6).alias("smoothed"))


@query(
    f"""WITH {TICKS}, g AS (SELECT name, tick, row_number() OVER w AS place, (coalesce(lag(value, 25) OVER w, first_value(value) OVER w) - value) / nullif(abs(coalesce(lag(value, 25) OVER w, first_value(value) OVER w)), 0) AS gain FROM ticks WINDOW w AS (PARTITION BY name ORDER BY tick))
    SELECT name, round(coalesce(max(tick) FILTER (gain > 0.01 AND place > 1)::DOUBLE, 0.6 * max(tick)), 6)::DOUBLE AS plateau_at FROM g GROUP BY 1"""
)
def plateau(spark, sf):
    return _r(curves.plateau(ticks(spark, sf), ["name"], "tick", "value"), "plateau_at")


@query(
    f"""WITH {TICKS}, b AS (SELECT *, row_number() OVER w AS place, min(value) OVER (PARTITION BY name ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ticks WINDOW w AS (PARTITION BY name ORDER BY tick)),
    c AS (SELECT *, best IS NULL OR value < best AS better FROM b) SELECT name, tick, place - max(CASE WHEN better THEN place END) OVER w AS waited, max(CASE WHEN better THEN tick END) OVER w AS best_step FROM c WINDOW w AS (PARTITION BY name ORDER BY tick)"""
)
def patience(spark, sf):
    return curves.patience(ticks(spark, sf), ["name"], "tick", "value").select("name", "tick", "waited", "best_step")


@query(
    f"""WITH RECURSIVE {TICKS}, o AS (SELECT name, tick, value, row_number() OVER (PARTITION BY name ORDER BY tick) AS k FROM ticks),
    r AS (SELECT name, tick, k, value AS best, 0::BIGINT AS waited FROM o WHERE k = 1 UNION ALL SELECT o.name, o.tick, o.k, CASE WHEN o.value <= r.best - 0.5 THEN o.value ELSE r.best END, CASE WHEN o.value <= r.best - 0.5 THEN 0 ELSE r.waited + 1 END FROM r JOIN o ON o.name = r.name AND o.k = r.k + 1)
    SELECT name, tick, waited, round(best, 6) AS best FROM r"""
)
def patience_margin(spark, sf):
    t = ticks(spark, sf).select("name", "tick", "value")
    return _r(curves.patience_with_margin(t, ["name"], "tick", "value", 0.5, "name string, tick int, value double, waited long, best double").select("name", "tick", "waited", "best"), "best")


@query(f"WITH {TICKS} SELECT name, arg_min(tick, value) AS best_tick, min(value) AS best_value FROM ticks GROUP BY 1")
def best_step(spark, sf):
    return ticks(spark, sf).groupBy("name").agg(F.min_by("tick", F.struct("value", "tick")).alias("best_tick"), F.min("value").alias("best_value"))


@query(f"WITH {TICKS} SELECT name, tick, sum(n) OVER (PARTITION BY name ORDER BY tick)::BIGINT AS examples_seen, round(sum(n) OVER (PARTITION BY name ORDER BY tick) / 500, 6)::DOUBLE AS real_epoch FROM ticks")
def exposure(spark, sf):
    return _r(curves.exposure(ticks(spark, sf), ["name"], "tick", F.col("n"), 500).select("name", "tick", "examples_seen", "real_epoch"), "real_epoch")


@query(f"WITH {TICKS} SELECT name, (tick // 5)::INT AS validation, round(sum(value * n) / sum(n), 6) AS loss, sum(n)::BIGINT AS n FROM ticks GROUP BY 1, 2")
def interval_loss(spark, sf):
    g = ticks(spark, sf).groupBy("name", F.floor(F.col("tick") / 5).cast("int").alias("validation"))
    return g.agg(F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("loss"), F.sum("n").alias("n"))


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem), e AS (SELECT min(v) FILTER (k = floor((n - 1) * 0.01)) AS lo, min(v) FILTER (k = ceil((n - 1) * 0.99)) AS hi FROM s) SELECT round(avg(l_extendedprice), 4) AS trimmed_mean, count(*) AS n FROM lineitem, e WHERE l_extendedprice BETWEEN lo AND hi")
def trimmed_mean(spark, sf):
    return _r(curves.trimmed_mean(table(spark, sf, "lineitem"), "l_extendedprice"), "trimmed_mean", n=4)


@query(name="log_cubic_smooth")
def log_cubic_smooth(spark, sf):
    t = ticks(spark, sf).select("name", (F.col("tick") + 1).cast("double").alias("x"), F.col("value").alias("y"))
    return _r(curves.log_cubic(t, ["name"], "x", "y", 180, "name string, x double, fitted double"), "fitted", n=4)


@query(f"WITH {TICKS}, s AS (SELECT name, avg(value) AS mean, min(tick) FILTER (value >= 50) AS first_tick FROM ticks GROUP BY 1), b AS (SELECT mean FROM s ORDER BY name LIMIT 1) SELECT s.name, round(100 * (1 - s.mean / b.mean), 6) AS reduction_pct, first_tick FROM s, b")
def efficiency(spark, sf):
    s = ticks(spark, sf).groupBy("name").agg(F.avg("value").alias("mean"), F.min(F.when(F.col("value") >= 50, F.col("tick"))).alias("first_tick"))
    base = s.orderBy("name").limit(1).select(F.col("mean").alias("base"))
    return s.crossJoin(F.broadcast(base)).select("name", F.round(100 * (1 - F.col("mean") / F.col("base")), 6).alias("reduction_pct"), "first_tick")


@query(f"WITH {TICKS} SELECT name, tick, n, round(value, 6) AS mean, last_value(CASE WHEN n > 5 THEN value END IGNORE NULLS) OVER (PARTITION BY name ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM ticks")
def collector_tick(spark, sf):
    """Mean of each tick, and the last mean of a tick with enough reports."""
    w = Window.partitionBy("name").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("n") > 5, F.col("value")), ignorenulls=True).over(w)
    return ticks(spark, sf).select("name", "tick", "n", F.round("value", 6).alias("mean"), held.alias("held"))


@query(
    f"""WITH RECURSIVE {TICKS}, o AS (SELECT name, tick, value, row_number() OVER (PARTITION BY name ORDER BY tick) AS k FROM ticks),
    r AS (SELECT name, tick, k, greatest(0, sign(value - 50) * 0.05)::DOUBLE AS p FROM o WHERE k = 1 UNION ALL SELECT o.name, o.tick, o.k, greatest(0, r.p + sign(o.value - 50) * 0.05)::DOUBLE FROM r JOIN o ON o.name = r.name AND o.k = r.k + 1)
    SELECT name, tick, round(p, 6) AS p FROM r"""
)
def controller_clamped(spark, sf):
    """p moves by a fixed step towards a target and never below 0, which equals the running sum
    less its running minimum (or 0), so that no sequential state is needed."""
    w = Window.partitionBy("name").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    s = ticks(spark, sf).withColumn("s", F.sum(F.signum(F.col("value") - 50) * 0.05).over(w))
    low = F.least(F.lit(0.0), F.min("s").over(w))
    return s.withColumn("p", F.round(F.col("s") - low, 6)).select("name", "tick", "p")


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS s, round(sum(value * value), 2) AS ss, round(avg(value), 6) AS mean, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)), 6) AS std FROM events GROUP BY 1")
def moments(spark, sf):
    v = F.col("value")
    spread = F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0)))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("s"), F.round(F.sum(v * v), 2).alias("ss"), F.round(F.avg(v), 6).alias("mean"), F.round(spread, 6).alias("std"))


@query(f"WITH {TICKS} SELECT name, tick, round(n / nullif(tick - lag(tick) OVER (PARTITION BY name ORDER BY tick), 0), 6)::DOUBLE AS rate FROM ticks")
def progress_rate(spark, sf):
    w = Window.partitionBy("name").orderBy("tick")
    return ticks(spark, sf).select("name", "tick", F.round(F.col("n") / F.nullif(F.col("tick") - F.lag("tick").over(w), F.lit(0)), 6).alias("rate"))
