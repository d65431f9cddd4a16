"""Streaming queries over the supplied tables, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import sign_hash
from ..operators import selection
from ..session import table
from ..shared import kept, work_folder
from ..streaming import collector, metrics
from .inputs import hashes, vectors
from .register import Register
from .selecting import GREEDY

REGISTER = query = Register()
#: Of the real rows' own distances.
PERCENTILE = 97.5


def _folder(spark) -> str:
    """A shared folder for checkpoints and output."""
    return work_folder(spark, "stream")


def _finish(spark, out, mode: str, schema):
    """Runs a stream with the input at hand. Complete results of few rows go to memory, others to files."""
    folder = _folder(spark)
    name = folder.rpartition("/")[2].replace("-", "_")
    writer = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    q = writer.format("memory").queryName(name).start() if mode == "complete" else writer.format("parquet").option("path", f"{folder}/out").start()
    q.awaitTermination()
    return spark.table(name) if mode == "complete" else spark.read.schema(schema).parquet(f"{folder}/out")


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS s, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_moments(spark, sf):
    out = metrics.moments(_events(spark, sf), "event_type", "value")
    done = _finish(spark, out, "complete", None)
    return done.select(F.col("event_type").alias("name"), "n", F.round("s", 4).alias("s"), F.round("mean", 6).alias("mean"))


@query("SELECT event_type AS name, ts::DATE::VARCHAR AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE regexp_full_match(event_type, '[a-z]+') GROUP BY 1, 2")
def stream_ticks(spark, sf):
    out = metrics.ticks(_events(spark, sf), "event_type", "value", "ts", names="[a-z]+")
    done = _finish(spark, out, "complete", None)
    return done.select(F.col("event_type").alias("name"), F.col("tick.start").cast("date").cast("string").alias("day"), "n", F.round("mean", 6).alias("mean"))


_DAY = "datediff('day', DATE '1970-01-01', ts::DATE)"


@query(
    f"""WITH e AS (SELECT event_type AS name, value, {_DAY} AS tick FROM events), last AS (SELECT floor((epoch_ms(max(ts::TIMESTAMP)) - 2 * 86400000) / 86400000)::BIGINT AS until FROM events),
    t AS (SELECT name, tick, count(value) AS num, avg(value) AS mean, CASE WHEN count(value) = 1 THEN 0 ELSE stddev_pop(value) END AS std FROM e WHERE value IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT name, unnest(range(min(tick)::BIGINT, (SELECT until FROM last))) AS tick FROM t GROUP BY 1), j AS (SELECT d.name, d.tick, t.num, t.mean, t.std FROM d LEFT JOIN t ON t.name = d.name AND t.tick = d.tick)
    SELECT name, tick::BIGINT AS tick, last_value(num IGNORE NULLS) OVER w AS num, round(last_value(mean IGNORE NULLS) OVER w, 6) AS mean, round(last_value(std IGNORE NULLS) OVER w, 6) AS std, num IS NOT NULL AS fresh FROM j
    WINDOW w AS (PARTITION BY name ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def stream_collector(spark, sf):
    """Averages of every closed day since the day before, held over days without reports; rare kinds report only now and then."""
    out = collector.collected(_events(spark, sf), "event_type", "value", "ts")
    with collector.state_store(spark):
        done = _finish(spark, out, "append", collector.TICKS)
    return done.select("name", "tick", "num", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "fresh")


@query(GREEDY, name="stream_gate")
def stream_gate(spark, sf):
    """The greedy gate over vectors as they arrive; equal to the batch form (tested)."""
    folder = _folder(spark)
    rows = hashes(spark, sf).select(F.col("combo").cast("int").alias("combo"), "id", F.lit(True).alias("quality_ok"), "hash")
    rows.write.parquet(f"{folder}/in")
    out = metrics.greedy_gate(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "combo", 22, 1 << 30)
    return _finish(spark, out, "append", "combo int, id long, decision string")


@query(name="stream_outlier_gate")
def stream_outlier_gate(spark, sf):
    """Generated vectors as they arrive, through the outlier test of the real rows' geometry and then the greedy gate; equal to the batch form (tested)."""
    v = vectors(spark, sf).select(F.col("combo").cast("int").alias("combo"), "id", "is_real", F.col("embedding").cast("array<double>").alias("vector"), sign_hash(F.col("embedding")).alias("hash"))
    models = selection.geometries(v.filter("is_real"))
    real = kept(selection.measured(v.filter("is_real"), models), "measured")
    limits = selection.exact_percentile(real, "combo", "m2", "id", PERCENTILE).filter("n > 1").select("combo", "threshold")
    folder = _folder(spark)
    v.filter("not is_real").write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(v.schema).parquet(f"{folder}/in")
    tested = selection.measured(arriving, models, "hash").join(kept(limits, "limits"), "combo", "left")
    ok = F.coalesce(F.col("m2") <= F.col("threshold"), F.lit(True))
    out = metrics.greedy_gate(tested.select("combo", "id", F.lit(True).alias("quality_ok"), ok.alias("m2_ok"), "hash"), "combo", 22, 1 << 30)
    return _finish(spark, out, "append", "combo int, id long, decision string")
