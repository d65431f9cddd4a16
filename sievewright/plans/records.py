"""Record normalisation, guards, small samples, accounting and running averages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, hash_rank
from ..operators import relational, sampling
from ..session import table
from .inputs import TICKS, sql_mix, sql_mix32, ticks
from .register import Register

REGISTER = query = Register()


@query("SELECT event_id, coalesce(event_type, 'unknown') AS experiment, CASE WHEN value > 50 THEN ['f1_high', 'f1_value'] ELSE ['f1_value'] END AS f1_keys, round(value, 6) AS f1_value FROM events")
def record_normalise(spark, sf):
    """Defaults, and those entries of a map whose keys begin with ``f1_``."""
    scores = F.create_map(F.lit("f1_value"), F.col("value"), F.lit("other"), F.lit(1.0), F.lit("f1_high"), F.when(F.col("value") > 50, F.lit(1.0)))
    f1 = F.map_filter(scores, lambda k, v: F.startswith(k, F.lit("f1_")) & v.isNotNull())
    return table(spark, sf, "events").select("event_id", F.coalesce("event_type", F.lit("unknown")).alias("experiment"), F.sort_array(F.map_keys(f1)).alias("f1_keys"), F.round(F.try_element_at(f1, F.lit("f1_value")), 6).alias("f1_value"))


@query("SELECT ['seed'] AS missing, ['doc_id', 'quality', 'toxic', 'seed'] AS everything")
def column_difference(spark, sf):
    """Required columns that a table lacks, and the ordered union of both lists."""
    own, need = (F.array(*[F.lit(c) for c in cs]) for cs in (table(spark, sf, "labels").columns, ["quality", "seed"]))
    return spark.range(1).select(F.array_except(need, own).alias("missing"), F.array_distinct(F.concat(own, need)).alias("everything"))


@query("SELECT c_custkey, regexp_extract(c_name, '#0*(\\d+)$', 1)::BIGINT AS snapshot FROM customer")
def snapshot_number(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", r"#0*(\d+)$", 1).cast("long").alias("snapshot"))


@query("(SELECT 'most' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12) UNION ALL (SELECT 'least', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 12)")
def most_and_least(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    pick = lambda side, key: o.orderBy(key, "o_orderkey").limit(12).select(F.lit(side).alias("side"), "*")
    return pick("most", F.desc("o_totalprice")).unionAll(pick("least", F.col("o_totalprice")))


@query(f"SELECT doc_id FROM documents ORDER BY {sql_mix(9, 'doc_id')}, doc_id LIMIT 100")
def choose_n(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy(hash_rank(9, F.col("doc_id")), "doc_id").limit(100)


@query("SELECT p_partkey, greatest(1, least(31, round_even(32 / (1 + p_size / 10.0::DOUBLE), 0)))::BIGINT AS batch_real, 32 - greatest(1, least(31, round_even(32 / (1 + p_size / 10.0::DOUBLE), 0)))::BIGINT AS batch_synthetic FROM part")
def batch_mix(spark, sf):
    """Share of real rows in a batch of 32 by ratio, at least one of each kind."""
    real = F.greatest(F.lit(1), F.least(F.lit(31), half_even(F.lit(32) / (1 + F.col("p_size") / 10.0)))).cast("long")
    return table(spark, sf, "part").select("p_partkey", real.alias("batch_real"), (32 - real).alias("batch_synthetic"))


_QUOTA = "greatest(1, least(31, round_even(32 / (1 + step / 4.0::DOUBLE), 0)))::BIGINT"


@query(
    f"""WITH s AS (SELECT step, {_QUOTA} AS batch_real FROM range(40) t(step)), pool AS (SELECT doc_id, doc_id % 3 = 0 AS real, row_number() OVER (PARTITION BY doc_id % 3 = 0 ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY doc_id % 3 = 0) AS n FROM documents),
    d AS (SELECT step, true AS real, unnest(range(batch_real)) AS draw FROM s UNION ALL SELECT step, false, unnest(range(32 - batch_real)) FROM s), m AS (SELECT real, max(n) AS n FROM pool GROUP BY 1)
    SELECT step, d.real, draw, p.doc_id FROM d JOIN m ON m.real = d.real JOIN pool p ON p.real = d.real AND p.place = CASE WHEN d.real THEN {sql_mix32('3', 'step', 'draw')} ELSE {sql_mix32('4', 'step', 'draw')} END % m.n"""
)
def batch_draws(spark, sf):
    """Batches of 32 for forty steps of falling share of real rows: each side's quota, drawn with replacement."""
    real = F.greatest(F.lit(1), F.least(F.lit(31), half_even(F.lit(32) / (1 + F.col("id") / 4.0)))).cast("long")
    steps = spark.range(40).select(F.col("id").alias("step"), real.alias("real")).withColumn("other", 32 - F.col("real"))
    docs = table(spark, sf, "documents").select("doc_id")
    sides = [(True, "real", 3, docs.filter("doc_id % 3 = 0")), (False, "other", 4, docs.filter("doc_id % 3 <> 0"))]
    a, b = (sampling.draws(steps, pool, quota, seed, "doc_id").select("step", F.lit(side).alias("real"), "draw", "doc_id") for side, quota, seed, pool in sides)
    return a.unionAll(b)


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents), r AS (SELECT doc_id, p, false AS wrapped FROM p UNION ALL SELECT doc_id, p + n, true FROM p WHERE p < (7 - n % 7) % 7) SELECT doc_id, (p % 7)::INT AS shard, p // 7 AS place, wrapped FROM r")
def round_robin_shards(spark, sf):
    """Documents dealt in turn to seven shards of one size; the last round is filled with the first rows, marked."""
    return sampling.round_robin(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 7).select("doc_id", "shard", "place", "wrapped")


@query(
    """WITH l AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)), d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS m FROM documents),
    g AS (SELECT r, c, l.source, (r // l.n) * 6 + c AS at FROM range(10) a(r), range(6) b(c), l WHERE l.k = r % l.n) SELECT d.doc_id, d.source, r::INT AS row, c::INT AS "column" FROM g JOIN d ON d.source = g.source AND d.p = g.at % d.m"""
)
def label_grid(spark, sf):
    """A grid of ten rows by six: one source a row, in turn, each going on where it was last shown."""
    return sampling.label_grid(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 6, 10)


@query(f"WITH {TICKS}, c AS (SELECT name, tick, sum(n) OVER (PARTITION BY name ORDER BY tick) AS seen, n FROM ticks) SELECT name, tick, seen // 100 > (seen - n) // 100 OR tick = min(tick) OVER (PARTITION BY name) OR tick = max(tick) OVER (PARTITION BY name) AS triggered FROM c")
def tick_trigger(spark, sf):
    """A tick every 100 items, at the first and at the last."""
    w = Window.partitionBy("name")
    seen = F.sum("n").over(w.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0))
    rows = ticks(spark, sf).withColumn("seen", seen)
    crossed = F.floor(F.col("seen") / 100) > F.floor((F.col("seen") - F.col("n")) / 100)
    return rows.select("name", "tick", (crossed | (F.col("tick") == F.min("tick").over(w)) | (F.col("tick") == F.max("tick").over(w))).alias("triggered"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_items(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.without(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, quantile_cont(p_retailprice, 0.5) AS median, count(*) FILTER (p_size < 10) AS small, list(p_partkey ORDER BY p_retailprice, p_partkey)[1:5] AS worst FROM part GROUP BY 1")
def preprocess_stats(spark, sf):
    """Totals by group with the five lowest, kept by a bounded window before they are listed."""
    p = table(spark, sf, "part")
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    low = p.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "p_partkey"))), lambda x: x["p_partkey"]).alias("worst"))
    out = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.percentile("p_retailprice", F.lit(0.5)).alias("median"), F.count_if(F.col("p_size") < 10).alias("small"))
    return out.join(low, "p_brand")


@query("WITH t AS (SELECT l_returnflag AS combo, unnest([0.95, 0.975, 0.99]) AS pct, unnest([quantile_cont(l_extendedprice, 0.95), quantile_cont(l_extendedprice, 0.975), quantile_cont(l_extendedprice, 0.99)]) AS threshold FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT combo, pct::DOUBLE AS pct, round(threshold, 4) AS threshold, count(l_orderkey) FILTER (l_extendedprice > threshold) AS rejected FROM t LEFT JOIN lineitem ON l_returnflag = combo AND l_linestatus = 'O' GROUP BY 1, 2, threshold")
def threshold_grid(spark, sf):
    """Rejects at three percentiles of the reference rows of each group."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("combo"), "l_linestatus", "l_extendedprice")
    grid = (0.95, 0.975, 0.99)
    q = rows.filter("l_linestatus = 'F'").groupBy("combo").agg(F.percentile("l_extendedprice", F.array(*[F.lit(g) for g in grid])).alias("q"))
    t = q.select("combo", F.explode(F.arrays_zip(F.array(*[F.lit(g) for g in grid]).alias("pct"), F.col("q").alias("threshold"))).alias("t")).select("combo", F.col("t.pct").alias("pct"), F.col("t.threshold").alias("threshold"))
    other = rows.filter("l_linestatus = 'O'").select("combo", "l_extendedprice")
    over = F.count_if(F.col("l_extendedprice") > F.col("threshold"))
    return t.join(other, "combo", "left").groupBy("combo", "pct", "threshold").agg(over.alias("rejected")).withColumn("threshold", F.round("threshold", 4))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def unique_match(spark, sf):
    """Lookup in which every name must have exactly one match."""
    n = relational.guard_unique(table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    return table(spark, sf, "supplier").join(n, "s_nationkey").select("s_suppkey", "n_name")


@query(f"WITH {TICKS} SELECT name, round(list_reduce(list(value ORDER BY tick), lambda a, x: 0.9 * a + 0.1 * x), 6) AS ema FROM ticks GROUP BY 1")
def ema(spark, sf):
    """Exponential moving average of each series, begun at its first value."""
    s = ticks(spark, sf).groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("tick", "value"))), lambda x: x["value"]).alias("v"))
    return s.select("name", F.round(F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0)), lambda a, x: 0.9 * a + 0.1 * x), 6).alias("ema"))


@query("SELECT quality AS y_true, (length(text) > 500)::INT AS y_pred, count(*) AS n, count(*) FILTER (toxic = 0) AS n_gated FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def gated_confusion(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.groupBy(F.col("quality").alias("y_true"), (F.length("text") > 500).cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 0).alias("n_gated"))


@query("SELECT event_id, event_type IN ('click', 'view', 'purchase') AS type_ok, k BETWEEN 0 AND 100 AS k_ok, value >= 0 AS value_ok FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)")
def schema_rules(spark, sf):
    """Values of documents against a table of enum and range rules, one boolean column a rule."""
    k = F.from_json("props", "k int")["k"]
    rules = {"type_ok": F.col("event_type").isin("click", "view", "purchase"), "k_ok": k.between(0, 100), "value_ok": F.col("value") >= 0}
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in rules.items()])


@query("SELECT conv_id, list(DISTINCT role ORDER BY role) AS roles, count(*) AS turns, '[' || string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}', ',' ORDER BY turn) || ']' AS document FROM conversations GROUP BY 1")
def conversation_document(spark, sf):
    """One nested document a conversation."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("turns"), F.to_json(turns).alias("document"))


@query("SELECT event_type, date_trunc('week', ts)::DATE::VARCHAR AS week, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_at, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS elapsed FROM events GROUP BY 1, 2")
def timestamps(spark, sf):
    seconds = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").cast("string")
    return table(spark, sf, "events").groupBy("event_type", week.alias("week")).agg(F.date_format(F.min("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("first_at"), seconds.alias("elapsed"))
