"""Tables written by the sinks and read back by the readers, and rows that pass registered hooks."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..functions import hooks, scalars
from ..operators import selection
from ..session import table
from ..shared import work_folder
from ..sources import dataset, readers, writers
from .inputs import VECTORS, vectors
from .register import Register

REGISTER = query = Register()
_SQL_CLASS = "CASE doc_id % 5 WHEN 0 THEN 'glioma' WHEN 1 THEN 'meningioma' WHEN 2 THEN 'no_tumor' WHEN 3 THEN 'pituitary' ELSE 'other' END"
_SQL_PLANE = "CASE doc_id % 7 WHEN 0 THEN '?' WHEN 1 THEN 'co' WHEN 2 THEN 'sa' ELSE 'ax' END"
_SQL_PATH = "CASE WHEN doc_id % 2 = 0 THEN '/abs/' ELSE '' END || source || '/' || doc_id || '.png'"


def _manifest_rows(spark, sf):
    d = table(spark, sf, "documents")
    source = F.when(F.col("doc_id") % 3 == 0, "real").otherwise("synthetic")
    return d.select(F.expr(_SQL_PATH).alias("filepath"), F.expr(_SQL_CLASS).alias("class"), F.expr(_SQL_PLANE).alias("plane"), source.alias("source"))


_MANIFEST = f"""SELECT {_SQL_PATH} AS filepath, {_SQL_CLASS} AS class, {_SQL_PLANE} AS plane, CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'synthetic' END AS source,
    CASE WHEN doc_id % 2 = 0 THEN {_SQL_PATH} ELSE '/root/data/' || {_SQL_PATH} END AS path, doc_id || '.png' AS basename, doc_id % 5 <> 4 AND doc_id % 7 <> 0 AS valid FROM documents"""


def _manifest(spark, sf, mode):
    path = work_folder(spark, "manifest")
    writers.manifest(_manifest_rows(spark, sf), path, ["filepath", "class", "plane", "source"], ["filepath"])
    return readers.read(spark, "manifest", path, root="/root/data", mode=mode)


@query(_MANIFEST)
def manifest_file(spark, sf):
    """A manifest written as CSV and read back with resolved paths; rows outside the fixed values are marked."""
    return _manifest(spark, sf, "permissive")


@query(f"SELECT filepath, class, plane, source, path, basename FROM ({_MANIFEST}) WHERE valid")
def manifest_file_valid(spark, sf):
    """The same, rows outside the fixed values dropped."""
    return _manifest(spark, sf, "drop")


@query("SELECT event_type AS experiment, user_id % 10 AS seed, event_id AS step, value AS loss, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS accuracy FROM events")
def history_files(spark, sf):
    """Training histories of differing columns, one folder a run, as JSON lines; read back by pattern with required keys."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("experiment"), (F.col("user_id") % 10).alias("seed"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    path = work_folder(spark, "history")
    writers.history([e.filter("step % 2 <> 0"), e.filter("step % 2 = 0").withColumn("accuracy", F.col("loss") * 2)], path, ["experiment", "seed"])
    schema = "experiment string, seed long, step long, loss double, accuracy double"
    return readers.read(spark, "jsonl", f"{path}/jsonl/experiment=*/seed=*", schema=schema, required=("experiment", "step"))


@query("SELECT round(o_totalprice / 1000, 3)::DOUBLE AS x, (o_orderkey % 100)::INT AS y, o_orderkey AS key FROM orders")
def plot_file(spark, sf):
    """Plot data with fixed decimals between spaces, read back as numbers."""
    path = work_folder(spark, "plot")
    o = table(spark, sf, "orders").select(F.round(F.col("o_totalprice") / 1000, 3).alias("x"), (F.col("o_orderkey") % 100).cast("int").alias("y"), F.col("o_orderkey").alias("key"))
    writers.plot_data(o, path, 3)
    got = readers.read(spark, "dat", path)
    return got.select(F.col("x").cast("double").alias("x"), F.col("y").cast("int").alias("y"), F.col("key").cast("long").alias("key"))


@query(
    """SELECT 'plot_metadata' AS record_type, 'P001' AS plot, NULL::VARCHAR AS name, NULL::BIGINT AS key UNION ALL SELECT 'data', NULL, n_name, n_nationkey FROM nation
    UNION ALL SELECT 'plot_metadata', 'P002', NULL, NULL UNION ALL SELECT 'data_availability', NULL, NULL, NULL"""
)
def registry_files(spark, sf):
    """Plot registries: a record of metadata, then sorted data; a record of availability where there is none."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    path = work_folder(spark, "registry")
    for plot, rows in (("P001", n), ("P002", n.limit(0))):
        writers.registry(rows, f"{path}/{plot}", plot, ["name"])
    return readers.read(spark, "jsonl", [f"{path}/P001", f"{path}/P002"], schema="record_type string, plot string, name string, key long")


@query("SELECT c_mktsegment AS segment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 100 AS shard, c_custkey AS id FROM customer")
def request_shards(spark, sf):
    """Requests in shards of at most 100 a segment, checked against their index and read back."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    path = work_folder(spark, "shards")
    writers.shards(c, path, [F.col("id")], 100, ["segment"])
    got = spark.read.schema("id long, segment string, shard long").json(path)
    return got.select("segment", "shard", "id")


@query("SELECT doc_id::VARCHAR AS image_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0)")
def index_files(spark, sf):
    """A keyed index without the ids that two other files name, each once."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), "lang")
    path = work_folder(spark, "index")
    for name, rows in (("all", d), ("used/a", d.filter("image_id % 3 = 0")), ("used/b", d.filter("image_id % 4 = 0"))):
        writers.manifest(rows, f"{path}/{name}", ["image_id", "lang"], ["image_id"])
    used = readers.read(spark, "ids", [f"{path}/used/a", f"{path}/used/b"])
    return readers.read(spark, "index", f"{path}/all").join(used, "image_id", "left_anti").select("image_id", "lang")


@query("SELECT event_id AS tick, value AS fid FROM events WHERE event_id % 3 = 0 AND event_id > (SELECT min(event_id) FROM events WHERE event_id % 3 = 0)")
def log_lines(spark, sf):
    """Metrics among other lines of a log: text and broken objects are ignored, the first tick is left out."""
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_id").alias("tick"), F.col("value").alias("fid")))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("step "), F.col("event_type"))).otherwise("{broken")
    path = work_folder(spark, "log")
    e.select(line.alias("value")).write.text(path)
    return readers.read(spark, "metric_lines", path, schema="tick long, fid double", after_first="tick")


@query(
    """SELECT o_orderpriority AS condition, count(DISTINCT o_custkey % 10) AS seeds, count(*) AS runs, round(avg(accuracy), 9) AS accuracy FROM (
    SELECT o_orderpriority, o_custkey, o_totalprice / 1e6 AS accuracy FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_custkey % 10 = 3)) GROUP BY 1 HAVING count(DISTINCT o_custkey % 10) >= 10"""
)
def result_files(spark, sf):
    """Nested result documents; a condition that lacks one of ten seeds is left out."""
    o = table(spark, sf, "orders").filter("NOT (o_orderpriority = '1-URGENT' AND o_custkey % 10 = 3)")
    rows = o.select(F.col("o_orderpriority").alias("condition"), (F.col("o_custkey") % 10).alias("seed"), F.struct((F.col("o_totalprice") / 1e6).alias("accuracy")).alias("scores"))
    path = work_folder(spark, "results")
    writers.append_lines(rows, path)
    got = spark.read.schema("condition string, seed long, scores struct<accuracy: double>").json(path)
    full = readers.complete(got, 10)
    return full.groupBy("condition").agg(F.count_distinct("seed").alias("seeds"), F.count(F.lit(1)).alias("runs"), F.round(F.avg("scores.accuracy"), 9).alias("accuracy"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, embedding FROM embeddings")
def feature_file(spark, sf):
    """Vectors as one .npy file in order of id, read back by ranges of rows."""
    path = f"{work_folder(spark, 'features')}.npy"
    writers.features(table(spark, sf, "embeddings"), path, "vec_id", "embedding")
    return readers.read(spark, "features", path, rows_per_partition=100)


_NAMES = "CASE label % 3 WHEN 0 THEN 'gl' WHEN 1 THEN 'nt' ELSE 'qq' END"


def _picture_folder(spark, sf):
    """Pictures in a folder for each class and plane, named as test images are."""
    v = table(spark, sf, "embeddings").filter(F.size("embedding") == 64)
    pixels = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(F.lit(128) + F.lit(256) * x.cast("double")), F.lit(0)), F.lit(255)).cast("int"))
    plane = F.element_at(F.array(F.lit("ax"), F.lit("sa"), F.lit("zz")), (F.col("vec_id") % 3 + 1).cast("int"))
    name = F.concat(F.lit("c"), (F.col("label") % 3).cast("string"), F.lit("_"), plane, F.lit("/s_t_"), F.col("vec_id").cast("string"), F.lit("_"), F.expr(_NAMES), F.lit("_"), plane, F.lit("_t1.png"))
    rows = dataset.encoded(spark, v.select(F.col("vec_id").alias("ordinal"), name.alias("name"), "label", pixels.alias("pixels")), "pixels", 8, 8).drop("pixels")
    path = work_folder(spark, "pictures")
    dataset.write(rows.withColumns({"width": F.lit(8), "height": F.lit(8), "channels": F.lit(1)}), path)
    return path


_PICTURES = f"""p AS (SELECT *, 'c' || label % 3 AS class, (['ax', 'sa', 'zz'])[vec_id % 3 + 1] AS plane FROM embeddings WHERE len(embedding) = 64), n AS (SELECT class || '_' || plane AS combo, class, plane, 's_t_' || vec_id || '_' || {_NAMES} || '_' || plane || '_t1.png' AS name, label FROM p)"""


@query(f"WITH {_PICTURES} SELECT combo, class, plane, name FROM n")
def image_listing(spark, sf):
    """Images below a folder with class and plane of their folders, in lexical order."""
    got = readers.read(spark, "images", _picture_folder(spark, sf))
    return got.select("combo", "class", "plane", F.element_at(F.split("path", "/"), -1).alias("name"))


@query(f"WITH {_PICTURES} SELECT class, plane, count(*) AS n FROM n WHERE class IN ('c0', 'c1') AND plane IN ('ax', 'sa') GROUP BY 1, 2")
def image_partitions(spark, sf):
    """Images counted in the folder of each class and plane; a class without a folder warns and counts nothing."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        got = readers.read(spark, "partitions", _picture_folder(spark, sf), classes=("c0", "c1", "c9"), planes=("ax", "sa"))
    return got.groupBy("class", "plane").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PICTURES} SELECT name, CASE label % 3 WHEN 0 THEN 'glioma' ELSE 'no_tumor' END AS class, CASE WHEN plane = 'zz' THEN '?' ELSE plane END AS plane FROM n WHERE label % 3 < 2")
def class_folder_names(spark, sf):
    """Test images with class and plane from their names: without a class they go, an unknown plane is a question mark."""
    got = readers.read(spark, "class_folders", _picture_folder(spark, sf))
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "class", "plane")


@query(f"WITH {_PICTURES} SELECT combo || '/' || name AS name FROM n WHERE plane <> 'zz' AND name NOT LIKE '%_qq_%' UNION ALL SELECT 'dataset.json'")
def folder_listing(spark, sf):
    """All files below a folder, without those that a glob names by folder or file."""
    return readers.read(spark, "listing", _picture_folder(spark, sf), ignores=("*_zz", "*_qq_*")).select("name")


@query("SELECT event_id, event_type AS type, value FROM events")
def appended_lines(spark, sf):
    """Records added to JSON lines in two turns, keys sorted."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("type"), "value")
    path = work_folder(spark, "lines")
    for part in (0, 1):
        writers.append_lines(e.filter(F.col("event_id") % 2 == part), path, ["event_id"])
    return spark.read.schema("event_id long, type string, value double").json(path)


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(DISTINCT event_type)) AS types FROM events")
def summary_document(spark, sf):
    """A nested summary as one JSON document, read back."""
    e = table(spark, sf, "events").agg(F.struct(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).alias("totals"), F.sort_array(F.collect_set("event_type")).alias("types"))
    path = work_folder(spark, "document")
    writers.document(e, path)
    return spark.read.schema("totals struct<n: bigint, mean: double>, types array<string>").json(path).select("totals.n", "totals.mean", "types")


@query("SELECT doc_id, upper(lang) AS lang, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) % 2 = 0")
def hooked_rows(spark, sf):
    """Rows through a transform that is found by its dotted name and drops some."""
    made = hooks.by_name("sievewright.plans.exchange.even_texts")
    return hooks.transformed(table(spark, sf, "documents").select("doc_id", "lang", "text"), made, "doc_id long, lang string, n long")


def even_texts():
    """A transform that keeps texts of an even number of characters."""

    def each(row: dict) -> dict | None:
        if row["text"] is None or len(row["text"]) % 2:
            return None
        return {"doc_id": row["doc_id"], "lang": row["lang"] and row["lang"].upper(), "n": len(row["text"])}

    return each


METRICS = hooks.Metrics()


def _named(name: str, f):
    f.__name__ = name
    return METRICS.register(f)


_named("mean_norm", lambda v: v.agg(F.avg(scalars.l2_norm(F.col("embedding"))).alias("value")))
_named("real_share", lambda v: v.agg(F.avg(F.col("is_real").cast("double")).alias("value")))


def _moment_sums(v):
    return {r["side"]: (r["n"], r["sums"]) for r in selection.moments(v.select(F.col("is_real").cast("int").alias("side"), F.col("embedding").cast("array<double>").alias("vector")), "vector", ["side"]).collect()}


@METRICS.register
def frechet_distance(v):
    """Fréchet distance of real and generated rows; two rows of sums reach the driver."""
    sums = _moment_sums(v)
    return v.sparkSession.createDataFrame([(selection.frechet(sums[0], sums[1]) if len(sums) == 2 else None,)], "value double")


@METRICS.register
def mean_distance(v):
    """Squared distance of the means of real and generated rows."""
    parts = v.select("is_real", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x")).groupBy("k").agg(F.avg(F.when(F.col("is_real"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("is_real"), F.col("x"))).alias("b"))
    return parts.agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("value"))


@METRICS.register
def kernel_distance(v):
    """Kernel distance over one hundred subsets."""
    rows = v.select("id", F.col("is_real").cast("int").alias("side"), F.col("embedding").cast("array<double>").alias("vector"))
    return selection.kernel_distance(rows, 100, 1000, 1).agg(F.avg("kid").alias("value"))


@query(
    f"""WITH {VECTORS}, k AS (SELECT is_real, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM vectors), m AS (SELECT k, avg(x) FILTER (is_real) - avg(x) FILTER (NOT is_real) AS d FROM k GROUP BY 1)
    SELECT 'mean_norm' AS metric, round(avg(sqrt(list_dot_product(e, e))), 6) AS value FROM vectors UNION ALL SELECT 'real_share', round(avg(is_real::INT), 6) FROM vectors UNION ALL SELECT 'mean_distance', round(sum(d * d), 6) FROM m"""
)
def registered_metrics(spark, sf):
    """Metrics by name from the register, those that SQL can state."""
    v = vectors(spark, sf)
    out = [METRICS.calc(n, v).select(F.lit(n).alias("metric"), F.round("value", 6).alias("value")) for n in ("mean_norm", "real_share", "mean_distance")]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(name="registered_distances")
def registered_distances(spark, sf):
    """The other metrics of the register: distances of real and generated rows."""
    v = vectors(spark, sf)
    out = [METRICS.calc(n, v).select(F.lit(n).alias("metric"), F.round("value", 4).alias("value")) for n in ("frechet_distance", "kernel_distance")]
    return out[0].unionAll(out[1])


@query(
    """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS b FROM embeddings), u AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS u, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS v FROM a WHERE b IS NOT NULL),
    d AS (SELECT *, list_dot_product(u, v) AS c FROM u) SELECT vec_id, round(list_dot_product(m, u), 6) AS along, round(list_dot_product(m, v), 6) AS other FROM (
    SELECT vec_id, u, v, list_transform(list_zip(u, v), lambda p: (sin(0.7 * acos(c)) * p[1] + sin(0.3 * acos(c)) * p[2]) / sin(acos(c))) AS m FROM d)"""
)
def slerp_neighbours(spark, sf):
    """Vectors turned by three tenths of the angle towards the next: their cosines with both ends."""
    from ..shared import ordinals

    v = ordinals(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")), ["vec_id"], "place")
    pairs = v.join(v.select((F.col("place") - 1).alias("place"), F.col("a").alias("b")), "place")
    rows = pairs.select("vec_id", scalars.unit(F.col("a")).alias("a"), scalars.unit(F.col("b")).alias("b")).withColumn("m", scalars.slerp(F.col("a"), F.col("b"), F.lit(0.3)))
    return rows.select("vec_id", F.round(scalars.dot(F.col("m"), F.col("a")), 6).alias("along"), F.round(scalars.dot(F.col("m"), F.col("b")), 6).alias("other"))

