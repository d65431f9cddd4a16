"""Guarded lookups, destinations, splits with fallbacks, exact tests and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational, sampling
from ..operators.stats import binomial_two_sided
from ..session import table
from ..shared import ordinals
from .inputs import TICKS, sql_mix, ticks
from .register import Register

REGISTER = query = Register()


@query("SELECT d.doc_id, coalesce(l.quality, length(d.text) % 2) AS quality, CASE WHEN l.doc_id IS NULL THEN 'file' ELSE 'embedded' END AS origin FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def embedded_first(spark, sf):
    """Embedded values where there are any, those of the fallback source elsewhere."""
    embedded = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("embedded"))
    rows = table(spark, sf, "documents").select("doc_id", (F.length("text") % 2).alias("fallback")).join(embedded, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("embedded", "fallback").alias("quality"), F.when(F.col("embedded").isNull(), "file").otherwise("embedded").alias("origin"))


@query(f"WITH {TICKS} SELECT name, tick, value FROM ticks QUALIFY row_number() OVER (PARTITION BY name ORDER BY tick) > 1")
def ticks_after_first(spark, sf):
    """A log without the first record of each run, in order of its explicit tick."""
    w = Window.partitionBy("name").orderBy("tick")
    return ticks(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn > 1").select("name", "tick", "value")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def last_row_wins(spark, sf):
    """Key to row, where the last of several rows with one key holds."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents), b AS (SELECT length(text) AS feature, row_number() OVER (ORDER BY doc_id) AS place FROM documents) SELECT doc_id, feature FROM a JOIN b USING (place)")
def positional_zip(spark, sf):
    """Manifest rows with the feature rows at the same places; unequal lengths are an error."""
    docs = table(spark, sf, "documents")
    return relational.zip_rows(docs.select("doc_id"), "doc_id", docs.select("doc_id", F.length("text").alias("feature")), "doc_id").select("doc_id", "feature")


@query("SELECT l.doc_id, d.source FROM labels l JOIN documents d USING (doc_id)")
def strict_lookup(spark, sf):
    """A lookup in which a missing key is an error."""
    sources = table(spark, sf, "documents").select("doc_id", "source")
    return relational.required(table(spark, sf, "labels").select("doc_id"), sources, "doc_id", "source")


@query(
    """WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/') AS parts FROM pages),
    c AS (SELECT page_id, parts, list_filter(parts, lambda x: x IN ('en', 'de', 'fr', 'es')) AS hit, regexp_extract(parts[-1], '[a-z]+') AS token FROM p)
    SELECT page_id, coalesce(hit[1], CASE token WHEN 'page' THEN 'code-page' WHEN 'post' THEN 'code-post' END, CASE WHEN len(parts) > 1 THEN parts[-2] END, 'images') AS class FROM c"""
)
def class_from_path(spark, sf):
    """Class of a path: the first part that is a class, then a token of the name, then the parent folder."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "")
    rows = table(spark, sf, "pages").select("page_id", F.split(path, "/").alias("parts"))
    hit = F.get(F.filter("parts", lambda x: x.isin("en", "de", "fr", "es")), F.lit(0))
    token = F.regexp_extract(F.element_at("parts", -1), "[a-z]+", 0)
    code = F.when(token == "page", "code-page").when(token == "post", "code-post")
    parent = F.when(F.size("parts") > 1, F.element_at("parts", -2))
    return rows.select("page_id", F.coalesce(hit, code, parent, F.lit("images")).alias("class"))


@query(
    """SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'out/' || lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' END AS path,
    CASE WHEN lang IN ('en', 'de') THEN NULL ELSE 'class not recognised: ' || lang END AS reason, source || '/' || doc_id::VARCHAR AS portable,
    'kept/' || source || '/' || lang || '/' || doc_id::VARCHAR || '.png' AS preserved FROM documents"""
)
def destinations(spark, sf):
    """Destination by class and plane, or the reason there is none; the path relative to its root."""
    known = F.col("lang").isin("en", "de")
    path = F.concat_ws("/", F.lit("out"), "lang", "source", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    full = F.concat_ws("/", F.lit("/data/root"), "source", F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.when(known, path).alias("path"), F.when(~known, F.concat(F.lit("class not recognised: "), "lang")).alias("reason"), S.portable(full, "/data/root").alias("portable"), S.preserved(F.concat_ws("/", F.lit("/data/root"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpeg"))), "/data/root", "kept", ".png").alias("preserved"))


_TEST_NAME = """'set_test_' || lpad((c_custkey % 1000)::VARCHAR, 5, '0') || CASE c_custkey % 6 WHEN 0 THEN '_gl_ax' WHEN 1 THEN '_nt_xx' WHEN 2 THEN '_pi_sa' WHEN 3 THEN '_zz_co' WHEN 4 THEN '_me' ELSE '_no_co' END || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '_t1' END"""


@query(
    f"""WITH t AS (SELECT c_custkey, {_TEST_NAME} AS stem FROM customer), w AS (SELECT *, string_split(stem, '_') AS w FROM t),
    c AS (SELECT *, CASE WHEN len(w) >= 6 THEN CASE w[4] WHEN 'gl' THEN 'glioma' WHEN 'me' THEN 'meningioma' WHEN 'no' THEN 'no_tumor' WHEN 'nt' THEN 'no_tumor' WHEN 'pi' THEN 'pituitary' END END AS class, CASE WHEN len(w) >= 6 THEN w[5] END AS any_plane FROM w)
    SELECT c_custkey, stem, class, CASE WHEN any_plane IN ('ax', 'co', 'sa') THEN any_plane END AS plane, any_plane FROM c"""
)
def plane_names(spark, sf):
    """Class and plane of test names of six or more tokens, with and without the check of the plane."""
    name = F.expr(_TEST_NAME.replace("::VARCHAR", "").replace("lpad((c_custkey % 1000)", "lpad(cast(c_custkey % 1000 AS string)"))
    rows = table(spark, sf, "customer").select("c_custkey", name.alias("stem"))
    checked, free = S.test_name(F.col("stem")), S.test_name(F.col("stem"), check_plane=False)
    return rows.select("c_custkey", "stem", checked["class"].alias("class"), checked["plane"].alias("plane"), free["plane"].alias("any_plane"))


_M = sql_mix(42, "doc_id")


@query(
    f"""WITH s AS (SELECT doc_id, doc_id % 3 <> 0 AS is_real, CASE WHEN count(*) OVER (PARTITION BY lang, source) >= 10 THEN lang || '/' || source WHEN count(*) OVER (PARTITION BY lang) >= 10 THEN lang ELSE 'all' END AS stratum FROM documents),
    q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_M}, doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s WHERE is_real)
    SELECT doc_id, stratum, CASE WHEN r <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' ELSE 'validation' END AS split FROM q UNION ALL SELECT doc_id, stratum, 'train' FROM s WHERE NOT is_real"""
)
def real_only_split(spark, sf):
    """80/20 of the real rows by the finest stratum with ten rows; other rows always train."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", (F.col("doc_id") % 3 != 0).alias("is_real"))
    rows = sampling.with_stratum(docs, [["lang", "source"], ["lang"]], 10)
    real = sampling.split(rows.filter("is_real"), ["stratum"], [("train", 0.8), ("validation", 0.2)], 42, "doc_id")
    return real.select("doc_id", "stratum", "split").unionAll(rows.filter("not is_real").select("doc_id", "stratum", F.lit("train").alias("split")))


@query(
    """WITH c AS (SELECT event_type, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY 1),
    p AS (SELECT event_type, k, n, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + n * ln(0.5)) AS p FROM c, LATERAL (SELECT unnest(range(0, n + 1)) AS j))
    SELECT event_type, any_value(k)::BIGINT AS k, any_value(n)::BIGINT AS n, round(least(1, sum(CASE WHEN least(j, n - j) <= least(k, n - k) THEN p ELSE 0 END)), 6) AS p FROM p GROUP BY 1"""
)
def binomial_p(spark, sf):
    """Exact two-sided binomial p against one half."""
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", "k", "n", F.round(binomial_two_sided(F.col("k"), F.col("n")), 6).alias("p"))


@query(
    """WITH p AS (SELECT p_brand AS combo, count(*) AS n, sum((p_size > 45)::INT) AS broken FROM part GROUP BY 1)
    SELECT combo, n, broken, CASE WHEN broken = 0 THEN 'complete' WHEN broken < n / 2 THEN 'partial' ELSE 'rebuild' END AS status FROM p"""
)
def archive_status(spark, sf):
    """Status of each combination's archive by its damaged members."""
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("combo")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p_size") > 45).cast("long")).alias("broken"))
    return rows.withColumn("status", F.when(F.col("broken") == 0, "complete").when(F.col("broken") < F.col("n") / 2, "partial").otherwise("rebuild"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 25 ORDER BY p_retailprice, p_partkey LIMIT 30")
def worst_flagged(spark, sf):
    """The thirty flagged rows of least score."""
    return table(spark, sf, "part").filter("p_size > 25").orderBy("p_retailprice", "p_partkey").limit(30).select("p_partkey", "p_retailprice")


@query(
    f"WITH {TICKS}, v AS (SELECT name, list(value ORDER BY tick) AS v FROM ticks GROUP BY 1) SELECT name, round(list_reduce(list_transform(v, lambda x, i: [x, i::DOUBLE]), lambda a, x: [a[1] + (1 - pow(0.5, 1.0 / greatest(least(10, x[2] * 0.5), 1e-8))) * (x[1] - a[1]), x[2]])[1], 6) AS ema FROM v"
)
def ema_ramp_up(spark, sf):
    """Moving average whose half-life grows with the steps seen, half of them, up to ten."""
    s = ticks(spark, sf).groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("tick", "value"))), lambda x, i: F.struct(x["value"].alias("x"), (i + 1).cast("double").alias("i"))).alias("v"))
    weight = lambda i: 1 - F.pow(F.lit(0.5), 1.0 / F.greatest(F.least(F.lit(10.0), i * 0.5), F.lit(1e-8)))
    return s.select("name", F.round(F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0))["x"], lambda a, x: a + weight(x["i"]) * (x["x"] - a)), 6).alias("ema"))


@query("SELECT conv_id, to_json({n: count(*), roles: list(role ORDER BY turn), turns: max(turn)})::VARCHAR AS document, len(list(role)) BETWEEN 1 AND 8 AS length_ok FROM conversations GROUP BY 1")
def sorted_json(spark, sf):
    """Compact documents with keys in order, and a rule on the length of an array."""
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), roles.alias("roles"), F.max("turn").alias("turns"))
    return rows.select("conv_id", F.to_json(S.sorted_struct(n=F.col("n"), turns=F.col("turns"), roles=F.col("roles"))).alias("document"), F.size("roles").between(1, 8).alias("length_ok"))


@query("SELECT vec_id, to_json({'raw_idx': vec_id, 'xflip': vec_id % 2, 'raw_label': label})::VARCHAR AS details FROM embeddings")
def row_details(spark, sf):
    details = F.struct(F.col("vec_id").alias("raw_idx"), (F.col("vec_id") % 2).alias("xflip"), F.col("label").alias("raw_label"))
    return table(spark, sf, "embeddings").select("vec_id", F.to_json(details).alias("details"))


_CLASSES = "(SELECT DISTINCT quality * 2 + toxic AS c FROM labels)"


@query(
    f"""WITH c AS {_CLASSES}, p AS (SELECT DISTINCT lang AS p FROM documents WHERE lang IS NOT NULL)
    SELECT 'forest' AS family, m AS metric, 'class' AS head FROM (VALUES ('accuracy'), ('macro_f1'), ('weighted_f1')) v(m) UNION ALL SELECT 'forest', 'f1[' || c || ']', 'class' FROM c
    UNION ALL SELECT 'two_head', h || m, CASE h WHEN 'plane_' THEN 'plane' ELSE 'class' END FROM (VALUES ('tumour_'), ('plane_')) a(h), (VALUES ('accuracy'), ('macro_f1'), ('weighted_f1')) v(m)
    UNION ALL SELECT 'two_head', 'per_tumour_f1:' || c, 'class' FROM c UNION ALL SELECT 'two_head', 'per_plane_f1:' || p, 'plane' FROM p"""
)
def metric_families(spark, sf):
    """Metrics of both model families: averages, and one for each class and plane that the tables hold."""
    labels, planes = table(spark, sf, "labels").select((F.col("quality") * 2 + F.col("toxic")).cast("string").alias("v")).distinct(), table(spark, sf, "documents").select(F.col("lang").alias("v")).dropna().distinct()
    plain = [("forest", m, "class") for m in ("accuracy", "macro_f1", "weighted_f1")] + [("two_head", f"{h}_{m}", "plane" if h == "plane" else "class") for h in ("tumour", "plane") for m in ("accuracy", "macro_f1", "weighted_f1")]
    out = spark.createDataFrame(plain, "family string, metric string, head string")
    for rows, family, before, after, head in ((labels, "forest", "f1[", "]", "class"), (labels, "two_head", "per_tumour_f1:", "", "class"), (planes, "two_head", "per_plane_f1:", "", "plane")):
        out = out.unionAll(rows.select(F.lit(family).alias("family"), F.concat(F.lit(before), "v", F.lit(after)).alias("metric"), F.lit(head).alias("head")))
    return out


@query(
    """WITH b AS (SELECT doc_id, source, lang, left(sha256('seed-7:' || doc_id), 12) AS blind_id FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY blind_id) AS place FROM b)
    SELECT 'public' AS part, blind_id, lang, place, NULL::VARCHAR AS source, NULL::BIGINT AS doc_id FROM p UNION ALL SELECT 'response', blind_id, lang, place, NULL, NULL FROM p UNION ALL SELECT 'key', blind_id, lang, place, source, doc_id FROM p"""
)
def blinded_export(spark, sf):
    """Three rows an item: what judges see, what they fill in, and the key that alone names the source."""
    blind = F.substring(F.sha2(F.concat(F.lit("seed-7:"), F.col("doc_id").cast("string")), 256), 1, 12)
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", blind.alias("blind_id"))
    placed = ordinals(rows, ["blind_id"], "_at", ["lang"]).withColumn("place", (F.col("_at") + 1)).withColumn("part", F.explode(F.array(*map(F.lit, ("public", "response", "key")))))
    own = F.col("part") == "key"
    return placed.select("part", "blind_id", "lang", "place", F.when(own, F.col("source")).alias("source"), F.when(own, F.col("doc_id")).alias("doc_id"))


@query("SELECT chunk, n, fingerprint, fingerprint = CASE WHEN chunk % 3 = 0 THEN 'stale' ELSE fingerprint END AS valid FROM (SELECT doc_id // 256 AS chunk, count(*) AS n, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1)")
def cache_validity(spark, sf):
    """Parts of a feature cache, 256 ids each, by the content hash they were made from: stale ones are to be made again."""
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.md5("text").alias("h")))), lambda x: x["h"])
    parts = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 256).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(hashes, "")).alias("fingerprint"))
    stored = F.when(F.col("chunk") % 3 == 0, "stale").otherwise(F.col("fingerprint"))
    return parts.select("chunk", "n", "fingerprint", (F.col("fingerprint") == stored).alias("valid"))
