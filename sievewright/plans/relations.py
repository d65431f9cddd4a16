"""Projections, parsers, groupings, sets, policies and documents built from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational, sampling
from ..session import table
from .inputs import VECTORS, sql_mix, vectors
from .register import Register

REGISTER = query = Register()


@query(
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS base,
    len(string_split(url, '/'))::INT AS depth, CASE WHEN contains(url, '/en/') THEN 'en' WHEN contains(url, '/de/') THEN 'de' ELSE '?' END AS plane FROM pages"""
)
def manifest_parse(spark, sf):
    url = F.col("url")
    path = F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")
    plane = F.when(F.contains(url, F.lit("/en/")), "en").when(F.contains(url, F.lit("/de/")), "de").otherwise("?")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host"), F.element_at(path, -1).alias("base"), F.size(F.split(url, "/")).alias("depth"), plane.alias("plane"))


@query("SELECT c_custkey, lower(string_split(c_name, '#')[1]) AS kind, string_split(c_name, '#')[2]::BIGINT AS number, lpad((c_custkey % 1000)::VARCHAR, 6, '0') AS padded, 'req-' || lpad(c_custkey::VARCHAR, 6, '0') AS request_id FROM customer")
def name_tokens(spark, sf):
    parts = F.split("c_name", "#")
    return table(spark, sf, "customer").select(
        "c_custkey", F.lower(parts[0]).alias("kind"), parts[1].cast("long").alias("number"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 6, "0").alias("padded"), F.format_string("req-%06d", "c_custkey").alias("request_id")
    )


@query("SELECT p_partkey, lower(string_split(p_type, ' ')[1]) AS first, lower(list_extract(string_split(p_type, ' '), -1)) AS last, CASE WHEN len(string_split(p_type, ' ')) >= 3 THEN 'ok' ELSE 'short' END AS reason FROM part")
def type_tokens(spark, sf):
    t = F.split("p_type", " ")
    return table(spark, sf, "part").select("p_partkey", F.lower(t[0]).alias("first"), F.lower(F.element_at(t, -1)).alias("last"), F.when(F.size(t) >= 3, "ok").otherwise("short").alias("reason"))


_STEM = """CASE doc_id % 7 WHEN 0 THEN 'scan_' || lang || '_' || doc_id WHEN 1 THEN 'a' || lang || 'b_' || doc_id WHEN 2 THEN 'scan_' || upper(lang) || '_1' WHEN 3 THEN lang WHEN 4 THEN source || '__' || lang || '__x' WHEN 5 THEN 'en_' || lang || '_2' ELSE '' END"""


@query(
    f"""WITH n AS (SELECT doc_id, {_STEM} AS stem FROM documents)
    SELECT doc_id, stem, coalesce(list_filter(string_split(stem, '_'), lambda t: t IN ('en', 'de'))[1], CASE WHEN contains(stem, '_en_') THEN 'en' WHEN contains(stem, '_de_') THEN 'de' END) AS plane FROM n"""
)
def token_in_name(spark, sf):
    """The plane in a name: a token of its own, in its own case; inside another token or in capitals it is none."""
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_STEM).alias("stem"))
    return rows.select("doc_id", "stem", S.token_in(F.col("stem"), ["en", "de"]).alias("plane"))


@query(
    """SELECT p_partkey, (p_size % 9) || ',' || (p_size + 10) || '-' || (p_size + 10 + p_partkey % 4) AS spec, list_concat([(p_size % 9)::INT], range((p_size + 10)::INT, (p_size + 11 + p_partkey % 4)::INT)::INT[]) AS numbers,
    p_size::INT AS first, (p_partkey % 50)::INT AS second FROM part"""
)
def range_lists(spark, sf):
    """Lists of numbers and ranges, and pairs, read from text."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    low, high = (F.col("p_size") + 10), F.col("p_size") + 10 + key % 4
    spec = F.concat((F.col("p_size") % 9).cast("string"), F.lit(","), low.cast("string"), F.lit("-"), high.cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", spec.alias("spec"), F.concat(size, F.lit("x"), (key % 50).cast("string")).alias("pair"))
    return rows.select("p_partkey", "spec", S.integer_list(F.col("spec")).alias("numbers"), S.pair_of(F.col("pair"))["first"].alias("first"), S.pair_of(F.col("pair"))["second"].alias("second"))


@query("SELECT DISTINCT l_quantity / 4 AS ratio, 'r' || regexp_replace((l_quantity / 4)::DOUBLE::VARCHAR, '\\.0$', '') AS tag FROM lineitem")
def ratio_tags(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_quantity") / 4).alias("ratio")).distinct().withColumn("tag", S.ratio_tag(F.col("ratio")))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS number, (json_extract(props, '$.k'))::INT AS k, CASE WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'middle' ELSE 'high' END AS band FROM events")
def json_fields(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", S.numeric_or_null(F.regexp_extract("props", "[0-9]+", 0)).alias("number"), F.from_json("props", "k int")["k"].alias("k"), F.when(v <= 10, "low").when(v <= 50, "middle").otherwise("high").alias("band")
    )


@query("SELECT event_id, '{\"event\":' || event_id || ',\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}' AS document, 'data:text/plain;base64,' || base64(event_type::BLOB) AS url FROM events")
def request_json(spark, sf):
    doc = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("user_id").alias("user"), F.col("event_type").alias("type")))
    return table(spark, sf, "events").select("event_id", doc.alias("document"), F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("event_type").cast("binary"))).alias("url"))


@query("SELECT vec_id, list_transform(range(10), lambda i: (i = label)::INT) AS one_hot, label * 3 + (vec_id % 3)::INT AS combined FROM embeddings")
def label_encoding(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.one_hot(F.col("label"), 10).alias("one_hot"), (F.col("label") * 3 + (F.col("vec_id") % 3).cast("int")).alias("combined"))


@query("SELECT p, CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT round(o_orderkey % 997 / 9970.0, 6)::DOUBLE AS p FROM orders) t")
def significance(spark, sf):
    p = F.round(F.col("o_orderkey") % 997 / 9970.0, 6)
    return table(spark, sf, "orders").select(p.alias("p")).withColumn("stars", S.significance_stars(F.col("p")))


@query(
    """SELECT s, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's'
    WHEN s < 86400 THEN (s // 3600) || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' ELSE (s // 86400) || 'd ' || lpad((s // 3600 % 24)::VARCHAR, 2, '0') || 'h' END AS brief FROM (SELECT o_orderkey * 37 AS s FROM orders)"""
)
def durations(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_orderkey") * 37).alias("s")).withColumn("brief", S.brief_duration(F.col("s")))


@query("SELECT doc_id, quality FROM labels WHERE quality = 1 AND toxic IN (0, 1)")
def policy_drop(spark, sf):
    ok = (F.col("quality") == 1) & F.col("toxic").isin(0, 1)
    return relational.mode_policy(table(spark, sf, "labels"), ok, "drop").select("doc_id", "quality")


@query("SELECT doc_id, quality = 1 AS valid FROM labels")
def policy_permissive(spark, sf):
    return relational.mode_policy(table(spark, sf, "labels"), F.col("quality") == 1, "permissive").select("doc_id", "valid")


@query("SELECT doc_id, quality FROM labels")
def policy_failfast(spark, sf):
    return relational.mode_policy(table(spark, sf, "labels"), F.col("quality").isin(0, 1), "failfast").select("doc_id", "quality")


@query("SELECT doc_id FROM labels")
def unique_guard(spark, sf):
    return relational.guard_unique(table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("SELECT lang, source, lang || '|' || source AS key, count(*) AS n FROM documents GROUP BY 1, 2")
def source_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).select("lang", "source", F.concat_ws("|", "lang", "source").alias("key"), "n")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def counts_grouping_sets(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents_grouped")
    return spark.sql("SELECT lang, source, count(*) AS n FROM documents_grouped GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def class_plane_cube(spark, sf):
    return table(spark, sf, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def tier_pivot(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count()
    return rows.select("l_linestatus", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("A", "N", "R")])


@query("SELECT r_name, s, count(n_nationkey) FILTER (n_nationkey % 4 = s) AS n FROM region CROSS JOIN (VALUES (0), (1), (2), (3)) v(s) LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def domain_counts(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    domain = region.crossJoin(F.broadcast(spark.range(4).select(F.col("id").cast("int").alias("s"))))
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), (F.col("n_nationkey") % 4).alias("s"))
    return relational.over_domain(domain, rows, ["k", "s"], n=F.count(F.lit(1))).join(region, "k").select("r_name", "s", "n")


@query(f"WITH {VECTORS}, q AS (SELECT *, count(*) FILTER (is_real) OVER (PARTITION BY combo) AS n, row_number() OVER (PARTITION BY combo, is_real ORDER BY id) AS rn FROM vectors) SELECT id, combo, is_real FROM q WHERE is_real OR rn <= round_even(n * 0.5, 0)")
def ratio_prefix_r05(spark, sf):
    v = vectors(spark, sf).withColumn("source", F.when(F.col("is_real"), "real").otherwise("synthetic"))
    return sampling.ratio_prefix(v, "combo", "source", "real", 0.5, "id").select("id", "combo", "is_real")


@query(f"WITH {VECTORS}, q AS (SELECT *, count(*) FILTER (is_real) OVER (PARTITION BY combo) AS n, row_number() OVER (PARTITION BY combo, is_real ORDER BY id) AS rn FROM vectors) SELECT id, combo, is_real FROM q WHERE is_real OR rn <= round_even(n * 1.0, 0)")
def ratio_prefix_r1(spark, sf):
    v = vectors(spark, sf).withColumn("source", F.when(F.col("is_real"), "real").otherwise("synthetic"))
    return sampling.ratio_prefix(v, "combo", "source", "real", 1.0, "id").select("id", "combo", "is_real")


@query(f"WITH {VECTORS}, q AS (SELECT *, count(*) FILTER (is_real) OVER (PARTITION BY combo) AS n, row_number() OVER (PARTITION BY combo, is_real ORDER BY id) AS rn FROM vectors) SELECT id, combo, is_real FROM q WHERE is_real OR rn <= round_even(n * 2.5, 0)")
def ratio_prefix_r2_5(spark, sf):
    v = vectors(spark, sf).withColumn("source", F.when(F.col("is_real"), "real").otherwise("synthetic"))
    return sampling.ratio_prefix(v, "combo", "source", "real", 2.5, "id").select("id", "combo", "is_real")


_M = sql_mix(42, "doc_id")


@query(f"WITH d AS (SELECT doc_id, lang, source, (doc_id % 3 = 0) AS odd, {_M} AS h FROM documents), q AS (SELECT *, row_number() OVER (PARTITION BY lang, source, odd ORDER BY h, doc_id) AS r, least(count(*) FILTER (odd) OVER (PARTITION BY lang, source), count(*) FILTER (NOT odd) OVER (PARTITION BY lang, source)) AS q FROM d) SELECT doc_id, lang, source, CASE WHEN odd THEN 'a' ELSE 'b' END AS side FROM q WHERE r <= q")
def balanced_sample(spark, sf):
    """As many rows of each side in every stratum of two columns as its rarer side has."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("side"))
    return sampling.balanced(d, ["lang", "source"], "side", ["a", "b"], 42, "doc_id")


@query(f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_M}, doc_id) <= 2")
def fixed_per_stratum(spark, sf):
    return sampling.fixed(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 2, 42, "doc_id")


@query(
    f"""WITH s AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang, source) >= 20 THEN lang || '/' || source WHEN count(*) OVER (PARTITION BY lang) >= 20 THEN lang ELSE 'all' END AS stratum FROM documents),
    q AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_M}, doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s)
    SELECT doc_id, stratum, CASE WHEN r <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * (0.7::DOUBLE + 0.15::DOUBLE), 0) THEN 'validation' ELSE 'test' END AS split FROM q"""
)
def stratified_split(spark, sf):
    """70/15/15 within the finest stratum of twenty rows: both columns, the first, or all."""
    rows = sampling.with_stratum(table(spark, sf, "documents").select("doc_id", "lang", "source"), [["lang", "source"], ["lang"]], 20)
    return sampling.split(rows.select("doc_id", "stratum"), ["stratum"], [("train", 0.7), ("validation", 0.15), ("test", 0.15)], 42, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_ids(spark, sf):
    return relational.without(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations")
def chunk_shard(spark, sf):
    return relational.chunk(table(spark, sf, "conversations").select("conv_id", "turn"), ["turn"], 3, ["conv_id"])


@query("SELECT chunk, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (SELECT conv_id % 7 AS chunk, strlen(text) AS bytes FROM conversations) GROUP BY 1")
def shard_accounting(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") % 7).alias("chunk"), F.octet_length("text").alias("bytes"))
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.sha AS expected, b.sha AS found FROM (SELECT doc_id, md5(text) AS sha FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 0) b USING (doc_id) WHERE a.sha IS DISTINCT FROM b.sha")
def lineage_mismatch(spark, sf):
    d = table(spark, sf, "documents")
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    a = d.filter("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("sha"))
    return relational.compare(a, d.filter("doc_id % 5 <> 0").select("doc_id", F.md5(changed).alias("sha")), "doc_id", "sha")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_lookup(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT n.n_name, r.r_name, count(*) AS suppliers, round(avg(s_acctbal), 6) AS balance FROM supplier JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY 1, 2")
def key_lookup(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.avg("s_acctbal"), 6).alias("balance"))


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 12")
def first_per_group(spark, sf):
    return relational.first_k(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 12)


@query("SELECT 'real' AS source, c_custkey AS id, c_acctbal AS balance, NULL::DOUBLE AS price FROM customer UNION ALL SELECT 'synthetic', p_partkey, NULL, p_retailprice FROM part")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("real").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf, "part").select(F.lit("synthetic").alias("source"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT vec_id, flip, CASE WHEN flip = 1 THEN list_reverse(embedding[1:3]) ELSE embedding[1:3] END AS head FROM embeddings, (VALUES (0), (1)) v(flip)")
def flipped_rows(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("h"), F.explode(F.array(F.lit(0), F.lit(1))).alias("flip"))
    return rows.select("vec_id", "flip", F.when(F.col("flip") == 1, F.reverse("h")).otherwise(F.col("h")).alias("head"))


@query("SELECT l_returnflag AS combo, round(least(100, greatest(0, 100 - 4 * avg(l_discount * 100) - 60 * avg((l_tax > 0.07)::INT))), 6) AS score, round(quantile_cont(l_quantity, 0.95), 6) AS p95, max(l_quantity) AS most, avg((l_tax > 0.07)::INT) > 0.1 OR quantile_cont(l_quantity, 0.95) > 48 AS flagged FROM lineitem GROUP BY 1")
def bg_quality(spark, sf):
    fog, p95 = F.avg((F.col("l_tax") > 0.07).cast("int")), F.percentile("l_quantity", F.lit(0.95))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - 4 * F.avg(F.col("l_discount") * 100) - 60 * fog))
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("combo")).agg(F.round(score, 6).alias("score"), F.round(p95, 6).alias("p95"), F.max("l_quantity").alias("most"), ((fog > 0.1) | (p95 > 48)).alias("flagged"))


@query("WITH q AS (SELECT o_orderstatus AS g, quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders GROUP BY 1) SELECT o_orderkey, floor((least(greatest(o_totalprice, lo), hi) - lo) / (hi - lo + 1e-8) * 255)::INT AS level FROM orders JOIN q ON g = o_orderstatus")
def percentile_rescale(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    q = o.groupBy("o_orderstatus").agg(F.percentile("o_totalprice", F.lit(0.01)).alias("lo"), F.percentile("o_totalprice", F.lit(0.99)).alias("hi"))
    level = (F.least(F.greatest("o_totalprice", "lo"), "hi") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8) * 255
    return o.join(q, "o_orderstatus").select("o_orderkey", F.floor(level).cast("int").alias("level"))


@query(
    """WITH a AS (SELECT l_orderkey AS id, l_linenumber AS attempt, CASE WHEN l_quantity > 8 THEN round(l_discount * 10, 6) END AS coverage FROM lineitem),
    q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (coverage IS NULL)::INT, (CASE WHEN coverage BETWEEN 0.15 AND 0.85 THEN 0 ELSE 1 END), (CASE WHEN coverage BETWEEN 0.15 AND 0.85 THEN attempt END), round(abs(coverage - 0.5), 6), attempt) AS r FROM a)
    SELECT id, CASE WHEN coverage IS NULL THEN 0 ELSE attempt END AS attempt, coalesce(coverage BETWEEN 0.15 AND 0.85, false) AS accepted FROM q WHERE r = 1"""
)
def fallback_cascade(spark, sf):
    """First attempt of acceptable coverage, else the one nearest to a half, else number 0: the mask is all ones where no attempt found anything."""
    found = F.when(F.col("l_quantity") > 8, F.round(F.col("l_discount") * 10, 6))
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("attempt"), found.alias("coverage"))
    ok = F.coalesce(F.col("coverage").between(0.15, 0.85), F.lit(False))
    key = F.struct(F.col("coverage").isNull().cast("int").alias("n"), F.when(ok, 0).otherwise(1).alias("a"), F.when(ok, F.col("attempt")).otherwise(0).alias("b"), F.round(F.abs(F.col("coverage") - 0.5), 6).alias("c"), F.col("attempt").alias("d"))
    which = F.when(F.col("coverage").isNull(), 0).otherwise(F.col("attempt")).alias("attempt")
    return a.groupBy("id").agg(F.min_by(F.struct(which, ok.alias("accepted")), key).alias("m")).select("id", "m.attempt", "m.accepted")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 5 THEN 'quality' WHEN l_discount > 0.08 THEN 'outlier' WHEN l_tax = 0 THEN 'self duplicate' WHEN l_returnflag = 'R' THEN 'reference duplicate' ELSE 'kept' END AS reason FROM lineitem) GROUP BY 1")
def reject_reasons(spark, sf):
    reason = F.when(F.col("l_quantity") < 5, "quality").when(F.col("l_discount") > 0.08, "outlier").when(F.col("l_tax") == 0, "self duplicate").when(F.col("l_returnflag") == "R", "reference duplicate").otherwise("kept")
    return table(spark, sf, "lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT word AS category, role AS source, count(*) AS n FROM (SELECT role, unnest(CASE WHEN len(w) = 0 THEN ['missing'] ELSE w END) AS word FROM (SELECT role, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x IN ('the', 'of', 'and', 'in')) AS w FROM conversations)) GROUP BY 1, 2")
def artifact_explode(spark, sf):
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x.isin("the", "of", "and", "in"))
    rows = table(spark, sf, "conversations").select(F.col("role").alias("source"), F.explode_outer(w).alias("category"))
    return rows.groupBy(F.coalesce("category", F.lit("missing")).alias("category"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT field, l_returnflag AS source, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, count(v) AS n FROM (SELECT l_returnflag, unnest(['discount', 'tax']) AS field, unnest([l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1, 2")
def confidence_unpivot(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot("source", ["discount", "tax"], "field", "v")
    return rows.groupBy("field", "source").agg(F.round(F.avg("v"), 6).alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.count("v").alias("n"))


@query("SELECT event_type AS mode, count(*) AS n, count(*) FILTER (TRY_CAST(json_extract(props, '$.k') AS INT) IS NULL) AS unparsed, count(*) FILTER (TRY_CAST(json_extract(props, '$.k') AS INT) > 50) AS large FROM events GROUP BY 1")
def parse_modes(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.count_if(k.isNull()).alias("unparsed"), F.count_if(k > 50).alias("large"))


@query("SELECT role, count(*) AS n FROM conversations WHERE regexp_full_match(role, '(user|assistant)') GROUP BY 1")
def name_filter(spark, sf):
    return table(spark, sf, "conversations").filter(F.rlike("role", F.lit("^(?:user|assistant)$"))).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT max(o_orderkey) + 1 AS next_id, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS latest FROM orders")
def next_run_id(spark, sf):
    return table(spark, sf, "orders").agg((F.max("o_orderkey") + 1).alias("next_id"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS path, sha256(array_to_string(list(turn || ':' || md5(text) ORDER BY turn), ',')) AS fingerprint FROM conversations GROUP BY 1")
def ordered_fingerprint(spark, sf):
    """Order-sensitive hash of a group's contents."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.md5("text").alias("h")))).alias("r"))
    path = F.array_join(F.transform("r", lambda x: x["role"]), ">")
    return rows.select("conv_id", path.alias("path"), F.sha2(F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["h"])), ","), 256).alias("fingerprint"))
