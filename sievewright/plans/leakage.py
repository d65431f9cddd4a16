"""Leakage between splits: exact copies, contamination, nearest neighbours, near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import content_hash, let, sign_hash
from ..operators import neighbours, relational, similarity
from ..session import table
from ..shared import kept, ordinals
from .inputs import COSINE, HAMMING, VECTORS, hashes, vectors
from .register import Register

REGISTER = query = Register()
#: The supplied vectors' hashes are at least 14 bits apart.
LIMIT = 18
#: Items of fewer than five words that are looked for at once.
SHORT_ITEMS = 500


def _split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", F.sha2("text", 256).alias("sha"))
    return docs.filter("doc_id % 5 <> 4"), docs.filter("doc_id % 5 = 4")


_SPLIT = "d AS (SELECT doc_id, text, source, sha256(text) AS sha FROM documents), train AS (SELECT * FROM d WHERE doc_id % 5 <> 4), test AS (SELECT * FROM d WHERE doc_id % 5 = 4)"


@query("SELECT sha256(text) AS content_sha256, count(*) AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def identity_clusters(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content_sha256"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n_rows > 1")


@query(f"WITH {_SPLIT} SELECT l.doc_id AS train_id, l.sha AS sha, count(*) AS links, min(r.doc_id) AS first_test_id FROM train l JOIN test r ON l.sha = r.sha AND l.text = r.text GROUP BY 1, 2")
def exact_hash_overlap(spark, sf):
    """Train rows whose text is in test too, with their class and number of links; copies are not expanded into pairs.

    Rows are found by hash and joined on the text itself, so equal hashes of different texts do not count.
    """
    train, test = _split(spark, sf)
    near = relational.only(test.select("doc_id", "sha", "text"), train, "sha")
    found = relational.exact_overlap(relational.only(train.select("doc_id", "sha", "text"), test, "sha"), near, ["sha", "text"], "doc_id")
    return found.select(F.col("doc_id").alias("train_id"), "sha", "links", F.col("first_id").alias("first_test_id"))


@query(
    f"""WITH {_SPLIT}, c AS (SELECT l.sha AS sha, count(DISTINCT l.doc_id) AS train_rows, count(DISTINCT r.doc_id) AS test_rows, count(*) AS links FROM train l JOIN test r ON l.sha = r.sha GROUP BY 1),
    m AS (SELECT doc_id, sha, 'train' AS side FROM train UNION ALL SELECT doc_id, sha, 'test' FROM test)
    SELECT c.sha, train_rows, test_rows, links, side, doc_id, row_number() OVER (PARTITION BY c.sha, side ORDER BY doc_id) AS place FROM c JOIN m ON m.sha = c.sha"""
)
def overlap_clusters(spark, sf):
    """Identities that both sides hold: sizes and links of the class, and one row a member with its place in the sorted list of its side."""
    train, test = _split(spark, sf)
    count = lambda df, n: df.groupBy("sha").agg(F.count_distinct("doc_id").alias(f"{n}_rows"), F.count(F.lit(1)).alias(n))
    classes = count(train, "train").join(count(test, "test"), "sha").select("sha", "train_rows", "test_rows", (F.col("train") * F.col("test")).alias("links"))
    members = train.select("doc_id", "sha", F.lit("train").alias("side")).union(test.select("doc_id", "sha", F.lit("test").alias("side")))
    placed = ordinals(relational.only(members, classes, "sha"), ["doc_id"], "_at", ["sha", "side"])
    return placed.join(classes, "sha").select("sha", "train_rows", "test_rows", "links", "side", "doc_id", (F.col("_at") + 1).alias("place"))


@query(f"WITH {_SPLIT} SELECT doc_id, sha FROM train WHERE sha NOT IN (SELECT sha FROM test)")
def train_minus_test(spark, sf):
    train, test = _split(spark, sf)
    return relational.without(train, test, "sha").select("doc_id", "sha")


@query(f"WITH {_SPLIT} SELECT doc_id, sha FROM train WHERE sha IN (SELECT sha FROM test)")
def removed_train_rows(spark, sf):
    train, test = _split(spark, sf)
    return relational.only(train, test, "sha").select("doc_id", "sha")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def prefix_contamination(spark, sf):
    """Documents that hold a whole item.

    Candidates share the second to fourth word of the item, which are whole words wherever it
    stands; only these words are exploded, and no text travels with them. The items are broadcast
    while they are few, by count; containment of the whole item is checked on what is found.
    Items of fewer than five words are looked for in every document, some thousands at a time; null ones are in none.
    """
    words = lambda c: F.split(c, "[ \n]")
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("head")).dropna()
    keyed = items.filter(F.size(words("head")) >= 5).withColumn("key", F.array_join(F.slice(words("head"), 2, 3), " "))
    short = items.filter(F.size(words("head")) < 5)
    n = items.count()
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def threes(w):
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))

    pieces = docs.select("doc_id", F.explode(F.array_distinct(let(words("text"), threes))).alias("key"))
    found = pieces.join(F.broadcast(keyed) if n <= similarity.BROADCAST_ROWS else keyed, "key").select("doc_id", "item_id", "head").distinct()
    out = docs.join(found, "doc_id").filter(F.contains("text", F.col("head"))).select("doc_id", "item_id")
    lots = -(-short.count() // SHORT_ITEMS)
    for lot in range(lots):  # each lot is one array of bounded size beside every document
        own = short.filter(F.pmod(F.xxhash64("item_id", "head"), F.lit(lots)) == lot).collect()
        items = F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["head"]).alias("head")) for r in own])
        hits = F.filter(items, lambda i: F.contains(F.col("text"), i["head"]))
        if own:
            out = out.unionAll(docs.select("doc_id", F.explode(hits).alias("i")).select("doc_id", "i.item_id"))
    return out


_SUMMARY = {
    "train_rows": "sum(a)", "test_rows": "sum(b)", "train_hashes": "count(a)", "test_hashes": "count(b)", "shared_hashes": "count(a * b)",
    "train_only_hashes": "count(a) - count(a * b)", "test_only_hashes": "count(b) - count(a * b)", "exact_pairs": "sum(a * b)",
    "removed_train_rows": "sum(CASE WHEN b IS NOT NULL THEN a END)", "kept_train_rows": "sum(CASE WHEN b IS NULL THEN a END)",
    "affected_test_rows": "sum(CASE WHEN a IS NOT NULL THEN b END)", "clean_test_rows": "sum(CASE WHEN a IS NULL THEN b END)",
    "largest_train_class": "max(a)", "largest_test_class": "max(b)", "most_links": "max(a * b)",
}
_FLAGS = {f"{side}_{c}s": f"count(CASE WHEN {test} THEN 1 END)" for c in ("source", "lang") for side, test in (("train", "a > 0"), ("test", "b > 0"), ("shared", "a > 0 AND b > 0")) if (side, c) != ("test", "lang")}


def _summary_sql() -> str:
    keys = ", ".join(f"coalesce({e}, 0)::BIGINT AS {n}" for n, e in _SUMMARY.items())
    of = lambda c: ", ".join(f"(SELECT {e} FROM {c}s) AS {n}" for n, e in _FLAGS.items() if n.endswith(f"{c}s"))
    sides = lambda c: f"{c}s AS (SELECT {c}, count(*) FILTER (doc_id % 5 <> 4) AS a, count(*) FILTER (doc_id % 5 = 4) AS b FROM documents WHERE {c} IS NOT NULL GROUP BY 1)"
    return f"""WITH {_SPLIT}, classes AS (SELECT * FROM (SELECT sha, count(*) AS a FROM train GROUP BY 1) FULL JOIN (SELECT sha, count(*) AS b FROM test GROUP BY 1) USING (sha)),
    {sides("source")}, {sides("lang")} SELECT {keys}, {of("source")}, {of("lang")} FROM classes"""


@query(_summary_sql())
def leakage_summary(spark, sf):
    """Twenty sizes, overlaps and extremes of the two sides in one row; classes are counted on each side before they meet."""
    train, test = _split(spark, sf)
    classes = train.groupBy("sha").agg(F.count(F.lit(1)).alias("a")).join(test.groupBy("sha").agg(F.count(F.lit(1)).alias("b")), "sha", "full")
    out = classes.agg(*[F.coalesce(F.expr(e), F.lit(0)).cast("long").alias(n) for n, e in _SUMMARY.items()])
    docs, in_test = table(spark, sf, "documents"), F.col("doc_id") % 5 == 4
    for c in ("source", "lang"):
        sides = docs.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count_if(~in_test).alias("a"), F.count_if(in_test).alias("b"))
        out = out.crossJoin(sides.agg(*[F.expr(e).alias(n) for n, e in _FLAGS.items() if n.endswith(f"{c}s")]))  # one row each
    return out


#: Cutoffs of the audit's report: bits, and cosine distance.
CLOSE_BITS, CLOSE_COSINE = 20, 0.5
_PATH = "lang || '/' || source || '/' || left(md5(coalesce(text, '')), 6) || '.txt'"


def _audit_sql() -> str:
    side = lambda t: f"SELECT doc_id, {_PATH} AS path, left(md5(coalesce(text, '')), 6) || '.txt' AS base, sha256(text) AS sha, left(sha256(text), 4) AS pixel, text FROM documents WHERE doc_id % 5 {t} 4"
    near = lambda d: f"(SELECT a.id, min({d}) AS d FROM hashes a JOIN hashes b ON a.is_test AND NOT b.is_test GROUP BY 1)"
    shared = lambda c: f"(SELECT count(*) FROM (SELECT {c} FROM a INTERSECT SELECT {c} FROM b))"
    return f"""WITH {VECTORS}, a AS ({side("<>")}), b AS ({side("=")}), x AS (SELECT a.doc_id AS i, b.doc_id AS j, a.pixel FROM a JOIN b ON a.pixel = b.pixel AND a.text = b.text),
    h AS {near(HAMMING)}, f AS {near(COSINE)}
    SELECT (SELECT count(*) FROM a) AS train_rows, (SELECT count(*) FROM b) AS test_rows, {shared("path")} AS exact_filepath_overlap, {shared("base")} AS basename_overlap, {shared("sha")} AS file_sha256_overlap,
    (SELECT count(*) FROM a JOIN b ON a.sha = b.sha) AS file_sha256_overlap_pairs, (SELECT count(*) FROM a JOIN b ON a.pixel = b.pixel) AS pixel_hash_candidate_pairs, (SELECT count(*) FROM x) AS pixel_exact_overlap_pairs,
    (SELECT count(DISTINCT i) FROM x) AS pixel_exact_overlap_unique_train_rows, (SELECT count(DISTINCT j) FROM x) AS pixel_exact_overlap_unique_test_rows, (SELECT count(DISTINCT pixel) FROM x) AS pixel_exact_overlap_identities,
    {CLOSE_BITS} AS phash_warning_threshold, (SELECT count(*) FROM h WHERE d <= {CLOSE_BITS}) AS phash_close_neighbors, (SELECT min(d) FROM h) AS min_phash_distance, {CLOSE_COSINE}::DOUBLE AS feature_warning_threshold, 'checked' AS feature_check,
    (SELECT count(*) FROM f WHERE d <= {CLOSE_COSINE}) AS feature_close_neighbors, (SELECT min(d) FROM f) AS min_feature_cosine_distance,
    (SELECT coalesce(list(column_name ORDER BY column_name), []) FROM information_schema.columns WHERE table_name = 'documents' AND regexp_matches(lower(column_name), 'patient|subject|case|study|series')) AS patient_identifier_columns_found,
    false AS patient_level_independence_claim_supported"""


@query(_audit_sql())
def independence_audit(spark, sf):
    """The twenty figures of the audit of two splits: overlaps by path, name and content, rechecked pairs, and near neighbours.

    Pairs are counted from the sizes of classes; the short content key has chance matches that the recheck of the text removes.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.concat(F.substring(F.md5(text), 1, 6), F.lit(".txt"))
    docs = table(spark, sf, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), base)
    d = docs.select("doc_id", path.alias("path"), base.alias("base"), F.sha2("text", 256).alias("sha"), "text", (F.col("doc_id") % 5 == 4).alias("is_test"))
    d = d.withColumn("pixel", F.substring("sha", 1, 4))
    sides = lambda *keys: d.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_if(~F.col("is_test")).alias("a"), F.count_if("is_test").alias("b"))
    both = lambda rows, **out: rows.filter("a > 0 AND b > 0").agg(*[F.coalesce(F.expr(e), F.lit(0)).cast("long").alias(n) for n, e in out.items()])
    contents = sides("pixel", "sha", "text")
    parts = [
        d.agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows")),
        both(sides("path"), exact_filepath_overlap="count(1)"), both(sides("base"), basename_overlap="count(1)"),
        both(sides("sha"), file_sha256_overlap="count(1)", file_sha256_overlap_pairs="sum(a * b)"), both(sides("pixel"), pixel_hash_candidate_pairs="sum(a * b)"),
        both(contents, pixel_exact_overlap_pairs="sum(a * b)", pixel_exact_overlap_unique_train_rows="sum(a)", pixel_exact_overlap_unique_test_rows="sum(b)", pixel_exact_overlap_identities="count(DISTINCT pixel)"),
    ]
    for near, n, limit, least in ((hash_nearest(spark, sf), "phash", CLOSE_BITS, "min_phash_distance"), (cosine_nearest(spark, sf), "feature", CLOSE_COSINE, "min_feature_cosine_distance")):
        parts.append(near.agg(F.lit(limit).alias(f"{n}_warning_threshold"), F.count_if(F.col("distance") <= limit).alias(f"{n}_close_neighbors"), F.min("distance").alias(least)))
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)  # one row each
    found = relational.identifier_columns(docs)
    names = F.array(*[F.lit(c) for c in found]) if found else F.array().cast("array<string>")
    return row.select("*", F.lit("checked").alias("feature_check"), names.alias("patient_identifier_columns_found"), F.lit(bool(found)).alias("patient_level_independence_claim_supported"))


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT sha256(text) FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def hash_intersection(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.filter("doc_id % 2 = 0").select("sha").intersect(docs.filter("doc_id % 2 = 1").select("sha")).agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT doc_id, sha256(concat_ws(chr(0), length(text)::VARCHAR, lang, text)) AS typed_sha, left(md5(text), 16) AS short_md5 FROM documents")
def typed_hashes(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", content_hash(F.length("text").cast("string"), F.col("lang"), F.col("text")).alias("typed_sha"), F.substring(F.md5("text"), 1, 16).alias("short_md5"))


_NEAREST = "min({{'distance': {d}, 'base_id': b.id}})"


def _nearest_sql(distance: str, on: str) -> str:
    return f"""WITH {VECTORS}, p AS (SELECT a.id AS query_id, b.id AS base_id, {distance} AS distance FROM hashes a JOIN hashes b ON a.is_test AND NOT b.is_test {on})
    SELECT query_id, base_id, distance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) = 1"""


@query(_nearest_sql(HAMMING, ""))
def hash_nearest(spark, sf):
    h = hashes(spark, sf)
    return similarity.nearest(h.filter("is_test"), h.filter("not is_test"), "hash", "hamming")


@query(_nearest_sql(HAMMING, "") + " ORDER BY distance, query_id LIMIT 50")
def hash_topk(spark, sf):
    return hash_nearest(spark, sf).orderBy("distance", "query_id").limit(50)


@query(_nearest_sql(COSINE, ""))
def cosine_nearest(spark, sf):
    v = vectors(spark, sf)
    return similarity.nearest(v.filter("is_test"), v.filter("not is_test"), "embedding", "cosine")


@query(_nearest_sql(COSINE, "AND a.combo = b.combo"))
def knn_in_group(spark, sf):
    v = vectors(spark, sf)
    return similarity.nearest(v.filter("is_test"), v.filter("not is_test"), "embedding", "cosine", group="combo")


@query(_nearest_sql(HAMMING, "").replace("SELECT query_id, base_id, distance FROM p QUALIFY", "SELECT count(*) AS close, min(distance) AS least FROM (SELECT * FROM p QUALIFY") + ") WHERE distance <= 20")
def close_neighbours(spark, sf):
    return hash_nearest(spark, sf).filter("distance <= 20").agg(F.count(F.lit(1)).alias("close"), F.min("distance").alias("least"))


@query(f"WITH {VECTORS} SELECT a.id AS left_id, b.id AS right_id, {HAMMING} AS distance FROM hashes a JOIN hashes b ON a.id < b.id AND {HAMMING} <= {LIMIT}")
def hamming_band_join(spark, sf):
    h = hashes(spark, sf).select("id", "hash")
    return similarity.hamming_join(h, h, LIMIT).filter("left_id < right_id")


_RECODED = VECTORS + """,
recoded AS (SELECT id, list_transform(c, lambda x: x > list_aggregate(c, 'median')) AS bits FROM (SELECT id, list_transform(e, lambda x: floor(x * 32) / 32) AS c FROM vectors))"""


def _recoded_sql(limit: int) -> str:
    return f"WITH {_RECODED} SELECT a.id AS left_id, b.id AS right_id, {HAMMING} AS distance FROM hashes a JOIN recoded b ON {HAMMING} <= {limit}"


def _recoded(spark, sf):
    """Hashes of the vectors, and of the same vectors with coarser components, as a stored copy has them."""
    coarse = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 32) / 32)
    return hashes(spark, sf).select("id", "hash"), vectors(spark, sf).select("id", sign_hash(coarse).alias("hash"))


@query(_recoded_sql(7))
def hamming_recoded(spark, sf):
    """Vectors found again among their coarser copies, by bands that must be equal."""
    return similarity.hamming_join(*_recoded(spark, sf), 7)


@query(_recoded_sql(11))
def hamming_recoded_wide(spark, sf):
    """The same within 11 bits, by bands of which one may have two wrong bits."""
    return similarity.hamming_join(*_recoded(spark, sf), 11)


@query(f"WITH {VECTORS} SELECT a.id, a.combo FROM hashes a WHERE NOT a.is_real AND NOT EXISTS (SELECT 1 FROM hashes b WHERE b.is_real AND {HAMMING} <= {LIMIT})")
def hamming_anti(spark, sf):
    h = hashes(spark, sf)
    return relational.without(h.filter("not is_real").select("id", "combo"), similarity.near_rows(h.filter("not is_real"), h.filter("is_real"), LIMIT), "id")


@query(f"WITH {VECTORS} SELECT a.id, a.combo FROM hashes a WHERE NOT a.is_real AND EXISTS (SELECT 1 FROM hashes b WHERE b.is_real AND {HAMMING} <= {LIMIT})")
def hamming_semi(spark, sf):
    h = hashes(spark, sf)
    return relational.only(h.filter("not is_real").select("id", "combo"), similarity.near_rows(h.filter("not is_real"), h.filter("is_real"), LIMIT), "id")


@query(
    f"""WITH {VECTORS}, d AS (SELECT a.id, b.id AS other, a.is_real, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS d FROM vectors a JOIN vectors b ON a.is_real = b.is_real AND a.combo = b.combo)
    SELECT id, is_real, d AS kth FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) = 4"""
)
def kth_neighbour(spark, sf):
    """Distance to the third neighbour within the side and group, itself counted first."""
    v = vectors(spark, sf).withColumn("side", F.concat_ws("/", F.col("combo").cast("string"), F.col("is_real").cast("string")))
    near = neighbours.nearest_k(v, v, "embedding", "euclid", k=4, group="side").filter("rank = 4")
    return v.select("id", "is_real").join(near, v["id"] == near["query_id"]).select("id", "is_real", F.col("distance").alias("kth"))


@query(
    f"""WITH {VECTORS}, dist AS (SELECT a.id AS i, b.id AS j, a.is_real AS ri, b.is_real AS rj, a.combo, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS d FROM vectors a JOIN vectors b ON a.combo = b.combo),
    kth AS (SELECT i, ri, d AS r FROM dist WHERE ri = rj QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 4),
    hit AS (SELECT dist.j, dist.rj, bool_or(dist.d <= kth.r) AS inside FROM dist JOIN kth ON kth.i = dist.i WHERE dist.ri <> dist.rj GROUP BY 1, 2)
    SELECT round(avg(CASE WHEN NOT rj THEN inside::INT END), 6) AS precision, round(avg(CASE WHEN rj THEN inside::INT END), 6) AS recall FROM hit"""
)
def precision_recall(spark, sf):
    """Share of generated rows inside the real manifold, and the other way round, within groups."""
    v = vectors(spark, sf)
    m = kept(v.join(kth_neighbour(spark, sf).select("id", "kth"), "id").select("id", "combo", "is_real", "kth", "embedding"), "manifold")
    both = [neighbours.in_manifold(v.filter(F.col("is_real") == side), m.filter(F.col("is_real") != side), "embedding", "kth", group="combo") for side in (False, True)]
    hit = both[0].union(both[1]).select(F.col("query_id").alias("id"), F.lit(1).alias("inside"))
    probed = v.join(m.select("combo", (~F.col("is_real")).alias("is_real")).distinct(), ["combo", "is_real"], "left_semi")
    rows = probed.join(hit, "id", "left").select("is_real", F.coalesce("inside", F.lit(0)).alias("inside"))
    share = lambda side: F.round(F.avg(F.when(F.col("is_real") == side, F.col("inside"))), 6)
    return rows.agg(share(False).alias("precision"), share(True).alias("recall"))
