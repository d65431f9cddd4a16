"""Prefix trie of conversations from mergeable partial tries.

A node is a distinct sequence of first turns. Its key is a sum over these turns of hashes that know
their depth, so the keys of a conversation are running sums: a conversation may be cut into pieces
at any turn, and the pieces are keyed side by side once the sums before each piece are known. Turns
are dealt by range of (conversation, turn), hence a conversation of any share of all rows spreads
over tasks.

Each task combines the nodes of its turns (members, least member); tables of a few hundred tasks at
a time are merged by key, again and again until one is left. End lists stay in one sorted chunk for
each range of conversations and are merged in that order by the digest, as a stream: no row and no
task holds a list. What only one conversation reaches is a chain and needs no rollup. For the nodes
that are shared, sums over subtrees grow bottom up by doubling: in round r a node takes what the
nodes 2^r levels below it have gathered, so their number is the logarithm of the depth.

Defined results: turns of equal number are in order of the SHA-256 of (length of the role in
characters, colon, role, text), a null turn comes first; null roles and texts are empty, rows that
repeat are turns of their own, rows of null conv_id take no part; an empty table has no node, not
even a root; texts count whole; further columns are ignored. ``%`` takes the sign of its left side.
Keys are 128 bits of hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Partial tables that one merge joins into one.
FAN = 256
#: A parent of more than this share of all nodes is joined by broadcast: there are at most so many.
HEAVY = 1000
PIECE, KEY, PARENT = ["conv_id", "part"], ["k1", "k2"], ["p1", "p2"]
LANES = ["l1", "l2", "l3", "l4"]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ordered_turns(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order, and the pieces of conversations that fell to one task.

    Turns (conv_id, part, at, id, words): ``at`` grows by one within a piece. Pieces (conv_id, part,
    lo, before, total, home): the piece's first ``at``, the turns before it, all turns of the
    conversation, and the part that holds its end.
    """
    role, text = text_of("role"), text_of("text")
    id_ = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    known = conversations.filter(F.col("conv_id").isNotNull())
    slim = cut(spark, known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", id_.alias("id"), word_count(text).alias("words"), F.monotonically_increasing_id().alias("row")), "turns")
    order = ["conv_id", "turn", "id", "row"]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = cut(spark, dealt.select("conv_id", "id", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered")
    own = Window.partitionBy("conv_id")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = turns.groupBy(*PIECE).agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    return turns, pieces.select(*PIECE, "lo", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"), F.max("part").over(own).alias("home"))


def rebuilt(spark: SparkSession, conversations: DataFrame, every: int | None = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, depth, id, words, home, last) and conversations (conv_id, home, length).

    The first h turns of conversation c are those of conversation c - c % every, h = crc32(c) % most;
    where that has fewer, its all, where there is none, none. ``every`` None leaves conversations as they are.
    """
    turns, pieces = ordered_turns(spark, conversations)
    pieces = cut(spark, pieces, "pieces")
    place = F.col("at") - F.col("lo") + F.col("before")
    ends = pieces.filter("part = home").select("conv_id", "home", "total")
    if every is None:
        convs = ends.withColumns({"h": F.lit(0), "head": F.array().cast("array<struct<place:bigint,id:binary,words:bigint>>")})
    else:
        first = pieces.filter((F.col("before") < most - 1) & (F.col("conv_id") % every == 0))
        heads = turns.join(first, PIECE).withColumn("place", place).filter(F.col("place") < most - 1)
        heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "words"))).alias("found"))
        ends = ends.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % every})
        convs = ends.join(heads, "base", "left").withColumn("head", F.when(F.col("found").isNotNull(), F.slice("found", 1, F.col("h"))).otherwise(F.array()))
    convs = convs.select("conv_id", "home", "h", "head", F.size("head").alias("k"), (F.size("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length"))
    convs = cut(spark, convs, "conversations")
    info = pieces.select(*PIECE, "lo", "before").join(convs.drop("head"), "conv_id")
    own = turns.join(info, PIECE).withColumn("place", place).filter("place >= h")
    depth = {"own": F.col("k") + F.col("place") - F.col("h") + 1, "head": (F.col("i") + 1).cast("long")}
    tail = ["id", "words", "home", (F.col("depth") == F.col("length")).alias("last")]
    own = own.withColumn("depth", depth["own"]).select(*PIECE, "depth", *tail)
    head = convs.select("conv_id", F.lit(-1).alias("part"), "home", "length", F.posexplode("head").alias("i", "t")).withColumn("depth", depth["head"])
    head = head.select(*PIECE, "depth", F.col("t.id").alias("id"), F.col("t.words").alias("words"), *tail[2:])
    return cut(spark, own.unionByName(head), "rebuilt"), convs.select("conv_id", "home", "length")


def _key(sums: list[Column], names: list[str]) -> list[Column]:
    return [F.xxhash64(*sums).alias(names[0]), F.xxhash64(F.lit(1), *sums[::-1]).alias(names[1])]


def _root() -> list[Column]:
    return _key([F.lit(0).cast("long")] * 4, KEY)


def keyed(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Turns with the keys of their node and of its parent, and the task that made them."""
    x = [F.xxhash64("id", "depth"), F.xxhash64(F.lit(1), "depth", "id")]
    halves = [f for h in x for f in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    laned = turns.withColumns(dict(zip(LANES, halves)))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = laned.groupBy(*PIECE).agg(*[F.sum(x).alias(x) for x in LANES])
    before = sums.select(*PIECE, *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"{x}_before") for x in LANES])
    running = Window.partitionBy(*PIECE).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    upto = [F.sum(x).over(running) + F.col(f"{x}_before") for x in LANES]
    joined = laned.join(before, PIECE).select("*", *[s.alias(f"{x}_upto") for s, x in zip(upto, LANES)])
    s = [F.col(f"{x}_upto") for x in LANES]
    p = [F.col(f"{x}_upto") - F.col(x) for x in LANES]
    return cut(spark, joined.select("conv_id", "depth", "words", "home", "last", *_key(s, KEY), *_key(p, PARENT), F.spark_partition_id().alias("slot")), "keyed")


def merged(members: DataFrame, tables: int, fan: int = FAN) -> DataFrame:
    """One table of nodes from the rows that ``tables`` tasks made of their members."""
    kept = [F.max(x).alias(x) for x in ("depth", "words", *PARENT)]
    nodes = members.select(*KEY, *PARENT, "depth", "words", "slot", F.col("conv_id").alias("first"), F.lit(1).cast("long").alias("n"))
    while True:
        tables = max(1, -(-tables // fan))
        nodes = nodes.groupBy(*KEY, (F.col("slot") % tables).alias("slot")).agg(*kept, F.min("first").alias("first"), F.sum("n").alias("n"))
        if tables == 1:
            return nodes.drop("slot")


def _digests(batches):
    """Over rows (k1, k2, ids) in order: the SHA-256 of each node's ids, joined by commas."""
    now, state = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = ",".join(map(str, ids.values.to_numpy().tolist())).encode()
            if (k1, k2) == now:
                state.update(b"," + text)
                continue
            if now:
                out.append((*now, state.hexdigest()))
            now, state = (k1, k2), hashlib.sha256(text)
        yield _rows(out)
    if now:
        yield _rows([(*now, state.hexdigest())])


def _rows(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])


def rolled_up(spark: SparkSession, shared: DataFrame, rows: DataFrame) -> DataFrame:
    """Sums of leaves and saved over the subtrees of ``shared`` (k1, k2, first, depth, leaves, saved).

    ``rows`` (conv_id, depth, k1, k2) name the node of each turn: the node 2^r levels up is that of the
    least member, one row each, so no lookup meets a hot key.
    """
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    state = shared.select(*KEY, "leaves", "saved")
    if not deepest:
        return state
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2("depth")).cast("int")), lambda r: F.struct(r.alias("r"), (F.col("depth") - F.pow(F.lit(2), r).cast("long")).alias("to")))
    wanted = shared.filter("depth > 0").select(*KEY, F.col("first").alias("conv_id"), F.explode(steps).alias("s")).select(*KEY, "conv_id", "s.r", F.col("s.to").alias("depth"))
    up = rows.select("conv_id", "depth", F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    root = [c.alias(f"u{i + 1}") for i, c in enumerate(_root())]
    jumps = wanted.filter("depth > 0").join(up, ["conv_id", "depth"]).select(*KEY, "r", "u1", "u2").unionByName(wanted.filter("depth = 0").select(*KEY, "r", *root))
    jumps = cut(spark, jumps, "ancestors")
    for r in range(int(np.log2(deepest)) + 1):
        given = state.join(jumps.filter(F.col("r") == r), KEY).groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2"))
        given = given.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        state = state.join(given, KEY, "left").select(*KEY, *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("leaves", "saved")])
        state = cut(spark, state, "rollup")
    return state


def prefix_trie(spark: SparkSession, turns: DataFrame, convs: DataFrame, fan: int = FAN) -> DataFrame:
    """One row for each node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = keyed(spark, turns)
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "home", (F.col("length") == 0).alias("last"), *_root(), *[F.lit(None).cast("long").alias(p) for p in PARENT], F.spark_partition_id().alias("slot"))
    members = rows.unionByName(tops)
    tables = (members.agg(F.max("slot")).first()[0] or 0) + 1
    nodes = cut(spark, merged(members, tables, fan), "nodes")
    kids = nodes.filter("depth > 0").groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY)]).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n") == 1).alias("alone"))
    nodes = cut(spark, nodes.join(kids, KEY, "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_children", "alone")}), "nodes")

    chunks = members.filter("last").groupBy(*KEY, "home").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    ends = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "home").select(*KEY, "ids").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")

    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("alone")).cast("long")
    shared = nodes.filter("n > 1").select(*KEY, "first", "depth", leaves.alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    sums = rolled_up(spark, shared, rows)

    total = nodes.count()
    above = nodes.select(*[F.col(k).alias(p) for p, k in zip(PARENT, KEY)], F.col("first").alias("parent_conv_id"), "n_children")
    heavy = F.broadcast(above.filter(F.col("n_children") * HEAVY > total).drop("n_children"))  # at most HEAVY rows
    light = above.filter((F.col("n_children") * HEAVY <= total) & (F.col("n_children") > 0)).drop("n_children")
    named = nodes.join(heavy, PARENT).unionByName(nodes.join(heavy, PARENT, "left_anti").join(light, PARENT, "left"), allowMissingColumns=True)
    out = named.join(sums, KEY, "left").join(ends, KEY, "left")
    return out.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(spark: SparkSession, conversations: DataFrame, every: int | None = 20, most: int = 4, fan: int = FAN) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), rebuilt as ``rebuilt`` says."""
    return prefix_trie(spark, *rebuilt(spark, conversations, every, most), fan)


def oracle_sql() -> str:
    """The same rows for ``every`` 20 and ``most`` 4; CRC-32 is worked out bit by bit, by its fixed polynomial."""
    return """WITH RECURSIVE bytes AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, s, 0 AS i, 4294967295::BIGINT AS r FROM bytes UNION ALL
    SELECT c, s, i + 1, list_reduce([xor(r, ascii(s[i + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) FROM crc WHERE i < length(s)),
h AS (SELECT c, (xor(r, 4294967295::BIGINT) % 4)::INT AS h FROM crc WHERE i = length(s)),
t AS (SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
k AS (SELECT h.c, h.h, c.n, least(h.h, coalesce(b.n, 0)) AS k FROM h JOIN n c ON c.c = h.c LEFT JOIN n b ON b.c = h.c - h.c % 20),
own AS (SELECT t.c, k.k + t.i - k.h + 1 AS d, t.id, t.words FROM t JOIN k ON k.c = t.c WHERE t.i >= k.h
    UNION ALL SELECT k.c, t.i + 1, t.id, t.words FROM k JOIN t ON t.c = k.c - k.c % 20 AND t.i < k.k
    UNION ALL SELECT c, 0, '', 0 FROM k),
r AS (SELECT c, d, words, md5(string_agg(id, ',') OVER (PARTITION BY c ORDER BY d)) AS key, max(d) OVER (PARTITION BY c) = d AS last FROM own),
p AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent FROM r),
nodes AS (SELECT key, min(c) AS conv_id, max(d) AS depth, max(parent) AS parent, max(words) AS words, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
sums AS (SELECT p.key, sum((coalesce(n_children, 0) = 0)::INT) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens FROM nodes u LEFT JOIN kids ON kids.key = u.key JOIN p ON p.c = u.conv_id AND p.d <= u.depth GROUP BY p.key)
SELECT u.conv_id, u.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, u.ends_sha256
FROM nodes u JOIN sums ON sums.key = u.key LEFT JOIN kids ON kids.key = u.key LEFT JOIN nodes a ON a.key = u.parent"""
