import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import duckdb
import pytest

from sievewright.llm import prefix_trie
from sievewright.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables stay in as many parts as there are shuffle partitions, so that conversations are cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute(rows, every=20, most=4):
    """Rows of the trie, node by node, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % most if every else 0
        base = c - (abs(c) % every) * (1 if c >= 0 else -1) if every else c
        full[c] = (own.get(base, [])[:h] + ts[h:]) if every else ts
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [n for n in members if len(n) == len(node) + 1 and n[:-1] == node]
        ends = ",".join(map(str, sorted(c for c in members[node] if full[c] == list(node))))
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        out[node] = {
            "conv_id": min(members[node]), "depth": len(node), "parent_conv_id": min(members[node[:-1]]) if node else None, "n_convs": len(members[node]),
            "n_children": len(below), "n_leaves": sum(out[n]["n_leaves"] for n in below) or 1,
            "saved_tokens": (len(members[node]) - 1) * words + sum(out[n]["saved_tokens"] for n in below), "ends_sha256": hashlib.sha256(ends.encode()).hexdigest(),
        }
    return sorted((tuple(n.values()) for n in out.values()), key=str)


def of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c * 3, rng.choice([turn, turn, 1, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b\tc", "", None, "ö"])))
    return rows


@pytest.mark.parametrize("fan", [2, 256])
def test_ties_nulls_and_gaps_equal_brute_force(spark, fan):
    rows = some_rows(3, 60, 6) + [(None, 0, "user", "x"), (-7, 0, "user", "a b"), (-7, 0, "user", "a b")]
    got = prefix_trie.conversation_trie(spark, spark.createDataFrame(rows, SCHEMA), fan=fan)
    assert of(got) == brute(rows)


def test_a_long_hot_conversation_and_its_copies(spark):
    """One conversation holds most rows, a copy of it makes its nodes shared over hundreds of levels."""
    long = [(c, t, "user", f"word {t % 7}") for c in (20, 40) for t in range(300)]
    rows = long + [(c, 0, "user", "word 0") for c in range(60, 90)] + [(20, 400 + i, "user", "same") for i in range(40)]
    assert of(prefix_trie.conversation_trie(spark, spark.createDataFrame(rows, SCHEMA).repartition(8))) == brute(rows)


def test_repeated_turns_of_one_number_spread_over_parts(spark):
    rows = [(5, 1, "user", "x y")] * 500 + [(6, 1, "user", "x y")] * 3
    turns, pieces = prefix_trie.ordered_turns(spark, spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert pieces.filter("conv_id = 5").count() > 1 and turns.count() == 503
    assert of(prefix_trie.conversation_trie(spark, spark.createDataFrame(rows, SCHEMA).repartition(6), every=None)) == brute(rows, every=None)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 60) if c % 20]
    got = of(prefix_trie.conversation_trie(spark, spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and any(r[1] == 0 and r[7] != EMPTY for r in got)


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", id string, part int, k1 long, words string, n long")
    assert of(prefix_trie.conversation_trie(spark, none)) == []
    rows = [(20, 0, "user", "a", "x", 1, 2, "w", 3), (21, 0, "user", "a", None, None, None, None, None)]
    assert of(prefix_trie.conversation_trie(spark, spark.createDataFrame(rows, none.schema))) == brute([r[:4] for r in rows])


def test_very_long_turn(spark):
    rows = [(20, 0, "user", "ab " * 400_000), (40, 0, "user", "ab " * 400_000), (60, 0, "user", "ab " * 399_999 + "ac ")]
    assert of(prefix_trie.conversation_trie(spark, spark.createDataFrame(rows, SCHEMA), every=None)) == brute(rows, every=None)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = QUERIES["op11_prefix_trie"](spark, sf)
    want = con.sql(ORACLE["op11_prefix_trie"])
    at = [want.columns.index(c) for c in got.columns]
    assert of(got) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
