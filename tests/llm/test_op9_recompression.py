import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import recompression
from sievewright.llm.common import read
from sievewright.llm.wordhash import Words, pack, unpack

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    """Rows (id, text) to (id, number of words, number removed, kept text)."""
    texts = [(d, WORDS.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - size + 1):
            if d is not None:
                k = tuple(w[i : i + size])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in texts:
        cut = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                cut.update(range(i, i + size))
        out.append((d, len(w), len(cut), " ".join(x for i, x in enumerate(w) if i not in cut)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    got = recompression.substring_dedup(spark, read(spark, sf, "documents")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_edge_cases(spark):
    a = " ".join(f"w{i}" for i in range(40))
    runs = "x " * 60
    rows = [
        (4, a, 1), (2, "intro " + a + " end", 1), (9, None, 1), (8, "", 1), (8, a, 1), (8, a, 1), (None, a, 1),
        (20, runs, 1), (21, runs + "y", 1), (22, "q q q " + runs, 1), (23, "z " * 13, 1), (24, "p z z z z z z z z z z z z z q", 1),
        (30, "ab " * 13 + "cd " * 14 + a, None), (31, "ef " + "cd " * 13, 1), (-5, a + " " + a, 1),
        (40, "very " + "long word " * 50_000, 1), (41, "long word " * 7, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = recompression.substring_dedup(spark, docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([r[:2] for r in rows])
    assert recompression.substring_dedup(spark, docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=13, max_size=13), st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_a_window_has_an_anchor_that_its_surroundings_do_not_move(window, before, after):
    def anchors(words):
        data = " ".join(words).encode()
        text = recompression.Text(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
        return set(zip(*(x.tolist() for x in text.anchors())))

    alone, inside = anchors(window), anchors(before + window + after)
    assert alone
    assert {(p + len(before), n, k) for p, n, k in alone} <= inside


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    """First hashes that all words share leave the second to tell windows apart."""
    a, b = (" ".join(f"{x}{i % 5}" for i in range(30)) for x in "vw")
    rows = [(1, a), (2, b), (3, a + " " + b), (4, b)]
    data = " ".join(t for _, t in rows).encode()
    text = recompression.Text(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    keys, checks = np.zeros(3, np.uint64), np.array([5, 1, 5], np.uint64)
    assert [x.tolist() for x in recompression._least(keys, checks, np.array([9, 8, 7]))] == [[0, 0], [1, 5], [8, 7]]
    assert len(set(text.words.check_hashes().tolist())) == 10

    class Table(recompression.SortedHashes):
        def part(self, i):
            return {"key": np.zeros(2, np.uint64), "check": np.array([1, 5], np.uint64), "doc": np.array([8, 7])}

    there, least = recompression._earlier(Table("", np.array([2]), {}), np.zeros(3, np.uint64), np.array([5, 2, 1], np.uint64))
    assert there.tolist() == [True, False, True] and least.tolist() == [7, 0, 8]


def test_packing_round_trip():
    for values in ([], [0], [1, 5, 2**63, 2**64 - 1]):
        assert unpack(pack(np.array(values, np.uint64))).tolist() == values
