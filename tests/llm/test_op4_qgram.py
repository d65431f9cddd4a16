import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pytest import MonkeyPatch

from sievewright.llm import qgram
from sievewright.llm.common import read


def plain(text):
    return re.sub(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())).strip(b" ")


def distance(pattern, text):
    """Least edit distance of the pattern to any stretch of the text."""
    t = np.frombuffer(text, np.uint8)
    d = np.zeros(len(t) + 1, np.int64)
    k = np.arange(len(t) + 1)
    for c in pattern:
        step = np.r_[d[0] + 1, np.minimum(d[:-1] + (t != c), d[1:] + 1)]
        d = np.minimum.accumulate(step - k) + k
    return int(d.min())


def brute(docs, items):
    parts, out = qgram.windows(items), set()
    for d, text in docs:
        t = plain(text)
        best = {}
        for p in parts:
            if (x := distance(p.text, t)) <= p.budget:
                best[p.item] = min(x, best.get(p.item, x))
        out |= {(d, i, x) for i, x in best.items()}
    return out


def test_table_against_brute_force(spark, sf):
    docs, bench = read(spark, sf, "documents"), read(spark, sf, "benchmark").limit(12)
    got = {(r.doc_id, r.item_id, r.distance) for r in qgram.leaks(spark, docs, bench).collect()}
    rows = [(r.doc_id, r.text[:6000]) for r in docs.collect() if len(r.text) <= 6000]
    own = {d for d, _ in rows}
    assert {g for g in got if g[0] in own} == brute(rows, [(r.item_id, r.text) for r in bench.collect()])


def edited(rng, text, n):
    t = bytearray(text)
    for _ in range(n):
        at, kind = rng.integers(0, len(t)), rng.integers(0, 3)
        if kind == 0:
            t[at] = 97 + rng.integers(0, 26)
        elif kind == 1:
            del t[at]
        else:
            t.insert(at, 97 + rng.integers(0, 26))
    return bytes(t)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 16), st.integers(20, 260))
def test_edited_passages(seed, edits, size):
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join("".join(rng.choice(list("etaoins"), rng.integers(1, 7))) for _ in range(n))
    item = words(80)[:size]
    docs = [words(30) + " " + edited(rng, item.encode(), edits).decode() + " " + words(30), words(90), item, item[: size // 2]]
    index = qgram.Index(qgram.windows([(7, item), (8, words(50))]))
    data = "".join(docs).encode()
    bounds = np.r_[0, np.cumsum([len(d.encode()) for d in docs])]
    got = {(d, i, x) for d, i, x, _, _ in index.search(np.frombuffer(data, np.uint8), bounds)}
    assert got == brute(list(enumerate(docs)), [(7, item), *[(p.item, "") for p in ()]]) | {g for g in got if g[1] == 8}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1 -é\n", max_size=12), max_size=5))
def test_normalisation(texts):
    raw = [t.encode() for t in texts]
    data, at = qgram.normal(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64))
    assert [data[s:e].tobytes() for s, e in zip(at, at[1:])] == [plain(t) for t in texts]


def test_edge_cases(spark, monkeypatch):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix big jars of potion"
    rows = [(1, passage.upper() + "!", 1), (2, None, 1), (3, "", 1), (None, "x " + passage, 1), (4, "z " * 50_000 + passage, 2), (4, passage, 2), (5, "clean text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, passage, "x"), (1, passage, "x"), (2, None, "x"), (3, "short", "x"), (None, passage, "x")], "item_id long, text string, doc_id string")
    for limit in (32_000_000, 50):
        monkeypatch.setattr(qgram, "INDEX_CHARS", limit)
        got = sorted((str(r.doc_id), r.item_id) for r in qgram.leaks(spark, docs, bench).collect())
        assert got == [("1", 1), ("4", 1), ("4", 1), ("None", 1)]
        left = qgram.decontaminate(spark, docs, bench)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert qgram.leaks(spark, docs.limit(0), bench).collect() == []
    assert qgram.leaks(spark, docs, bench.limit(0)).collect() == []
    assert qgram.decontaminate(spark, docs, bench.limit(0)).count() == len(rows)


def test_parts_at_any_offset():
    rng = np.random.default_rng(4)
    item = " ".join("".join(rng.choice(list("etaoinsrhl"), rng.integers(2, 8))) for _ in range(80))
    index = qgram.Index(qgram.windows([(1, item)]))
    size = qgram.SHORT + qgram.SHORT_STEP - 1
    assert size <= 74
    docs = [b"xyz " * 20 + item[s : s + size].encode() + b" xyz" * 20 for s in range(len(item) - size + 1)]
    # a space at either end of a part stays one, as other words stand around it
    bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
    found = {d for d, *_ in index.search(np.frombuffer(b"".join(docs), np.uint8), bounds)}
    assert found == set(range(len(docs)))


def test_decontaminate_uses_items_of_null_id(spark):
    passage = "seven wizards quietly mix big jars of potion behind the old mill at the edge of town"
    docs = spark.createDataFrame([(1, "so " + passage), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage)], "item_id long, text string")
    assert [r.doc_id for r in qgram.decontaminate(spark, docs, bench).collect()] == [2]


def test_short_items_are_sought_as_they_are(spark):
    docs = spark.createDataFrame([(1, "so The ANSWER, is: 42!"), (2, "the answer is 421"), (3, "answer is 42"), (4, None), (5, "yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "answer is 42"), (8, "Answer is 42."), (9, "yes")], "item_id long, text string")
    assert sorted(tuple(r)[:3] for r in qgram.leaks(spark, docs, bench).collect()) == [(1, 7, 0), (1, 8, 0), (3, 7, 0), (3, 8, 0)]
    assert sorted(r.doc_id for r in qgram.decontaminate(spark, docs, bench).collect()) == [2, 4, 5]


def test_qgrams_that_windows_share_are_counted_once(monkeypatch):
    """A text with an item's words, but none of its passages: what is counted follows places of items, not their windows."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoinsrhl"), 9)) for _ in range(60)]
    index = qgram.Index(qgram.windows([(1, " ".join(words))]))
    text = np.frombuffer((" xyz" * 6 + " ").join(rng.choice(words, 5_000)).encode(), np.uint8)
    whole, counted, unique = plain(" ".join(words)), [], np.unique
    places = Counter(whole[i : i + qgram.Q] for i in range(len(whole) - qgram.Q + 1))
    pairs = sum(places[text[i : i + qgram.Q].tobytes()] for i in range(len(text) - qgram.Q + 1))
    monkeypatch.setattr(np, "unique", lambda a, *more, **named: counted.append(len(a)) or unique(a, *more, **named))
    assert index.search(text, np.array([0, len(text)])) == []
    assert 0 < sum(counted) <= 2 * pairs


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 6, 22]), st.sampled_from([16, 1 << 15]), st.sampled_from([1, 500_000]))
def test_crowded_slots_and_small_lots(seed, bits, lookup, pairs):
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join("".join(rng.choice(list("etaoins"), rng.integers(1, 7))) for _ in range(n))
    items = [(1, words(50)), (2, words(20)), (1, words(9)), (3, words(50))]
    items.append((4, items[0][1]))
    docs = [words(9) + " " + edited(rng, t[rng.integers(0, 9) :].encode(), rng.integers(0, 9)).decode() + words(9) for _, t in items] + ["", words(60)]
    bounds = np.r_[0, np.cumsum([len(d.encode()) for d in docs])]
    with MonkeyPatch.context() as m:
        for name, value in (("_BITS", bits), ("LOOKUP", lookup), ("PAIRS", pairs)):
            m.setattr(qgram, name, value)
        found = qgram.Index(qgram.windows(items)).search(np.frombuffer("".join(docs).encode(), np.uint8), bounds)
    assert {h[:3] for h in found} == brute(list(enumerate(docs)), items)
