import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from sievewright.llm import kneser_ney, wordhash
from sievewright.llm.common import read


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Brute:
    def __init__(self, texts, order):
        self.order = order
        raw = [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = ["<s>", *tokens(t)]
            for k in range(1, order + 1):
                for j in range(max(1, k - 1), len(seq)):
                    raw[k][tuple(seq[j - k + 1 : j + 1])] += 1
        self.uni = raw[1]
        self.adj = [None] * (order + 1)
        self.adj[order] = raw[order]
        for k in range(order - 1, 0, -1):
            left = Counter(g[1:] for g in raw[k + 1])
            self.adj[k] = Counter({g: raw[k][g] if g[0] == "<s>" else left[g] for g in raw[k]})
        self.d, self.ctx = [None] * (order + 1), [None] * (order + 1)
        for k in range(1, order + 1):
            n = Counter(self.adj[k].values())
            self.d[k] = kneser_ney.discounts(n[1], n[2], n[3], n[4])
            self.ctx[k] = defaultdict(list)
            for g, c in self.adj[k].items():
                self.ctx[k][g[:-1]].append(c)
        self.seen = {}
        self.n, self.v = sum(self.uni.values()), len(self.uni)

    def p(self, gram):
        k = len(gram)
        below = self.p(gram[1:]) if k > 1 else 1 / (self.v + 1)
        c = self.ctx[k].get(gram[:-1])
        if not c:
            return below
        d = self.d[k]
        if gram[:-1] not in self.seen:
            self.seen[gram[:-1]] = sum(c), sum(d[min(x, 3) - 1] for x in c) / sum(c)
        total, gamma = self.seen[gram[:-1]]
        a = self.adj[k].get(gram, 0)
        return (max(a - d[min(a, 3) - 1], 0) if a else 0) / total + gamma * below

    def score(self, text):
        seq = ["<s>", *tokens(text)]
        return sum(math.log10(self.p(tuple(seq[max(0, j - self.order + 1) : j + 1]))) for j in range(1, len(seq)))


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_brute_force(spark, sf, order):
    docs = read(spark, sf, "documents")
    rows = docs.collect()
    model = Brute([r.text for r in rows if crc32(str(r.doc_id).encode()) % 5 != 1], order)
    got = {r.doc_id: r for r in kneser_ney.lm_scores(spark, docs, order).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, t = got[r.doc_id], tokens(r.text)
        assert (g.held_out, g.n_tokens, g.train_tokens) == (crc32(str(r.doc_id).encode()) % 5 == 1, len(t), model.n)
        assert g.n_known == sum((w,) in model.uni for w in t)
        base = sum(math.log10((model.uni[(w,)] + 0.5) / (model.n + 0.5 * (model.v + 1))) for w in t)
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert g.score == pytest.approx(model.score(r.text), rel=1e-5)


def test_better_than_unigrams_on_held_out_texts(spark, sf):
    held = [r for r in kneser_ney.lm_scores(spark, read(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "A a  B", 1), (3, "a A b", 1), (None, "zzz", 2), (4, "x " * 100_000, None), (5, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    for order in (2, 3):
        got = kneser_ney.lm_scores(spark, docs, order).collect()
        assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
        assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert kneser_ney.lm_scores(spark, docs.limit(0)).collect() == []
    one = kneser_ney.lm_scores(spark, docs.filter("doc_id = 5 or doc_id is null")).collect()
    assert all(math.isfinite(r.score) for r in one)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "a b b", "c a", "d"]
    model = Brute(texts, 3)
    words = [g[0] for g in model.uni] + ["unknown"]
    for context in (("<s>",), ("<s>", "a"), ("a", "b"), ("b", "never")):
        assert sum(model.p((*context, w)) for w in words) == pytest.approx(1)


def test_query_is_of_order_three(spark, sf, monkeypatch):
    from sievewright.llm import queries

    want = {r.doc_id: r.score for r in kneser_ney.lm_scores(spark, read(spark, sf, "documents"), 3).collect()}
    got = {r.doc_id: r.score for r in queries.op8_lm_scores(spark, sf).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("bits", [1, 2, 3, 7, 46, 63, 64])
def test_spread_is_a_bijection(bits):
    x = np.arange(1 << bits, dtype=np.uint64) if bits < 8 else np.random.default_rng(1).integers(0, 1 << bits, 5000, dtype=np.uint64)
    keys = wordhash.spread(x, bits)
    assert wordhash.unspread(keys, bits).tolist() == x.tolist() and len(set(keys.tolist())) == len(set(x.tolist()))
    assert not (keys & np.uint64((1 << (64 - bits)) - 1)).any()


def test_columns_come_back_as_they_were(tmp_path):
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 300, 4000, dtype=np.uint64) % np.uint64(257)
    counts[5] = 1 << 40
    gamma = rng.integers(0, 50, 4000).astype(np.float32) / np.float32(7)
    wide = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    arrays = {"key": np.arange(4000, dtype=np.uint64), "raw": counts, "gamma": gamma, "check": wide}
    wordhash.SortedHashes.write(f"file://{tmp_path}", 0, arrays)
    part = wordhash.SortedHashes(f"file://{tmp_path}", np.array([4000]), {"key": "<u8", "raw": "<u8", "gamma": "<f4", "check": "<u8"}).part(0)
    assert isinstance(part["raw"], wordhash.Narrow) and isinstance(part["gamma"], wordhash.Coded)
    at = rng.integers(0, 4000, 900)
    for name, values in arrays.items():
        assert np.asarray(part[name][at]).tolist() == values[at].tolist()
        assert np.asarray(part[name][3:2000]).tolist() == values[3:2000].tolist()
    assert np.asarray(part["raw"]).tolist() == counts.tolist()


def test_packed_keys():
    rng = np.random.default_rng(3)
    for n, bits in ((1, 46), (16, 20), (17, 20), (5000, 38)):
        keys = np.unique(wordhash.spread(rng.integers(0, 1 << bits, n, dtype=np.uint64), bits))
        packed = wordhash.Packed(*wordhash.Packed.of(keys))
        assert np.asarray(packed).tolist() == keys.tolist() and packed[np.array([0, len(keys) - 1])].tolist() == keys[[0, -1]].tolist()
        other = wordhash.spread(rng.integers(0, 1 << bits, 2000, dtype=np.uint64), bits)
        asked = np.sort(np.concatenate([keys, other, keys + np.uint64(1), [np.uint64(0)]]))
        at, hit = packed.search(asked)
        assert hit.tolist() == np.isin(asked, keys).tolist() and (keys[at[hit]] == asked[hit]).all()
    assert wordhash.Packed.of(np.array([1, 1 << 60], np.uint64)) is None
