import itertools
import re

import numpy as np

import corpus_pipeline
from sievewright.llm import resemblance
from sievewright.llm.common import read


def brute_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_kept(rows):
    """Least ids of the components of (id, text) whose resemblance is 0.8 or more."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_stage_keeps_one_of_each_near_copy(spark, sf):
    docs = read(spark, sf, "documents")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert got == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_edits_on_both_sides_of_the_threshold(spark, sf):
    rng = np.random.default_rng(3)
    rows = [(-1, None), (-2, ""), (-3, "two words"), (-4, "Two\twords"), (-5, "three other words")]
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.choice(120, 1 + k % 5, replace=False):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], read(spark, sf, "documents").schema)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert got == brute_kept(rows) and 65 < len(got) < 122


def test_keys_estimate_resemblance():
    rng = np.random.default_rng(9)
    own = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    missed = sum(not (resemblance.band_keys(own[k : k + 90]) == resemblance.band_keys(own[k + 10 : k + 100])).any() for k in range(800))
    assert missed == 0


def test_one_row_of_each_group_whatever_its_ids(spark, sf):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, a), (1, a + " more"), (None, a), (None, b), (None, b + " more"), (7, "other text")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], read(spark, sf, "documents").schema)
    got = sorted((str(r.doc_id), r.text[:2]) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect())
    assert got == [("1", "a0"), ("7", "ot"), ("None", "b0")]


def test_crowds_of_variants(spark, monkeypatch):
    """An original with many variants that resemble it and not each other, and a crowd that has no original."""
    monkeypatch.setattr(resemblance, "CROWD", 4)
    monkeypatch.setattr(resemblance, "BLOCK_NODES", 8)
    base = [f"w{i}" for i in range(60)]

    def variant(*at):
        return " ".join(f"x{k}" if i in at else w for i, w in enumerate(base) for k in [at])

    rows = [(1, variant(30))] + [(i, variant(6 + i)) for i in range(2, 40)] + [(90, " ".join(base))]
    rows += [(100 + i, " ".join(f"y{(k if k % 10 else f'{i}a{k}')}" for k in range(50))) for i in range(12)]
    docs = spark.createDataFrame(rows, "row long, text string")
    for chosen in (rows, rows[:39], rows[40:]):
        got = {r.row: r.component for r in resemblance.resemblance_components(spark, docs.filter(docs.row.isin([r for r, _ in chosen]))).collect()}
        groups = {}
        for r, c in got.items():
            groups.setdefault(c, []).append(r)
        assert sorted(map(min, groups.values())) == sorted(brute_kept(chosen))
