import itertools
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import simhash
from sievewright.llm.common import read


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    """From (id, fingerprint) pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{fp:016x}", least.get(find(i))) for i, (doc, fp) in enumerate(fps)), key=str)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in read(spark, sf, "documents").collect()]
    got = simhash.simhash_components(spark, read(spark, sf, "documents")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(docs)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(5, "a b c d e", 1), (3, "A b  c\td e", 1), (9, None, 1), (7, "", 1), (7, "", 1), (None, "x", 1), (2, "x", None), (1, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.simhash_components(spark, docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components([(d, brute_fingerprint(t)) for d, t, _ in rows])
    assert simhash.simhash_components(spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [1, 3, 4])
@pytest.mark.parametrize("family", [0, 1, 2])
def test_masks_cover_every_pair(radius, family):
    rng = np.random.default_rng(7)
    masks = simhash.covering_masks(radius, family)
    for _ in range(500):
        gap = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(gap & m == 0 for m in masks)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 63), min_size=2, max_size=60), st.booleans())
def test_bucket_links_connect_as_all_pairs(bits, divided):
    fps = np.unique(np.cumsum([1 << b for b in bits], dtype=np.uint64))
    old, simhash.DIRECT = simhash.DIRECT, 3 if divided else 4096
    try:
        edges = [(int(x), int(y)) for a, b in simhash.links(fps, 4) for x, y in zip(a, b)]
    finally:
        simhash.DIRECT = old

    def classes(pairs):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for f in root:
            groups.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    everything = [(a, b) for a, b in itertools.combinations(map(int, fps), 2) if (a ^ b).bit_count() <= 4]
    assert classes(edges) == classes(everything)
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
