import re
from collections import defaultdict

import pytest

from sievewright.llm import line_templates as lt
from sievewright.llm.common import read


def brute(rows, min_docs=10, share=0.7, depth=3, least=3, long=20, copies=2):
    def tokens(line):
        return ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]

    def raw(line):
        return tuple(re.findall(r"[^\x20\x09-\x0D]+", line))

    docs = [(k, d, [(x, tokens(x)) for x in (t or "").split("\n")]) for k, (d, t) in enumerate(rows)]
    leaves, places, found = defaultdict(set), defaultdict(set), defaultdict(set)
    leaf = lambda w: (len(w), *w[:depth])
    for k, _, lines in docs:
        for _, w in lines:
            if len(w) >= least:
                leaves[leaf(w)].add(k)
                for i, x in enumerate(w[depth:]):
                    places[leaf(w), i, x].add(k)

    def template(w):
        if len(w) < least or len(leaves[leaf(w)]) < min_docs:
            return None
        t = [x if len(places[leaf(w), i, x]) >= min_docs else None for i, x in enumerate(w[depth:])]
        return (leaf(w), *t) if depth + sum(x is not None for x in t) >= share * len(w) else None

    for k, _, lines in docs:
        for _, w in lines:
            if t := template(w):
                found[t].add(k)
    same = defaultdict(set)
    for k, _, lines in docs:
        for x, w in lines:
            if long is not None and len(w) >= long:
                same[raw(x)].add(k)
    key = lambda d: (d is None, d or 0)
    first = {t: min((docs[k][1] for k in ks), key=key) for t, ks in found.items() if len(ks) >= min_docs}
    again = {x: min((docs[k][1] for k in ks), key=key) for x, ks in same.items() if len(ks) >= copies}
    goes = lambda x, w, d: ((t := template(w)) in first and key(first[t]) < key(d)) or ((r := raw(x)) in again and key(again[r]) < key(d))
    out = []
    for _, d, lines in docs:
        keep = [x for x, w in lines if not goes(x, w, d)]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 10])
def test_query_against_brute_force(spark, sf, min_docs):
    docs = read(spark, sf, "documents")
    got = lt.line_dedup(spark, docs, lt.Rules(min_docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], min_docs)


def test_long_lines_recur_from_two_documents_on(spark):
    long = " ".join(f"word{i}" for i in range(20))
    rows = [(2, f"one\n{long}"), (1, f"{long}\ntwo"), (1, f"{long.replace(' ', '  ')}\nmore"), (3, long.replace("word7", "word8")), (4, " ".join(long.split()[:19])), (5, " ".join(long.split()[:19]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lt.line_dedup(spark, docs).collect()), key=str)
    assert got == brute(rows) and [r[2] for r in got] == [0, 0, 1, 0, 0, 0]
    off = lt.line_dedup(spark, docs, lt.Rules(long_tokens=None)).collect()
    assert sorted((tuple(r) for r in off), key=str) == brute(rows, long=None) and not any(r.n_dropped for r in off)


def test_variable_fields_and_edge_cases(spark):
    rows = [(i, f"{'yz'[i % 2] * (i + 1)} stands alone here\nPosted by user user{i} on Monday at noon\n\nshort one\nAll rights reserved.") for i in range(12)]
    rows += [(50, f"Posted by user {name} on Monday at noon") for name in ("ann", "bob")]
    rows += [(None, None), (60, ""), (61, "\n\n"), (62, "a b c " * 40_000), (None, "All rights reserved.\nend"), (3, "All rights reserved.")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_lines int")
    got = sorted((tuple(r) for r in lt.line_dedup(spark, docs).collect()), key=str)
    assert got == brute(rows)
    by = {r[0]: r for r in got if r[0] in (0, 5)}
    assert by[0][2] == 0 and by[5][2] == 2 and "zzzzzz stands alone here" in by[5][3]
    whole = lt.without_templates(spark, docs)
    assert whole.columns == docs.columns
    assert sorted(str((r.doc_id, r.text or "")) for r in whole.collect()) == sorted(str((r[0], r[3])) for r in got)
    assert lt.line_dedup(spark, docs.limit(0)).collect() == []
