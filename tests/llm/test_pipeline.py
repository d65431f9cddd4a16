import re

import corpus_pipeline
from sievewright.llm import pieces, pu_quality
from sievewright.llm.common import read

from test_op2_line_templates import brute as brute_lines
from test_op4_qgram import brute as brute_leaks

def brute_near(rows, size=5, threshold=0.8):
    """Least id of each document's component; links are Jaccard indices of word shingle sets."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) > size else {tuple(w)} - {()}

    sets, first = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}

    def top(d):
        while first[d] != d:
            d = first[d]
        return d

    for k, (d, x) in enumerate(sets):
        for e, y in sets[:k]:
            if len(x & y) >= threshold * len(x | y):
                a, b = sorted((top(d), top(e)))
                first[b] = a
    return {d: top(d) for d, _ in rows}


def test_stages_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    kept = {r.doc_id for r in pu_quality.pu_quality(spark, docs, read(spark, sf, "labels")).collect() if r.score >= 0.3}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    now = docs
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        got = {r.doc_id: r for r in out.collect()}
        sizes.append(len(got))
        if k < 4:
            assert out.columns == docs.columns
        if k == 1:
            rows = [(d, t) for d, _, _, t in brute_lines(rows, long=None)]
        if k == 2:
            parts = brute_near(rows)
            rows = [(d, t) for d, t in rows if parts[d] == d]
        if k == 3:
            short = [(d, t) for d, t in rows if len(t) <= 4000]
            bench = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").limit(10).collect()]
            held = {d for d, _, _ in brute_leaks(short, bench)}
            assert not held & set(got)
            own = lambda t: re.sub(r"[\W_]+", " ", t.lower())
            every = [own(r.text) for r in read(spark, sf, "benchmark").collect()]
            assert all(any(i[:40] in own(t) for i in every) for d, t in rows if d not in got)
            rows = [(d, t) for d, t in rows if d in got]
        if k < 4:
            assert {d: r.text for d, r in got.items()} == dict(rows), name
            now = spark.createDataFrame(list(got.values()), docs.schema) if got else out
        else:
            model = pieces.Pieces(__import__("public_tokenizers").path("piece_bpe_32k.model"))
            assert {d: model.decode(r.ids) for d, r in got.items()} == dict(rows)
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0] < docs.count()
    last = corpus_pipeline.run(spark, sf)
    assert {r.doc_id: list(r.ids) for r in last.collect()} == {d: list(r.ids) for d, r in got.items()}


def test_empty_documents(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_and_repeated_rows(spark, sf):
    schema = read(spark, sf, "documents").schema
    text = " ".join(f"plain words number {i} of a longer text" for i in range(60)) + "."
    rows = [(None, text, None, None, None), (1, text, "en", "src0", 5), (1, text, "en", "src0", 5), (2, None, None, "x", None), (3, "", "en", None, 0)]
    now = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        now = spark.createDataFrame(out.collect(), out.schema)
        assert k == 4 or now.columns == schema.names
    assert {r.doc_id for r in now.collect()} <= {None, 1, 2, 3}


def test_near_dedup_keeps_columns_of_its_own_names(spark, sf):
    text = " ".join(f"w{i}" for i in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, row_1 int, component long, h string"
    rows = [(1, text, "en", "a", 9, "mine", 4, 5, "x"), (2, text + " end", "en", "a", 9, "theirs", 6, 7, "y"), (3, "other words", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.near_dedup(spark, docs, sf)
    assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]
