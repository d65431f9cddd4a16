import math

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import pieces
from sievewright.llm.common import read

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.Pieces(PATH)


def every_path(unit, start=0):
    if start == len(unit):
        return [(0.0, ())]
    return [(score + s, ids + more) for end, ids, score in MODEL.edges(unit, start) for s, more in every_path(unit, end)]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="theanior \n€", max_size=9), st.integers(1, 6))
def test_n_best_of_texts_against_all_paths(text, n):
    whole = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    paths = sorted(every_path(whole), key=lambda p: -p[0])
    assert [s for s, _ in MODEL.n_best(whole, n)] == pytest.approx([s for s, _ in paths[:n]])
    segmenter = pieces.Segmenter(PATH, n) if n != 4 else test_n_best_of_texts_against_all_paths.__dict__.setdefault("s", pieces.Segmenter(PATH, 4))
    ids, score, best, ends = segmenter.segment(text)
    assert score == pytest.approx(paths[0][0])
    assert [s for s, _ in best] == pytest.approx([s for s, _ in paths[:n]])
    scored = {}
    for s, p in paths:
        scored.setdefault(p, []).append(s)
    for s, swaps in best:
        assert any(math.isclose(s, x, abs_tol=1e-6) for x in scored[tuple(segmenter.replaced(ids, ends, swaps).tolist())])
    assert segmenter.pieces.decode(ids.tolist()) == text


def test_round_trip_and_score_of_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.segment(docs).collect():
        assert r.decoded == texts[r.doc_id]
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == pytest.approx(r.score)
        assert r.nbest_lengths[0] == len(r.ids)


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " ", 1), (3, "  a  b \n\n c ", 1), (None, "▁", 2), (4, "x" * 30_000, 3), (5, "漢字🙂\tñ\0", None), (6, "<s> </s> <0x0A>", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.segment(docs).collect()
    assert sorted(r.decoded for r in got) == sorted((t or "").replace("▁", " ") for _, t, _ in rows)
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert all(r.ids == [] and r.score == 0 and r.nbest_scores == [0.0] for r in empty)
    assert pieces.segment(docs.limit(0)).collect() == []


def test_trimmed_segmenter_stays_right(spark, sf, monkeypatch):
    texts = [r.text for r in read(spark, sf, "documents").collect()][:60]
    monkeypatch.setattr(pieces.Segmenter, "KNOWN", 400)
    monkeypatch.setattr(pieces.Segmenter, "KEPT", 150)
    segmenter = pieces.Segmenter(PATH, 2)
    for text in [*texts, "x" * 100 + " ☃y"]:
        ids, score, _, _ = segmenter.segment(text)
        each = [MODEL.best(u) for u in segmenter.units(text)]
        assert ids.tolist() == [i for e in each for i in e[0]] and score == pytest.approx(sum(e[1] for e in each))


def test_all_paths_are_returned(spark):
    docs = spark.createDataFrame([(1, "the other thing"), (2, ""), (3, "a"), (4, None)], "doc_id long, text string")
    for r in pieces.segment(docs, n=4, paths=True).collect():
        assert r.nbest_ids[0] == r.ids and [len(x) for x in r.nbest_ids] == r.nbest_lengths and len(r.nbest_ids) == len(r.nbest_scores)
        assert all(MODEL.decode(x) == r.decoded for x in r.nbest_ids) and len(set(map(tuple, r.nbest_ids))) == len(r.nbest_ids)
    assert len(pieces.segment(docs, n=4, paths=True).filter("doc_id = 1").first().nbest_ids) == 4
