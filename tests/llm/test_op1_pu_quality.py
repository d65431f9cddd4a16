from zlib import crc32

import numpy as np
import pytest

from sievewright.llm import pu_quality
from sievewright.llm.common import read


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = pu_quality.pu_quality(spark, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    assert all(r.score < 0.3 or r.score > 0.3 for r in got)


def test_labels_of_held_out_rows_and_other_classes_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    first = {r.doc_id: r.score for r in pu_quality.pu_quality(spark, docs, labels).collect()}
    fewer = labels.filter("quality = 1 and crc32(cast(doc_id as string)) % 5 <> 0")
    assert {r.doc_id: r.score for r in pu_quality.pu_quality(spark, docs, fewer).collect()} == pytest.approx(first)


def test_prior_and_risk():
    rng = np.random.default_rng(3)
    pos, neg = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    for prior in (0.3, 0.7):
        k = int(4000 * prior)
        u = np.concatenate([pos[2000 : 2000 + k // 2], neg[: 2000 - k // 2]])
        u = u[rng.permutation(len(u))]
        found = pu_quality.estimate_prior(pos[:2000], u)
        assert abs(found - prior) < 0.12
        net = pu_quality.fit(pos[:2000], u, found)
        test = np.concatenate([pos[3000:], neg[3000:]])
        truth = np.r_[np.ones(1000), np.zeros(1000)]
        assert ((net.score(test) > 0.5) == truth).mean() > 0.95


def test_prior_counts_every_unlabelled_text_beyond_the_sample(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    net, prior = pu_quality.fit_quality(spark, docs, labels, fit_rows=400)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    shares = [quality[r.doc_id] for r in docs.select("doc_id").collect() if r.doc_id in quality]
    assert abs(prior - np.mean(shares)) < 0.1
    cut = np.array([0.1, 0.5, 0.9])
    above, n = pu_quality.counts_above(docs, net, cut)
    scores = np.array([r.score for r in pu_quality.score_quality(docs, net).collect()])
    assert n == len(scores) and above.tolist() == [(scores >= c).sum() for c in cut]
    assert pu_quality.counts_above(docs.limit(0), net, cut)[1] == 0


def test_slopes_are_the_gradient_of_the_risk():
    rng = np.random.default_rng(1)
    f_p, f_u = rng.normal(size=7), rng.normal(size=9) + 1
    risk, s_p, s_u = pu_quality.non_negative_risk(f_p, f_u, 0.3)
    for i in range(7):
        step = f_p.copy()
        step[i] += 1e-6
        assert (pu_quality.non_negative_risk(step, f_u, 0.3)[0] - risk) / 1e-6 == pytest.approx(s_p[i], abs=1e-5)
    for i in range(9):
        step = f_u.copy()
        step[i] += 1e-6
        assert (pu_quality.non_negative_risk(f_p, step, 0.3)[0] - risk) / 1e-6 == pytest.approx(s_u[i], abs=1e-5)


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "\n\n \n", 1), (3, "some words\nof text", 1), (None, "x", 2), (4, "y " * 90_000, None), (6, "ünï 漢字", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1), (4, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = pu_quality.pu_quality(spark, docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in pu_quality.pu_quality(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert pu_quality.pu_quality(spark, docs.limit(0), labels).collect() == []
