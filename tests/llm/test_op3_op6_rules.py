import math
import re
from collections import Counter

import duckdb
import pytest

from sievewright.llm import license_scan, quality_rules
from sievewright.llm.common import read

ROWS = [
    (1, None, 1), (2, "", 1), (3, " \t ", 1), (4, "MIT License. mit  license! The apache-license", 1), (4, "MIT License", 1),
    (None, "gnu general public license (v2.0) all rights reserved", 1), (5, "Kmit license", None), (6, "mité license mit licenseé", 2),
    (7, "licensed under the Apache License, Version 2.0. SPDX-License-Identifier: Apache-2.0", 3), (8, "a b c a b c a b c " * 9000, 3),
    (9, "line one\nline one\n\n \nline one\nx", 1), (10, "mit license " * 3000, 1), (11, "a b c d a b c", 1), (12, "x x x x", 1), (13, "licence permission", 1),
]


def same(got, expected):
    key = lambda r: str(r)
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y)), (a, b)


@pytest.mark.parametrize("module, run", [(license_scan, license_scan.license_scan), (quality_rules, quality_rules.quality_rules)])
@pytest.mark.parametrize("whole", [True, False])
def test_against_sql(spark, sf, module, run, whole):
    docs = read(spark, sf, "documents") if whole else spark.createDataFrame([r for r in ROWS if r[0] is not None and ROWS.count(r) == 1 and r[0] != 4], "doc_id long, text string, n_words int")
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841
    con.sql("CREATE VIEW documents AS SELECT * FROM frame")
    same([tuple(r) for r in run(docs).collect()], con.sql(module.oracle_sql()).fetchall())


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_words int")
    got = license_scan.license_scan(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *brute_base(t)) for d, t, _ in ROWS)
    by = {r.doc_id: r for r in got}
    assert by[7].labels == "apache,apache-2.0" and by[7].n_detections == 2 and by[7].score == 1.0
    assert by[None].labels == "all-rights-reserved,gpl,gpl-2.0"
    assert by[1].score == 0 and by[1].labels == ""
    assert license_scan.license_scan(docs.limit(0)).collect() == []


def test_contained_detections_are_suppressed(spark):
    docs = spark.createDataFrame([(1, "licensed under the GNU General Public License, version 3"), (2, "GNU General Public License")], "doc_id long, text string")
    by = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert by[1].n_detections == 1 and by[1].labels == "gpl,gpl-3.0"
    assert by[2].labels == "gpl"


def test_every_rule_matches_its_own_phrase():
    for r in license_scan.rules():
        text = re.sub(r"\(\?: [^)]*\)\?", "", r["pattern"]).replace("[0-9]{4}", "2020").replace("[0-9a-z]+", "zlib")
        text = text.replace(r"#\d+", "#7").replace("v?", "v")
        assert re.search(r["pattern"], text) and r["keyword"] in text


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_words int")
    got = quality_rules.quality_rules(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *brute_quality(t)) for d, t, _ in ROWS)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.broken == "" and not r.base_failed)
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []


def test_clean_documents_are_kept(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").join(read(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    good = docs.filter("quality = 1").drop("quality", "toxic")
    assert quality_rules.quality_rules(good).filter("not kept and not base_failed").count() == 0


def test_every_rule_passes_the_gate(spark):
    """Each rule's own phrase, with its optional words left out, is found by the scan itself."""
    rows = []
    for k, rule in enumerate(license_scan.rules()):
        words = re.sub(r"\(\?: [^()]*\)\?", "", rule["pattern"]).split()
        words = [re.sub(r"\[[^]]*\]\{4\}", "2020", re.sub(r"\[0-9a-z\]\+", "zlib", w.replace("#\\d+", "").replace("v?", ""))) for w in words]
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [t for k, t in rows if not got[k].n_detections] == []


@pytest.mark.parametrize("text, labels", [
    ("Released under GPLv3.", "gpl-3.0"), ("Distributed under the BSD 3 clause", "bsd-3-clause"), ("released under the terms of the mpl 2.0", "mpl-2.0"),
    ("this is all under mit regulation and the warrant holds", ""), ("GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"), ("SPDX-License-Identifier: BSD-3-Clause AND Zlib", "bsd-3-clause,zlib"),
    ("GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl,gpl-3.0,gpl-3.0-or-later"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("you may not use this file except in compliance with the License", "apache-2.0"),
])
def test_signatures(spark, text, labels):
    assert license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels
