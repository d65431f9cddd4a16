"""License scans: ordered signature rules, gated by keywords, resolved by priority and containment.

A text that holds none of a few words is done after counting its words. In the others the words
are numbered (``mit#0 license#1``), so that every match of a rule names the first and last word it
covers. A rule runs only where its keyword occurs. Detections are ordered by start, then length,
then priority, and one pass drops each that lies within another of at least its priority.
All of it is one projection of built-in functions; nothing is shuffled.

Defined results: null and empty texts have no words and no labels, score 0; a text of any length is
scanned whole; of equal spans and priorities the first rule's stays; an empty table gives no rows; repeated rows are
scanned one by one; columns of the input with names of the result are not used.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
NO_WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: Fixed values of the contract: phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: A text without any of these has no detection: every rule has a word that it cannot do without and that holds one of them.
GATES = (
    "licen", "lizenz", "copyright", "reserved", "domain", "commons", "permission", "warrant", "gpl", "released", "distributed",
    "redistribution", "compliance", "endorse", "unencumbered", "foundation", "waived", "provided",
)

#: Licenses by label: names as they are written, one word a token; ``(x)`` is an optional word.
NAMES = {
    "mit": ("mit", "expat"),
    "mit-0": ("mit no attribution", "mit 0"),
    "apache-1.1": ("apache (software) (license) (version) 1 1",),
    "apache-2.0": ("apache (software) (license) (version) v?2 0", "asl 2 0"),
    "gpl-1.0": ("gpl (version) 1( 0)", "gpl v1", "gplv1"),
    "gpl-2.0": ("gpl (version) 2( 0)", "gpl v2", "gplv2", "gnu general public license (version) v?2( 0)"),
    "gpl-3.0": ("gpl (version) 3( 0)", "gpl v3", "gplv3", "gnu general public license (version) v?3( 0)"),
    "lgpl-2.1": ("lgpl (version) 2 1", "lgpl v2 1", "lgplv2 1", "gnu lesser general public license (version) v?2 1"),
    "lgpl-3.0": ("lgpl (version) 3( 0)", "lgpl v3", "lgplv3", "gnu lesser general public license (version) v?3( 0)"),
    "agpl-3.0": ("agpl (version) 3( 0)", "agpl v3", "agplv3", "gnu affero general public license (version) v?3( 0)"),
    "bsd-2-clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"),
    "bsd-3-clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"),
    "bsd-4-clause": ("bsd 4 clause", "4 clause bsd", "original bsd"),
    "0bsd": ("0bsd", "zero clause bsd"),
    "mpl-1.1": ("mozilla public license (version) v?1 1", "mpl (version) 1 1"),
    "mpl-2.0": ("mozilla public license (version) v?2 0", "mpl (version) 2 0"),
    "epl-1.0": ("eclipse public license (version) v?1 0", "epl (version) 1 0"),
    "epl-2.0": ("eclipse public license (version) v?2 0", "epl (version) 2 0"),
    "cddl-1.0": ("common development and distribution license (version) 1 0", "cddl (version) 1 0"),
    "eupl-1.2": ("european union public (licence) (license) (version) v?1 2", "eupl (version) 1 2"),
    "isc": ("isc",),
    "zlib": ("zlib",),
    "libpng": ("libpng",),
    "bsl-1.0": ("boost software license", "bsl 1 0"),
    "busl-1.1": ("business source license (version) 1 1", "busl 1 1"),
    "artistic-2.0": ("artistic (license) (version) 2 0",),
    "python-2.0": ("python software foundation license", "psf"),
    "postgresql": ("postgresql",),
    "openssl": ("openssl",),
    "unlicense": ("unlicense",),
    "wtfpl": ("wtfpl", "do what the fuck you want to public license"),
    "ms-pl": ("microsoft public license", "ms pl"),
    "ms-rl": ("microsoft reciprocal license", "ms rl"),
    "ofl-1.1": ("sil open font license", "ofl (version) 1 1"),
    "osl-3.0": ("open software license (version) v?3 0", "osl 3 0"),
    "afl-3.0": ("academic free license (version) v?3 0", "afl 3 0"),
    "odbl-1.0": ("open (data) database license", "odbl"),
    "cc0-1.0": ("cc0", "creative commons zero"),
    "gfdl": ("gnu free documentation license", "gfdl"),
}
#: Creative Commons licenses follow from their parts.
CC_PARTS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")

#: How a name is announced: words before and after it, priority, confidence.
FORMS = (
    ("spdx license identifier", "", 3, 1.0),
    ("licensed under (the) (terms) (of) (the)", "(license)", 2, 0.95),
    ("released under (the) (terms) (of) (the)", "(license)", 2, 0.9),
    ("distributed under (the) (terms) (of) (the)", "(license)", 2, 0.9),
    ("provided under (the) (terms) (of) (the)", "(license)", 2, 0.9),
    ("spdx license identifier [0-9a-z]+ ([0-9]+) ([0-9]+) (clause) or", "", 2, 1.0),
    ("spdx license identifier [0-9a-z]+ ([0-9]+) ([0-9]+) (clause) and", "", 2, 1.0),
    ("license", "", 1, 0.7),
    ("", "license", 1, 0.8),
    ("", "licence", 1, 0.8),
)
#: Statements about rights that name no license: phrase, label, priority, confidence.
STATEMENTS = (
    ("all rights reserved", "all-rights-reserved", 1, 0.6),
    ("copyright c", "copyright", 0, 0.4),
    ("copyright [0-9]{4}", "copyright", 0, 0.4),
    ("c copyright", "copyright", 0, 0.4),
    ("dedicated to the public domain", "public-domain", 1, 0.8),
    ("(in) (the) public domain", "public-domain", 0, 0.5),
    ("permission is hereby granted free of charge", "mit", 2, 0.9),
    ("redistribution and use in source and binary forms", "bsd", 2, 0.9),
    ("names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause", 2, 0.95),
    ("used to endorse or promote products derived from this software", "bsd-3-clause", 1, 0.8),
    ("advertising materials mentioning features or use of this software must display the following acknowledgement (this) (product) (includes) (software) (developed) (by) (the) copyright", "bsd-4-clause", 2, 0.9),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd-3-clause", 2, 0.95),
    ("you may not use this file except in compliance with the license", "apache-2.0", 2, 0.9),
    ("gnu general public license as published by the free software foundation (either) version 1", "gpl-1.0", 3, 0.95),
    ("gnu general public license as published by the free software foundation (either) version 2", "gpl-2.0", 3, 0.95),
    ("gnu general public license as published by the free software foundation (either) version 3", "gpl-3.0", 3, 0.95),
    ("gnu lesser general public license as published by the free software foundation (either) version 2 1", "lgpl-2.1", 3, 0.95),
    ("gnu lesser general public license as published by the free software foundation (either) version 3", "lgpl-3.0", 3, 0.95),
    ("gnu affero general public license as published by the free software foundation (either) version 3", "agpl-3.0", 3, 0.95),
    ("version 2 of the license or (at) (your) (option) any later version", "gpl-2.0-or-later", 1, 0.7),
    ("version 3 of the license or (at) (your) (option) any later version", "gpl-3.0-or-later", 1, 0.7),
    ("gpl 2( 0) or later", "gpl-2.0-or-later", 2, 0.9),
    ("gpl 3( 0) or later", "gpl-3.0-or-later", 2, 0.9),
    ("lgpl 2 1 or later", "lgpl-2.1-or-later", 2, 0.9),
    ("lgpl 3( 0) or later", "lgpl-3.0-or-later", 2, 0.9),
    ("agpl 3( 0) or later", "agpl-3.0-or-later", 2, 0.9),
    ("gpl 2( 0) only", "gpl-2.0-only", 2, 0.9),
    ("gpl 3( 0) only", "gpl-3.0-only", 2, 0.9),
    ("free and unencumbered software released into the public domain", "unlicense", 2, 0.95),
    ("waived all copyright and related or neighboring rights", "cc0-1.0", 2, 0.95),
    ("subject to the terms of the mozilla public license v (version) 2 0", "mpl-2.0", 3, 0.95),
    ("accompanying materials are made available under the terms of the eclipse public license v2 0", "epl-2.0", 3, 0.95),
    ("accompanying materials are made available under the terms of the eclipse public license v1 0", "epl-1.0", 3, 0.95),
    ("provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 2, 0.8),
    ("permission to use copy modify and distribute this software and its documentation for any purpose", "hpnd", 2, 0.8),
    ("the above copyright notice and this permission notice shall be included in all copies", "mit", 2, 0.9),
    ("permission to use copy modify and or distribute this software", "isc", 2, 0.9),
    ("without warranty of any kind", "no-warranty", 0, 0.3),
    ("gnu general public license", "gpl", 1, 0.8),
    ("gnu lesser general public license", "lgpl", 2, 0.85),
    ("gnu affero general public license", "agpl", 2, 0.85),
    ("creative commons", "cc", 0, 0.5),
    ("proprietary license", "proprietary", 1, 0.6),
    ("commercial license", "proprietary", 1, 0.5),
    ("lizenziert unter", "license-notice", 0, 0.3),
    ("licensed under", "license-notice", 0, 0.3),
)


def _pattern(phrase: str) -> str:
    """A phrase as a pattern over numbered words; ``(x)`` becomes an optional word."""
    words = phrase.replace("( ", " (").split()
    return "".join(rf"(?: {w[1:-1]}#\d+)?" if w[0] == "(" else rf" {w}#\d+" for w in words)


def _keyword(phrase: str) -> str:
    """The longest word that a phrase cannot do without, as it stands among numbered words."""
    plain = [w for w in phrase.replace("( ", " (").split() if w[0] != "(" and w.isalnum()]
    return f" {max(plain, key=len)}#" if plain else " "


@cache
def rules() -> tuple[dict, ...]:
    """All rules in order of priority: every name in every form, then the statements."""
    names = [(label, name) for label, variants in NAMES.items() for name in variants]
    for part, words in CC_PARTS.items():
        for version in CC_VERSIONS:
            digits = version.replace(".", " ")
            label = f"cc-{part.replace(' ', '-')}-{version}"
            names += [(label, f"cc {part} {digits}"), (label, f"creative commons {words} {digits}")]
    found = []
    for label, name in names:
        for before, after, priority, confidence in FORMS:
            phrase = f"{before} {name} {after}".strip()
            found.append((priority, phrase, label, confidence))
        if "license" in name.split():  # such a name needs no other announcement
            found.append((1, name, label, 0.75))
    found += [(priority, phrase, label, confidence) for phrase, label, priority, confidence in STATEMENTS]
    found.sort(key=lambda r: -r[0])
    return tuple(
        {"keyword": _keyword(phrase), "pattern": _pattern(phrase), "label": label, "priority": priority, "confidence": confidence}
        for priority, phrase, label, confidence in found
    )


RULE_TYPE = "array<struct<keyword:string,pattern:string,label:string,priority:int,confidence:double>>"


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(text: Column, place: Column) -> Column:
    """Number of words before the 1-based ``place``; each word stands between two spaces of its own."""
    head = F.substring(text, F.lit(1), place - 1)
    return ((F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / 2).cast("long")


def base_scan(spaced: Column) -> Column:
    """Places, first and last start and labels of the base phrases in a text of spaced words."""
    count, firsts, lasts, labels = F.lit(0), [], [], []
    mirrored = F.reverse(spaced)
    for phrase, label in BASE:
        sought = "".join(f" {w} " for w in phrase.split())
        times = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(sought), F.lit("")))) / len(sought)).cast("long")
        count = count + times
        found = F.contains(spaced, F.lit(sought))
        firsts.append(F.when(found, _before(spaced, F.locate(sought, spaced))))
        lasts.append(F.when(found, _before(spaced, F.length(spaced) - F.locate(sought[::-1], mirrored) - len(sought) + 2)))
        labels.append(F.when(found, F.lit(label)))
    return F.struct(
        count.cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )


def rule_scan(numbered: Column, table: Column) -> Column:
    """Labels, number and highest confidence of the detections that no other suppresses."""

    def detections(rule: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(numbered, rule["pattern"], F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, r"#(\d+)", 1).cast("int").alias("start"),
                (-F.regexp_extract(m, r"#(\d+)$", 1).cast("int")).alias("minus_end"),
                (-rule["priority"]).alias("minus_priority"),
                rule["label"].alias("label"),
                rule["confidence"].alias("confidence"),
            ),
        )

    hits = F.filter(table, lambda r: F.contains(numbered, r["keyword"]))
    ordered = F.sort_array(F.flatten(F.transform(hits, detections)))
    start = F.struct(
        *[F.lit(-1).alias(f"reach{p}") for p in range(4)],
        F.array().cast("array<string>").alias("labels"),
        F.lit(0).cast("long").alias("n"),
        F.lit(0.0).alias("score"),
    )

    def step(state: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        reach = F.element_at(F.array(*[state[f"reach{p}"] for p in range(4)]), priority + 1)
        kept = F.struct(
            *[F.when(priority >= p, F.greatest(state[f"reach{p}"], end)).otherwise(state[f"reach{p}"]).alias(f"reach{p}") for p in range(4)],
            F.array_union(state["labels"], F.array(d["label"])).alias("labels"),
            (state["n"] + 1).alias("n"),
            F.greatest(state["score"], d["confidence"]).alias("score"),
        )
        return F.when(reach >= end, state).otherwise(kept)

    return F.aggregate(ordered, start, step)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: word count, base places and labels, all labels, detections, score."""
    table = F.from_json(F.lit(json.dumps(rules())), RULE_TYPE)
    lowered = F.lower(F.col("t"))
    gated = F.contains(lowered, F.lit(GATES[0]))
    for gate in GATES[1:]:
        gated = gated | F.contains(lowered, F.lit(gate))

    def scan(words: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
        numbered = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i.cast("string"))), "")
        return F.struct(_let(spaced, base_scan).alias("b"), _let(numbered, lambda n: rule_scan(n, table)).alias("r"))

    words = F.filter(F.split(F.translate("t", UPPER, LOWER), NO_WORD), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select(
        "doc_id", F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"), F.when(gated, _let(words, scan)).alias("s")
    )
    base, own = F.coalesce("s.b.base", F.array().cast("array<string>")), F.coalesce("s.r.labels", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("s.b.n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("s.b.first_word").alias("first_word"),
        F.col("s.b.last_word").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce("s.r.n", F.lit(0).cast("long")).alias("n_detections"),
        F.greatest(F.coalesce("s.r.score", F.lit(0.0)), F.when(F.size(base) > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
    )


def oracle_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL: detections as rows, suppression as running maxima."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({q(r['keyword'])},{q(r['pattern'])},{q(r['label'])},{r['priority']},{r['confidence']}::DOUBLE)" for r in rules())
    base = ",\n".join(f"({q(_pattern(phrase))},{q(label)})" for phrase, label in BASE)
    reach = " OR ".join(
        f"(priority = {p} AND coalesce(max(CASE WHEN priority >= {p} THEN last END) OVER w, -1) >= last)" for p in range(4)
    )
    return f"""
WITH rules(keyword, pattern, label, priority, confidence) AS (VALUES {values}),
base(pattern, label) AS (VALUES {base}),
worded AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS words,
    list_bool_or([contains(lower(coalesce(text, '')), g) FOR g IN {list(GATES)}]) AS gated FROM documents),
numbered AS (SELECT doc_id, words, len(words)::BIGINT AS n_words, gated,
    array_to_string(list_transform(words, lambda w, i: ' ' || w || '#' || (i - 1)::VARCHAR), '') AS numbered FROM worded),
places AS (SELECT doc_id, label, unnest(regexp_extract_all(numbered, pattern)) AS m FROM numbered, base WHERE contains(numbered, ' license#')),
based AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(regexp_extract(m, '#(\\d+)', 1)::BIGINT) AS first_word, max(regexp_extract(m, '#(\\d+)', 1)::BIGINT) AS last_word,
    list_sort(list(DISTINCT label)) AS base FROM places GROUP BY doc_id),
found AS (SELECT doc_id, label, priority, confidence, unnest(regexp_extract_all(numbered, pattern)) AS m FROM numbered JOIN rules ON gated AND contains(numbered, keyword)),
spans AS (SELECT doc_id, label, priority, confidence, regexp_extract(m, '#(\\d+)', 1)::INT AS first, regexp_extract(m, '#(\\d+)$', 1)::INT AS last FROM found),
judged AS (SELECT *, {reach} AS hidden FROM spans
    WINDOW w AS (PARTITION BY doc_id ORDER BY first, last DESC, priority DESC, label, confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT doc_id, count(*)::BIGINT AS n, max(confidence) AS score, list(DISTINCT label) AS own FROM judged WHERE NOT hidden GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(base, []), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
    coalesce(n, 0) AS n_detections, greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN 0.6 ELSE 0 END)::DOUBLE AS score
FROM numbered LEFT JOIN based USING (doc_id) LEFT JOIN kept USING (doc_id)"""
