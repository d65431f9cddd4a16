"""Quality rules: one table of thresholds, compiled into one Spark projection.

Every measure is a Column over built-in functions; the table below names a measure and the
closed range in which a text is kept. No user function takes part, and no row is shuffled.

Defined results: a null or empty text has no words, so all counts are 0 and it fails; repeated
rows are judged one by one; other columns of the input are left alone, also when their names
equal those of the measures (the measures are built from the text column only).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of

#: The most frequent function words of the languages handled.
STOP_WORDS = {
    "en": "the be to of and that have with this for not are was from by as at it is in a".split(),
    "de": "der die das und ist von mit nicht ein eine den dem zu im auf als für auch".split(),
    "es": "el la de que y en un los se del las por con una para es al lo como".split(),
    "fr": "le la les de des et un une du en que est pour dans qui sur pas par au".split(),
}


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range in which it is accepted; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios have the number of words (or of characters, or of lines) as denominator.
RULES = (
    Rule("n_words", 50, None),
    Rule("repeat_word_ratio", None, 0.5),
    Rule("mean_word_chars", 2.0, 25.0),
    Rule("symbol_word_ratio", None, 0.3),
    Rule("exclamation_word_ratio", None, 0.5),
    Rule("pipe_word_ratio", None, 0.25),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.005, None),
)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, even where ``use`` puts it into a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than white space."""
    return F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words in windows of three words that occur twice or more in the text.

    Windows whose hashes all differ hold no repeat, which ends the work for most texts. In the
    others the windows are sorted with their places, so that equal ones are neighbours: n log n
    for a text of n words, however often a window occurs.
    """

    def three(w: Column, make) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda first, i: make(first, F.get(w, i + 1), F.get(w, i + 2)),
        )

    def covered(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(places, k - 1))),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def of_sorted(ordered: Column) -> Column:
        def window(k: Column) -> Column:
            return F.get(ordered, k)["w"]

        twins = F.filter(ordered, lambda s, k: (s["w"] == window(k - 1)) | (s["w"] == window(k + 1)))
        return _let(F.sort_array(F.transform(twins, lambda s: s["i"])), covered)

    def of_words(w: Column) -> Column:
        differ = _let(three(w, F.xxhash64), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        windows = three(w, lambda a, b, c: F.concat_ws(" ", a, b, c))
        pairs = F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        return F.when(differ, F.lit(0).cast("long")).otherwise(_let(F.sort_array(pairs), of_sorted))

    return _let(words, of_words)


def duplicate_lines(text: Column) -> tuple[Column, Column]:
    """Numbers of lines with a word, and of those among them that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t\n\x0B\f\r]")))
    return F.size(lines).cast("long"), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Counts of one text; the words are split once for all of them."""
    stops = {w for words in STOP_WORDS.values() for w in words}
    stops = sorted({*stops, *(w.capitalize() for w in stops)})
    lines, doubled = duplicate_lines(text)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        )

    return {
        "counts": _let(split_words(text), of_words),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_pipes": F.regexp_count(text, F.lit(r"\|")).cast("long"),
        "n_exclamations": F.regexp_count(text, F.lit("!!")).cast("long"),
        "n_lines": lines,
        "n_dup_lines": doubled,
    }


def verdict(rules: tuple[Rule, ...], ratios: dict[str, Column]) -> tuple[Column, Column]:
    """Whether all rules hold, and the names of the measures that break one."""
    broken = []
    for rule in rules:
        value = ratios[rule.measure]
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < F.lit(rule.low))
        if rule.high is not None:
            bad = bad | (value > F.lit(rule.high))
        broken.append((rule.measure, bad))
    names = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in broken])
    return names == "", names


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, kept and the broken rules."""
    found = measures(F.col("t"))
    counted = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select(
        "doc_id", *[c.alias(name) for name, c in found.items()]
    )
    flat = counted.select("doc_id", "counts.*", *[c for c in found if c != "counts"])
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    ratios = {
        "n_words": F.col("n_words"),
        "repeat_word_ratio": F.col("n_repeat_words") / n,
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_word_ratio": F.col("n_symbols") / n,
        "exclamation_word_ratio": F.col("n_exclamations") / n,
        "pipe_word_ratio": F.col("n_pipes") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "stop_word_ratio": F.col("n_stop_words") / n,
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    holds, names = verdict(rules, ratios)
    return flat.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & holds).alias("kept"), names.alias("broken"),
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The rules over ``documents`` as DuckDB SQL, from the same table of thresholds."""
    stops = {w for words in STOP_WORDS.values() for w in words}
    stops = sorted({*stops, *(w.capitalize() for w in stops)})
    ratio = {
        "n_words": "n_words::DOUBLE",
        "repeat_word_ratio": "n_repeat_words / n",
        "mean_word_chars": "word_chars / n",
        "symbol_word_ratio": "n_symbols / n",
        "exclamation_word_ratio": "n_exclamations / n",
        "pipe_word_ratio": "n_pipes / n",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "stop_word_ratio": "n_stop_words / n",
    }
    broken = []
    for rule in rules:
        tests = [f"{ratio[rule.measure]} {sign} {value}" for sign, value in (("<", rule.low), (">", rule.high)) if value is not None]
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{rule.measure}' END")
    space = "[ \\t\\n\\x0B\\f\\r]"
    return f"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM documents),
windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    len(regexp_extract_all(t, '\\|')) AS n_pipes, len(regexp_extract_all(t, '!!')) AS n_exclamations,
    len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in stops)}))) AS n_stop_words,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, greatest(len(w), 1) AS n FROM split LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {", ".join(broken)}) AS broken FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM judged"""
