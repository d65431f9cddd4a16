"""Line dedup by a tree of log templates.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, in
which a token with a digit counts as a variable. Within a leaf, a token at a later place is
constant if enough documents have it there, and a variable otherwise; the line's template is its
constants with a mark for each variable, provided that enough of it is constant. Templates that
recur in ``min_docs`` documents are boilerplate: the line goes from every document but the one of
least id, which keeps it, so that no text is lost altogether. A line without variable fields needs
less evidence: of ``long_tokens`` tokens or more, the same in ``min_copies`` documents, it goes alike.

The tree is built for all lines at once instead of line by line, hence independently of their
order, in passes that count documents: leaves, tokens in the leaves that recur, templates, and long
lines as they are.
Counts are reduced in each task and then by range of a hash, so a line of every document costs
one entry a task; what a pass looks up lies in sorted arrays in the shared folder, memory-mapped.

Defined results: null and empty texts have one line without tokens, which stays; lines with less
than ``MIN_TOKENS`` tokens always stay (a brace or a heading of one word is no boilerplate); very long
lines and texts are taken whole; lines that differ in white space only are the same; documents with equal ids that hold the least id both keep
the line; a null id counts as greater than any other; other columns pass through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, text_of
from .wordhash import U64, SortedHashes, Words, chunks, find_unsorted, mix, pack, pack_values, range_count, ranges, sizes_of, unpack, unpack_values

DEPTH, MIN_TOKENS, MIN_DOCS, CONSTANT_SHARE = 3, 3, 10, 0.7
LONG_TOKENS, MIN_COPIES = 20, 2
HELD = 2_000_000
NONE = np.iinfo(np.int64).max
_VARIABLE = U64(0x2545F4914F6CDD1D)
_STEP = U64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Rules:
    min_docs: int = MIN_DOCS
    constant_share: float = CONSTANT_SHARE
    long_tokens: int | None = LONG_TOKENS
    """None: templates only."""
    min_copies: int = MIN_COPIES


class Lines:
    """Lines of a chunk: places in the data, documents, tokens and leaves."""

    def __init__(self, words: Words):
        data, bounds = words.data, words.bounds
        breaks = np.flatnonzero(data == 10)
        self.count = np.diff(np.searchsorted(breaks, bounds)) + 1
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.starts = np.sort(np.r_[bounds[:-1], breaks + 1])
        last = np.cumsum(self.count) - 1
        self.ends = np.r_[self.starts[1:] - 1, 0]
        self.ends[last] = bounds[1:]
        self.first = np.searchsorted(words.starts, self.starts)
        self.n = np.searchsorted(words.starts, self.ends) - self.first
        digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
        self.tokens = np.where(digits[words.ends] > digits[words.starts], _VARIABLE, words.hashes)
        self.at = np.flatnonzero(self.n >= MIN_TOKENS)
        leaf = mix(self.n[self.at].astype(U64))
        for k in range(DEPTH):
            leaf = leaf * _STEP + self.tokens[self.first[self.at] + k]
        self.leaf = mix(leaf)
        self.words = words.hashes

    def long(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Lines of ``least`` tokens or more, and their keys: all tokens, digits included, in order."""
        lines = np.flatnonzero(self.n >= least)
        n = self.n[lines]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        token = mix(self.words[np.repeat(self.first[lines], n) + k] + mix((k + 1).astype(U64)))
        total = np.add.reduceat(token, np.cumsum(n) - n) if len(n) else np.zeros(0, U64)
        return lines, mix(total * _STEP + n.astype(U64))

    def places(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For lines ``of`` (places of ``at``): the tokens after the leading ones, as their line and key."""
        lines = self.at[of]
        rest = self.n[lines] - DEPTH
        row = np.repeat(np.arange(len(of)), rest)
        k = np.arange(len(row)) - np.repeat(np.cumsum(rest) - rest, rest) + DEPTH
        token = self.tokens[self.first[lines][row] + k]
        return row, mix(self.leaf[of][row] * _STEP + mix(k.astype(U64)) + token)


def by_documents(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the number of documents that have them."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(fresh.astype(np.int64), first) if len(first) else first


def _merged(keys: np.ndarray, values: np.ndarray, by) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], by.reduceat(values, first) if len(first) else values


class Tree:
    """What the passes have found so far, for the lines of a chunk."""

    def __init__(self, tables: list[SortedHashes], rules: Rules):
        self.tables, self.rules = tables, rules

    def recurring(self, lines: Lines) -> np.ndarray:
        """Places of ``at`` whose leaf recurs."""
        return np.flatnonzero(find_unsorted(self.tables[0], lines.leaf)[0])

    def templates(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Lines with enough constants, and the keys of their templates."""
        of = self.recurring(lines)
        row, keys = lines.places(of)
        constant = find_unsorted(self.tables[1], keys)[0]
        total = np.zeros(len(of), U64)
        np.add.at(total, row, mix(np.where(constant, keys, _VARIABLE + row_places(row))))
        sure = np.bincount(row, weights=constant, minlength=len(of)) + DEPTH
        enough = sure >= self.rules.constant_share * lines.n[lines.at[of]]
        return lines.at[of][enough], mix(lines.leaf[of] * _STEP + total)[enough]


def row_places(row: np.ndarray) -> np.ndarray:
    """The place of each entry within its row."""
    if not len(row):
        return row.astype(U64)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return (np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))).astype(U64)


BLOBS = "part int, keys binary, counts binary, ids binary"


def send(stage: int, tables: list[SortedHashes], rules: Rules, parts: int):
    """Per task: keys of leaves (0), tokens (1), templates (2) or long lines (3) with their numbers of documents and least ids."""

    def flush(held):
        keys, counts, ids = map(np.concatenate, zip(*held))
        least = _merged(keys, ids, np.minimum)[1]
        keys, counts = _merged(keys, counts, np.add)
        a = ranges(keys, parts)
        full = [i for i in range(parts) if a[i + 1] > a[i]]
        columns = [[f(x[a[i] : a[i + 1]]) for i in full] for f, x in ((pack, keys), (pack_values, counts), (pack_values, least))]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["part", "keys", "counts", "ids"])

    def run(batches):
        tree, held, size = Tree(tables, rules), [], 0
        for batch, words in chunks(batches, 1):
            lines = Lines(words)
            if stage == 0:
                keys, docs = lines.leaf, lines.doc[lines.at]
            elif stage == 1:
                of = tree.recurring(lines)
                row, keys = lines.places(of)
                docs = lines.doc[lines.at[of]][row]
            else:
                at, keys = tree.templates(lines) if stage == 2 else lines.long(rules.long_tokens)
                docs = lines.doc[at]
            ids = batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False)[docs]
            own, counts = by_documents(keys, docs)
            held.append((own, counts, _merged(keys, ids, np.minimum)[1]))
            size += len(own)
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def store(folder: str, min_docs: int):
    """Per range: keys of at least ``min_docs`` documents, with the least id."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for part, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found.setdefault(part, []).append(blobs)
        for part, blobs in found.items():
            keys = np.concatenate([unpack(b[0]) for b in blobs])
            counts, ids = (np.concatenate([unpack_values(b[k]) for b in blobs]) for k in (1, 2))
            least = _merged(keys, ids, np.minimum)[1]
            keys, counts = _merged(keys, counts, np.add)
            often = counts >= min_docs
            SortedHashes.write(folder, part, {"key": keys[often], "doc": least[often]})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(often.sum())])], ["part", "n"])

    return run


def build(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> Tree:
    """The tree of all lines of ``docs``, in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    volume = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = range_count(volume // 40, HELD, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tables: list[SortedHashes] = []
    for stage in range(3 if rules.long_tokens is None else 4):
        folder = shared_folder(spark, f"lines{stage}")
        sent = rows.mapInArrow(send(stage, list(tables), rules, parts), BLOBS).repartitionById(parts, F.col("part"))
        sizes = sizes_of(sent.mapInArrow(store(folder, rules.min_docs if stage < 3 else rules.min_copies), "part int, n long").collect(), parts)  # one row a range
        tables.append(SortedHashes(folder, sizes, {"key": "<u8", "doc": "<i8"}))
    return Tree(tables, rules)


def dropped(tree: Tree, words: Words, ids: np.ndarray) -> tuple[Lines, np.ndarray]:
    """The lines of a chunk and which of them go."""
    lines = Lines(words)
    go = np.zeros(len(lines.starts), bool)
    kinds = [tree.templates(lines)] if tree.rules.long_tokens is None else [tree.templates(lines), lines.long(tree.rules.long_tokens)]
    for table, (at, keys) in zip(tree.tables[2:], kinds):
        there, found = find_unsorted(table, keys)
        go[at] |= there & (found["doc"] < ids[lines.doc[at]])
    return lines, go


def filtered(tree: Tree, id_at: int, text_at: int, whole: bool):
    """For mapInArrow: the batch with its texts cleaned (``whole``), or (doc_id, n_lines, n_dropped, text)."""

    def run(batches):
        for batch, words in chunks(batches, text_at):
            ids = batch.column(id_at).fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)
            lines, go = dropped(tree, words, ids)
            gone = np.bincount(lines.doc[go], minlength=len(batch))
            texts, data, last = batch.column(text_at).to_pylist(), words.data.tobytes(), np.cumsum(lines.count)
            for d in np.flatnonzero(gone):
                own = range(last[d] - lines.count[d], last[d])
                texts[d] = b"\n".join(data[lines.starts[i] : lines.ends[i]] for i in own if not go[i]).decode()
            cleaned = pa.array(texts, batch.schema.field(text_at).type)
            if whole:
                yield batch.set_column(text_at, batch.schema.field(text_at), cleaned)
            else:
                columns = [batch.column(id_at), pa.array(lines.count, pa.int64()), pa.array(gone, pa.int64()), cleaned]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "text"])

    return run


def line_dedup(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, text): each text without the lines of recurring templates."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(filtered(build(spark, docs, rules, id_col, text_col), 0, 1, False), "doc_id long, n_lines long, n_dropped long, text string")


def without_templates(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, its texts without the lines of recurring templates."""
    tree = build(spark, docs, rules, id_col, text_col)
    return docs.mapInArrow(filtered(tree, docs.columns.index(id_col), docs.columns.index(text_col), True), docs.schema)


def oracle_sql(rules: Rules = Rules()) -> str:
    """The dedup of ``documents`` as DuckDB SQL, with lines, leaves and templates as rows."""
    words = "list_filter(string_split_regex(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
    same = union = ""
    if rules.long_tokens is not None:
        same = f"copies AS (SELECT raw, min(doc_id) AS first FROM tokens WHERE len(w) >= {rules.long_tokens} GROUP BY raw HAVING count(DISTINCT rid) >= {rules.min_copies}),\n"
        union = " UNION SELECT rid, no FROM tokens JOIN copies USING (raw) WHERE first < doc_id"
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM texts),
tokens AS (SELECT rid, doc_id, no, array_to_string({words}, ' ') AS raw, list_transform({words}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM lines),
leaves AS (SELECT *, len(w) AS n, len(w) || '|' || array_to_string(w[1:{DEPTH}], ' ') AS leaf FROM tokens WHERE len(w) >= {MIN_TOKENS}),
often AS (SELECT leaf FROM leaves GROUP BY leaf HAVING count(DISTINCT rid) >= {rules.min_docs}),
inside AS (SELECT leaves.* FROM leaves JOIN often USING (leaf)),
places AS (SELECT rid, no, leaf, unnest(w[{DEPTH + 1}:]) AS x, generate_subscripts(w[{DEPTH + 1}:], 1) AS i FROM inside),
constants AS (SELECT leaf, i, x, true AS fixed FROM places GROUP BY leaf, i, x HAVING count(DISTINCT rid) >= {rules.min_docs}),
masks AS (SELECT rid, no, string_agg(CASE WHEN fixed THEN x ELSE chr(1) END, ' ' ORDER BY i) AS mask, count(fixed) AS c FROM places LEFT JOIN constants USING (leaf, i, x) GROUP BY rid, no),
templates AS (SELECT rid, doc_id, no, leaf || '#' || coalesce(mask, '') AS template FROM inside LEFT JOIN masks USING (rid, no) WHERE {DEPTH} + coalesce(c, 0) >= {rules.constant_share} * n),
recurring AS (SELECT template, min(doc_id) AS first FROM templates GROUP BY template HAVING count(DISTINCT rid) >= {rules.min_docs}),
{same}gone AS (SELECT rid, no, true AS g FROM (SELECT rid, no FROM templates JOIN recurring USING (template) WHERE first < doc_id{union}))
SELECT doc_id, count(*) AS n_lines, count(g) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (g IS NULL), '') AS text
FROM lines LEFT JOIN gone USING (rid, no) GROUP BY rid, doc_id"""
