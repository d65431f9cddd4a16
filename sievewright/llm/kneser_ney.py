"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, read from mapped files.

Level 1 holds the hashes of all training tokens in sorted order; a token's number is its rank
there. An n-gram of level k is the number of its first k - 1 tokens (a rank of level k - 1) above
that of its last, each in the bits that its level needs, so its key is exact (and a model too large
for 64 bits is refused); keys are put through a bijection that spreads them evenly and are stored
as sorted arrays by range. Counting reduces within each task, then by range
of the key; as ranges follow a hash, no token or context is hot in any of them.

From the top level down, one job a level reads the sorted arrays and sends what contexts need
(total, numbers of continuations seen once, twice, oftener) and continuation counts to the files
of the level below. Workers map these files and look up the sorted keys of a whole chunk of text
at once, so that pages are touched in order.

A text begins with a start token, which is never predicted, and ends with an end token, which is.

Defined results: null and empty texts consist of the end token; rows repeat as they come; a null
id counts as remainder null, which is neither held out nor withheld from training; an empty
training set gives the uniform distribution over the unknown token; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, shared_folder, text_of
from .wordhash import U64, SortedHashes, chunks, find_unsorted, pack, pack_values, range_count, ranges, sizes_of, spread, unpack, unpack_values, unspread

END, START = U64(0x5B2F_9D11_7C83_E6A5), U64(0xC4A7_31E8_0F5D_9B27)
HELD = 4_000_000
#: A key holds a context's number above a token's; a model whose numbers do not fit is refused, never merged.
KEY_BITS = 64
BLOBS = "kind int, part int, keys binary, more binary"
COLUMNS = {"key": "<u8", "raw": "<u8", "adjusted": "<u8", "total": "<u8", "gamma": "<f4"}


@dataclass
class Level:
    """Files of one level: ``parts`` ranges, keys before each, discounts for counts 1, 2, 3 and more."""

    folder: str
    sizes: np.ndarray
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)

    def __post_init__(self):
        self.parts, self.size, self.offsets = len(self.sizes), int(self.sizes.sum()), np.cumsum(self.sizes) - self.sizes

    @property
    def bits(self) -> int:
        """Bits of a number of this level."""
        return max(1, self.size.bit_length())

    def table(self, *columns: str) -> SortedHashes:
        return SortedHashes(self.folder, self.sizes, {c: COLUMNS[c] for c in ("key", *columns)}, True)

    def part_of(self, ranks: np.ndarray) -> np.ndarray:
        """Cuts of sorted ranks by part."""
        return np.searchsorted(ranks, np.r_[self.offsets, self.size])


@dataclass
class Model:
    order: int
    levels: list[Level] = field(default_factory=list)
    tokens: int = 0
    vocabulary: int = 0
    adjusted_total: int = 0
    adjusted_gamma: float = 1.0


def key_of(levels: list[Level], k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of level ``k`` (2 or more) for numbers of level k - 1 and of tokens."""
    return spread(context << U64(levels[0].bits) | word, levels[0].bits + levels[k - 2].bits)


def parts_of(levels: list[Level], k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``key_of``."""
    pairs, low = unspread(keys, levels[0].bits + levels[k - 2].bits), levels[0].bits
    return pairs >> U64(low), pairs & U64((1 << low) - 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "part", "keys", "more"])


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


class Stream:
    """Tokens of a chunk: start, words, end of each text."""

    def __init__(self, words):
        counts = np.diff(words.at) + 2
        self.at = np.r_[0, np.cumsum(counts)]
        self.h = np.empty(self.at[-1], U64)
        inner = np.ones(len(self.h), bool)
        inner[self.at[:-1]] = inner[self.at[1:] - 1] = False
        self.h[inner] = words.hashes
        self.h[self.at[:-1]], self.h[self.at[1:] - 1] = START, END
        self.place = np.arange(len(self.h)) - np.repeat(self.at[:-1], counts)

    def lookups(self, levels: list[Level], tables: list[SortedHashes]):
        """For each level of ``levels``: whether the n-gram that ends at each token is there, and its values."""
        there, values = find_unsorted(tables[0], self.h)
        known, word = there, values["rank"].astype(U64)
        yield there, values
        for k, table in enumerate(tables[1:], 2):
            at = np.flatnonzero((self.place >= k - 1) & known & np.roll(there, 1))
            keys = key_of(levels, k, np.roll(values["rank"], 1)[at].astype(U64), word[at])
            hit, got = find_unsorted(table, keys)
            there = np.zeros(len(self.h), bool)
            there[at] = hit
            values = {}
            for n, v in got.items():
                values[n] = np.zeros(len(self.h), v.dtype)
                values[n][at] = v
            yield there, values


def send_counts(levels: list[Level], parts: int):
    """Counts of n-grams one level above ``levels`` (tokens where there is none), reduced in the task."""
    k = len(levels) + 1

    def flush(held):
        keys, counts = _summed(*map(np.concatenate, zip(*held)))
        a = ranges(keys, parts)
        return _batch([(0, i, pack(keys[a[i] : a[i + 1]]), pack_values(counts[a[i] : a[i + 1]])) for i in range(parts) if a[i + 1] > a[i]])

    def run(batches):
        held, size = [], 0
        tables = [x.table() for x in levels]
        for _, words in chunks(batches, 0, fold=True):
            stream = Stream(words)
            if levels:
                found = list(stream.lookups(levels, tables))
                first, (there, values) = found[0][1]["rank"], found[-1]
                at = np.flatnonzero((stream.place >= k - 1) & np.roll(there, 1))
                keys = key_of(levels, k, np.roll(values["rank"], 1)[at].astype(U64), first[at].astype(U64))
                ones = np.ones(len(keys), np.uint64)
            else:
                keys, ones = stream.h, (stream.h != START).astype(np.uint64)
            held.append(_summed(keys, ones))
            size += len(held[-1][0])
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _by_part(batches) -> dict[tuple[int, int], list[tuple[bytes, bytes]]]:
    found: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for kind, part, keys, more in zip(*(batch.column(i).to_pylist() for i in range(4))):
            found.setdefault((part, kind), []).append((keys, more))
    return found


TALLY = "part int, n long, total long, n1 long, n2 long, n3 long, n4 long"


def _tally(part: int, counts: np.ndarray) -> pa.RecordBatch:
    values = [len(counts), int(counts.sum()), *(int((counts == c).sum()) for c in (1, 2, 3, 4))]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v]) for v in values)], ["part", "n", "total", "n1", "n2", "n3", "n4"])


def store_counts(folder: str):
    def run(batches):
        for (part, _), blobs in _by_part(batches).items():
            keys, counts = _summed(np.concatenate([unpack(x) for x, _ in blobs]), np.concatenate([unpack_values(y, U64) for _, y in blobs]))
            SortedHashes.write(folder, part, {"key": keys, "raw": counts}, dense=True)
            yield _tally(part, counts)

    return run


def send_down(levels: list[Level], top: bool):
    """From a level's files: sums of contexts (kind 0) and continuation counts (kind 1) for the level below."""
    level, below = levels[-1], levels[-2]

    def run(batches):
        table = level.table("raw" if top else "adjusted")
        lower = below.table()
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if part == 0:  # every part of the level below is written, also if nothing leads to it
                    yield _batch([(0, i, b"", b"") for i in range(below.parts)])
                data = table.part(part)
                for s in range(0, len(data["key"]), HELD):
                    counts = np.asarray(data["raw" if top else "adjusted"][s : s + HELD]).astype(U64)
                    context, word = parts_of(levels, len(levels), np.asarray(data["key"][s : s + HELD]))
                    seen = [(counts == 1).astype(U64), (counts == 2).astype(U64), (counts > 2).astype(U64)]
                    contexts, *sums = _summed(context, counts, *seen)
                    a = below.part_of(contexts.astype(np.int64))
                    yield _batch([(0, i, pack(contexts[a[i] : a[i + 1]]), b"".join(pack_values(x[a[i] : a[i + 1]]) for x in sums)) for i in range(below.parts) if a[i + 1] > a[i]])
                    ends = word
                    if len(levels) > 2:  # the n-gram without its first token: the context's last token, then the word
                        of = np.searchsorted(below.offsets, contexts.astype(np.int64), "right") - 1
                        last = np.zeros(len(contexts), U64)
                        for i in np.unique(of):
                            at = of == i
                            last[at] = parts_of(levels, len(levels) - 1, np.asarray(lower.part(int(i))["key"][contexts[at].astype(np.int64) - below.offsets[i]]))[1]
                        suffix = key_of(levels, len(levels) - 1, last[np.searchsorted(contexts, context)], word)
                        ends = find_unsorted(lower, suffix)[1]["rank"].astype(U64)
                    ranks, times = _summed(ends, np.ones(len(ends), U64))
                    a = below.part_of(ranks.astype(np.int64))
                    yield _batch([(1, i, pack(ranks[a[i] : a[i + 1]]), pack_values(times[a[i] : a[i + 1]])) for i in range(below.parts) if a[i + 1] > a[i]])

    return run


def store_down(below: Level, discounts: tuple[float, float, float], first: tuple[Level, int] | None):
    """Writes total, gamma and adjusted counts beside the keys of the level below.

    ``first``: level 1 and the start token's rank, where n-grams that begin with it keep their own counts.
    """

    def run(batches):
        table = below.table("raw")
        for part, found in _grouped(_by_part(batches)).items():
            data = table.part(part)
            n, offset = len(data["key"]), int(below.offsets[part])
            sums = np.zeros((4, n), U64)
            for keys, more in found.get(0, []):
                ranks = unpack(keys).astype(np.int64) - offset
                size = len(more) // 4
                for k in range(4):
                    sums[k][ranks] += unpack_values(more[k * size : (k + 1) * size], U64)
            adjusted = np.zeros(n, U64)
            for keys, more in found.get(1, []):
                adjusted[unpack(keys).astype(np.int64) - offset] += unpack_values(more, U64)
            if first is not None and first[1] >= 0:
                opens = parts_of([first[0]], 2, np.asarray(data["key"]))[0] == U64(first[1])
                adjusted[opens] = np.asarray(data["raw"])[opens]
            total = sums[0]
            gamma = sum(d * s for d, s in zip(discounts, sums[1:])) / np.maximum(total, 1)
            SortedHashes.write(below.folder, part, {"adjusted": adjusted, "total": total, "gamma": gamma.astype(np.float32)})
            yield _tally(part, adjusted)

    return run


def _grouped(found):
    parts: dict[int, dict[int, list]] = {}
    for (part, kind), blobs in found.items():
        parts.setdefault(part, {})[kind] = blobs
    return parts


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts; their customary stand-ins where a count of counts is zero."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


def fit(spark: SparkSession, texts: DataFrame, order: int = 3) -> Model:
    """Counts the one text column of ``texts`` into the files of a model of ``order`` 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    volume = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    model = Model(order)
    for k in range(1, order + 1):
        parts = range_count(volume // (16 if k == 1 else 8), HELD, 8)  # by the volume alone: contexts go from every range to every range
        folder = shared_folder(spark, f"ngrams{k}")
        sent = texts.mapInArrow(send_counts(model.levels, parts), BLOBS).repartitionById(parts, F.col("part"))
        rows = sent.mapInArrow(store_counts(folder), TALLY).collect()  # one row a range
        level = Level(folder, sizes_of(rows, parts))
        if k < order and level.size.bit_length() + (model.levels or [level])[0].bits > KEY_BITS:
            raise ValueError(f"{level.size} n-grams of level {k} leave no exact {KEY_BITS}-bit key for the next; fit a lower order")
        if k == 1:
            model.tokens, model.vocabulary = sum(r["total"] for r in rows), max(0, level.size - 1)
        level.discounts = discounts(*(sum(r[c] for r in rows) for c in ("n1", "n2", "n3", "n4")))
        model.levels.append(level)
    for k in range(order, 1, -1):
        level, below = model.levels[k - 1], model.levels[k - 2]
        first = None
        if k > 2:
            found, got = model.levels[0].table().find(np.array([START], U64))
            first = model.levels[0], int(got["rank"][0]) if found[0] else -1
        parts = spark.range(0, level.parts, 1, level.parts)
        sent = parts.mapInArrow(send_down(model.levels[:k], k == order), BLOBS).repartitionById(below.parts, F.col("part"))
        rows = sent.mapInArrow(store_down(below, level.discounts, first), TALLY).collect()
        below.discounts = discounts(*(sum(r[c] for r in rows) for c in ("n1", "n2", "n3", "n4")))
        if k == 2:
            model.adjusted_total = sum(r["total"] for r in rows)
            n1, n2 = (sum(r[c] for r in rows) for c in ("n1", "n2"))
            more = sum(r["n"] for r in rows) - n1 - n2
            # the start token's adjusted count is 0, and so is that of no other token
            more -= 1 if below.size else 0
            model.adjusted_gamma = float(np.dot(below.discounts, (n1, n2, more)) / model.adjusted_total) if model.adjusted_total else 1.0
    return model


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array((0.0, *discounts))[np.minimum(counts, 3).astype(np.int64)]


def log_probabilities(model: Model, stream: Stream, tables: list[SortedHashes]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of every token's probability (0 for start tokens), and its count in the training texts."""
    rest = model.adjusted_gamma / (model.vocabulary + 1)
    raw, earlier = None, None
    for k, (level, (there, got)) in enumerate(zip(model.levels, stream.lookups(model.levels, tables))):
        top = k + 1 == model.order
        share = np.where(there, _discounted(got["raw" if top else "adjusted"], level.discounts), 0.0)
        if k == 0:
            raw = got["raw"]
            p = np.maximum(share, 0) / max(model.adjusted_total, 1) + rest
        else:
            total, gamma = np.roll(earlier["total"], 1), np.roll(earlier["gamma"], 1).astype(float)
            seen = (stream.place >= k) & (total > 0)
            p = np.where(seen, np.maximum(share, 0) / np.maximum(total, 1) + gamma * p, p)
        earlier = got
    p[stream.place == 0] = 1.0
    return np.log10(p), raw


def score_rows(model: Model):
    def run(batches):
        tables = [x.table(*(("raw", "adjusted", "total", "gamma") if k == 0 else ("raw",) if k + 1 == model.order else ("adjusted", "total", "gamma"))) for k, x in enumerate(model.levels)]
        for batch, words in chunks(batches, 1, fold=True):
            stream = Stream(words)
            log_p, raw = log_probabilities(model, stream, tables)
            base = np.log10((raw + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
            base[stream.place == 0] = 0.0
            starts = stream.at[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(stream.at) - 1), pa.array(np.add.reduceat(((raw > 0) & (stream.place > 0)).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(log_p, starts)),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, base_score, score) and perplexity = 10 ** (-score / n_tokens)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    out = rows.mapInArrow(score_rows(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def lm_scores(spark: SparkSession, docs: DataFrame, order: int = 3, folds: int = 5, held_out: int = 1) -> DataFrame:
    """Fits on documents outside the held-out fold and scores all of them."""
    out = F.coalesce(bucket("doc_id", folds) == held_out, F.lit(False))
    model = fit(spark, docs.filter(~out).select(text_of("text").alias("t")), order)
    return score(model, docs).select("*", out.alias("held_out"), F.lit(model.tokens).cast("long").alias("train_tokens"))
