"""Removal of repeated passages by recompression.

Rounds rename the corpus: maximal runs of an equal word become one symbol, then every neighbouring
pair whose left symbol falls into one half of the alphabet and whose right symbol falls into the
other becomes one symbol. A name is a function of what it stands for, so that all tasks of a job
give the same name to the same run or pair without an exchange, and whether two neighbours are
joined depends on these two alone. Two rounds give symbols of at most four words (runs aside), and
where such a symbol begins and ends depends on the three words on either side: equal substrings
have the same symbols in their interior.

Any window of 13 words holds a symbol of the last round with the three words on either side that
fix it, or a place with five words on either side at which a run goes on. These are its anchors,
keyed by the symbol's name with those of its surroundings, the same in every text that holds the
window. Pass 1 counts anchors and keeps those of two texts or more: shared symbols reveal what
repeats. Pass 2 verifies the windows around them, by two independent 64-bit hashes over all their
words, and finds the least document of each; pass 3 removes. Anchors and windows are reduced
inside every task before they are exchanged, as sorted arrays by range of the hash, so that a
passage of every document costs one entry a task. What is looked up lies in sorted arrays in the
shared folder, memory-mapped.

Defined results: null and empty texts have no words; a text of any length is taken whole, by
itself if it is longer than a chunk; a row with a null id neither loses words nor serves as the
earlier document; rows with equal ids do not remove each other's words (neither id is smaller); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, text_of
from .wordhash import (
    U64, SortedHashes, Words, chunks, find_unsorted, mix, pack, pack_values, range_count, ranges, sizes_of, unpack, unpack_values,
)

WINDOW = 13
#: With ROUNDS = 2 symbols have at most 4 words, FIXED words on either side settle where they begin
#: and end, and a place within a run is keyed by SIDE words on either side.
ROUNDS = 2
FIXED = 3
SIDE = 5
#: Keys that a task holds before it sends them, and that a range is meant to have.
HELD = 4_000_000
_STEP = U64(0x9FB21C651E98DF25)


def _run_of(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a symbol equals its left neighbour in the same text."""
    same = np.zeros(len(symbols), bool)
    same[1:] = (symbols[1:] == symbols[:-1]) & (doc[1:] == doc[:-1])
    return same


def symbols(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of the last round, by name and first word, and the words at which a run goes on."""
    run = _run_of(words, doc)
    starts = np.flatnonzero(~run)
    lengths = np.diff(np.r_[starts, len(words)])
    block = lengths > 1  # a run is a symbol of its own and is never joined with another
    names = np.where(block, mix(words[starts] + lengths.astype(U64)), words[starts])
    where, texts = starts, doc[starts]
    for k in range(rounds):
        right = (mix(names ^ U64(0xA0761D6478BD642F + k)) >> U64(63)).astype(bool)
        join = np.zeros(len(names), bool)
        join[:-1] = ~right[:-1] & right[1:] & ~block[:-1] & ~block[1:] & (texts[:-1] == texts[1:])
        after = np.roll(join, 1)
        named = names.copy()
        at = np.flatnonzero(join)
        named[at] = mix(names[at] * _STEP + names[at + 1] + U64(k + 2))
        keep = ~after
        names, where, texts, block = named[keep], where[keep], texts[keep], block[keep]
    return names, where, np.flatnonzero(run)


def _sums(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words from each of the places ``at``."""
    total = np.zeros(len(at), U64)
    for k in range(size):
        total = total * _STEP + words[at + k]
    return mix(total)


class Text:
    """The words of a chunk with the text of each."""

    def __init__(self, words: Words):
        self.words, self.h, self.at = words, words.hashes, words.at
        self.counts = np.diff(words.at)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.left = np.arange(len(self.h)) - self.at[self.doc]
        self.right = self.at[self.doc + 1] - np.arange(len(self.h))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors by their first word, words spanned, and key."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        names, where, inside = symbols(self.h, self.doc)
        size = np.diff(np.r_[where, len(self.h)])
        ok = (size + 2 * FIXED <= WINDOW) & (self.left[where] >= FIXED) & (self.right[where] >= size + FIXED)
        names, where, size = names[ok], where[ok], size[ok]
        key = mix(names + size.astype(U64)) * _STEP + _sums(self.h, where - FIXED, FIXED)
        key = mix(key * _STEP + _sums(self.h, where + size, FIXED))
        inside = inside[(self.left[inside] >= SIDE) & (self.right[inside] >= SIDE)]
        return np.r_[where - FIXED, inside - SIDE], np.r_[size + 2 * FIXED, np.full(len(inside), 2 * SIDE)], np.r_[key, _sums(self.h, inside - SIDE, 2 * SIDE)]

    def windows(self, shared: SortedHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows around shared anchors by their first word, and their two hashes."""
        first, size, keys = self.anchors()
        hit = find_unsorted(shared, keys)[0]
        # a window that holds the anchor begins at most WINDOW - size words before it, in the same text
        first, size = first[hit], size[hit]
        begin = np.maximum(first + size - WINDOW, first - self.left[first])
        cover = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, first + 1, -1)
        at = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & (self.right >= WINDOW))
        if not len(at):
            return at, np.zeros(0, U64), np.zeros(0, U64)
        return at, _sums(self.h, at, WINDOW), _sums(self.words.check_hashes(), at, WINDOW)


BLOBS = "part int, keys binary, more binary"


def _rows(parts: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*parts)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["part", "keys", "more"])


def send_anchors(count: int):
    """Per task: distinct anchor keys, and those that two of its texts share."""

    def flush(held, doubled):
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        twice = np.unique(np.concatenate([keys[times > 1], *doubled]))
        a, b = ranges(keys, count), ranges(twice, count)
        return _rows([(i, pack(keys[a[i] : a[i + 1]]), pack(twice[b[i] : b[i + 1]])) for i in range(count) if a[i + 1] > a[i]])

    def run(batches):
        held, doubled, size = [], [], 0
        for _, words in chunks(batches, 1):
            text = Text(words)
            places, _, keys = text.anchors()
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], text.doc[places[order]]
            fresh = np.r_[True, keys[1:] != keys[:-1]]
            doubled.append(keys[1:][~fresh[1:] & (doc[1:] != doc[:-1])])
            held.append(keys[fresh])
            size += len(held[-1])
            if size >= HELD:
                yield flush(held, doubled)
                held, doubled, size = [], [], 0
        if held:
            yield flush(held, doubled)

    return run


def _by_part(batches):
    found: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for part, keys, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found.setdefault(part, []).append((keys, more))
    return found


def store_shared(folder: str):
    """Per range: keys of two texts or more, as one sorted file."""

    def run(batches):
        for part, blobs in _by_part(batches).items():
            keys = np.concatenate([unpack(x) for x, _ in blobs] + [unpack(y) for _, y in blobs])
            keys.sort()
            again = keys[1:] == keys[:-1]
            shared = keys[1:][again]
            shared = shared[np.r_[True, shared[1:] != shared[:-1]]] if len(shared) else shared
            SortedHashes.write(folder, part, {"key": shared})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(shared)])], ["part", "n"])

    return run


NONE = np.iinfo(np.int64).max


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False)


def _least(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of hashes in order of both, with the least id of each."""
    order = np.lexsort((checks, keys))
    keys, checks, ids = keys[order], checks[order], ids[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], checks[first], np.minimum.reduceat(ids, first) if len(first) else ids


def send_windows(folder: str, shared: np.ndarray, count: int):
    """Per task: hashes of windows around shared anchors, with the least document of each."""

    def flush(held):
        keys, checks, least = _least(*map(np.concatenate, zip(*held)))
        a = ranges(keys, count)
        full = [slice(a[i], a[i + 1]) for i in range(count)]
        return _rows([(i, pack(keys[s]), pack_values(checks[s]) + pack_values(least[s])) for i, s in enumerate(full) if s.stop > s.start])

    def run(batches):
        table = SortedHashes(folder, shared, {"key": "<u8"})
        held, size = [], 0
        for batch, words in chunks(batches, 1):
            text = Text(words)
            at, keys, checks = text.windows(table)
            if not len(at):
                continue
            held.append(_least(keys, checks, _ids(batch)[text.doc[at]]))
            size += len(held[-1][0])
            if size >= HELD // 2:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def store_windows(folder: str):
    """Per range: windows with their least document. Of windows whose first hash is shared by other words too, all are kept."""

    def run(batches):
        for part, blobs in _by_part(batches).items():
            keys = np.concatenate([unpack(x) for x, _ in blobs])
            checks = np.concatenate([unpack_values(y[: len(y) // 2], U64) for _, y in blobs])
            ids = np.concatenate([unpack_values(y[len(y) // 2 :]) for _, y in blobs])
            keys, checks, least = _least(keys, checks, ids)
            SortedHashes.write(folder, part, {"key": keys, "check": checks, "doc": least})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)])], ["part", "n"])

    return run


def _earlier(windows: SortedHashes, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows in any order: which are there by both hashes, and the least document of each."""
    order = np.argsort(keys)
    there, least = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    cuts = ranges(keys[order], windows.count)
    for i in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[i] : cuts[i + 1]]
        part = windows.part(int(i))
        at, end = np.searchsorted(part["key"], keys[own]), len(part["key"])
        while len(own):  # equal first hashes lie side by side; nearly all windows end after one step
            live = at < end
            own, at = own[live], at[live]
            live = part["key"][at] == keys[own]
            own, at = own[live], at[live]
            same = part["check"][at] == checks[own]
            there[own[same]], least[own[same]] = True, part["doc"][at[same]]
            own, at = own[~same], at[~same] + 1
    return there, least


def remove_repeats(folders: tuple[str, str], sizes: tuple[np.ndarray, np.ndarray]):
    """Rows (doc_id, n_words, n_removed, text) with the kept words joined by one space."""

    def run(batches):
        shared = SortedHashes(folders[0], sizes[0], {"key": "<u8"})
        windows = SortedHashes(folders[1], sizes[1], {"key": "<u8", "check": "<u8", "doc": "<i8"})
        for batch, words in chunks(batches, 1):
            text = Text(words)
            at, keys, checks = text.windows(shared)
            there, least = _earlier(windows, keys, checks)
            own = _ids(batch)[text.doc[at]]
            gone = at[there & (least < own) & (own != NONE)]
            cover = np.zeros(len(text.h) + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
            cut = np.cumsum(cover[:-1]) > 0
            removed = np.diff(np.r_[0, np.cumsum(cut)][text.at])
            data, kept = words.data.tobytes(), []
            for d, n in enumerate(removed):
                own_words = data[words.bounds[d] : words.bounds[d + 1]].split()
                if n:
                    own_words = [w for w, c in zip(own_words, cut[text.at[d] : text.at[d + 1]].tolist()) if not c]
                kept.append(b" ".join(own_words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, text): every text without what an earlier document holds.

    A word goes if a window of 13 words that covers it also starts in a document of smaller id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    volume = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = range_count(volume // 10, HELD, least)
    folders = shared_folder(spark, "anchors"), shared_folder(spark, "windows")
    anchors = rows.mapInArrow(send_anchors(count), BLOBS).repartitionById(count, F.col("part"))
    shared = sizes_of(anchors.mapInArrow(store_shared(folders[0]), "part int, n long").collect(), count)  # one row a range
    second = range_count(4 * int(shared.sum()), HELD, least)
    windows = rows.mapInArrow(send_windows(folders[0], shared, second), BLOBS).repartitionById(second, F.col("part"))
    found = sizes_of(windows.mapInArrow(store_windows(folders[1]), "part int, n long").collect(), second)
    return rows.mapInArrow(remove_repeats(folders, (shared, found)), "doc_id long, n_words long, n_removed long, text string")


def oracle_sql() -> str:
    """The digest of the removal from ``documents`` as DuckDB SQL, with every window as a row."""
    return f"""
WITH texts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts)),
least AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM windows JOIN least USING (x), range({WINDOW}) t(k) WHERE first < doc_id GROUP BY doc_id),
kept AS (SELECT doc_id, w, CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END AS k FROM texts LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""
