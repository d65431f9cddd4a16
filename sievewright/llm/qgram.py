"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows of two lengths: long ones for passages with many
edits, short ones for parts of an item. A document holds a window if some stretch of it
is within the window's edit budget e. Such a stretch shares at least ``m - q + 1 - e q`` q-grams
with the window of m characters, all on diagonals that lie at most e apart from where it starts.
So q-grams of the text that any window has are marked; where too few are marked for any window
nothing can be. Elsewhere marks are counted by item first, where a q-gram that many windows share
is one place: only marks on diagonals with as many as the item's least bound go on to its windows.
There they are counted by window and overlapping diagonal band, and bands that reach their window's
bound are verified by an alignment inside the band. Nothing that is
within the budget is lost, and nothing else is returned. Items too short for the lemma, of
SHORT_WORDS words or more, are sought as they are, between word boundaries, with no edit.

Texts are compared by letters and digits: A-Z in lower case, all other ASCII characters as one
space a run. The windows go to every task if the benchmark is at most ``INDEX_CHARS`` long, which
is measured first; a longer one is gone through in blocks of that length.

Defined results: null and empty texts hold nothing; a text of any length is searched whole, by
itself if it is longer than a chunk; items with less than ``Q + LEAST - 1`` characters and less
than SHORT_WORDS words name no passage and are not looked for; of equal distances the first end
counts; an empty benchmark or table gives no hits; repeated documents and items each count; a document with a null id
is judged like any other; an item of null id is used by ``decontaminate`` only, ``leaks`` has no
hits for it; other columns are ignored, or kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .wordhash import U64, chunks

Q = 8
WINDOW, STEP = 120, 60
#: Shorter windows beside them: an unedited part of SHORT + SHORT_STEP - 1 characters holds one at any offset.
SHORT, SHORT_STEP = 60, 15
RATE = 0.1
#: A window's bound is at least this; the budget of short items is lowered to it.
LEAST = 8
#: Words from which an item too short for the lemma is sought as it is.
SHORT_WORDS = 3
#: Some 150 MB of index in each worker; a longer benchmark takes one pass over the documents a block.
INDEX_CHARS = 2_000_000
_BITS = 22
#: Positions whose q-grams are looked up at once: what that makes stays in a core's cache.
LOOKUP = 1 << 15
#: Pairs of a mark and an item's q-gram that are counted at once.
PAIRS = 500_000

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def normal(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of some texts and where each begins and ends; a text never ends in a space."""
    folded = _FOLD[data]
    space = folded == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = bounds[:-1][np.diff(bounds) > 0]
    keep[first] = ~space[first]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    ends = np.r_[0, np.cumsum(keep)][bounds]
    folded = folded[keep]
    # a trailing space was kept by its run's first byte
    tail = ends[1:][(np.diff(ends) > 0)] - 1
    tail = tail[folded[tail] == 32] if len(last) else tail
    stay = np.ones(len(folded), bool)
    stay[tail] = False
    return folded[stay], np.r_[0, np.cumsum(stay)][ends]


def normal_text(text: str) -> bytes:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return normal(data, np.array([0, len(data)]))[0].tobytes()


@dataclass(frozen=True)
class Part:
    """A window of an item, with its edit budget and the bound on shared q-grams."""

    item: int
    text: bytes
    budget: int
    bound: int  # 0: too short for the lemma
    source: int  # which of the items
    start: int


def windows(items: list[tuple[int, str]]) -> list[Part]:
    found = []
    for source, (item, text) in enumerate(items):
        whole = normal_text(text)
        spans = set()
        for size, step in ((WINDOW, STEP), (SHORT, SHORT_STEP)):
            starts = {*range(0, max(1, len(whole) - size + 1), step), max(0, len(whole) - size)}
            spans |= {(s, min(s + size, len(whole))) for s in starts}
        for s, e in sorted(spans):
            part = whole[s:e]
            most = (len(part) - Q + 1 - LEAST) // Q
            if len(part) - Q + 1 < LEAST:
                if part.count(b" ") + 1 >= SHORT_WORDS:
                    found.append(Part(item, part, 0, 0, source, s))
                continue
            budget = max(0, min(int(RATE * len(part)), most))
            found.append(Part(item, part, budget, len(part) - Q + 1 - budget * Q, source, s))
    return found


def _codes(data: np.ndarray) -> np.ndarray:
    """All runs of eight bytes as integers."""
    if len(data) < Q:
        return np.zeros(0, U64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(U64)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * U64(0x9E3779B97F4A7C15) >> U64(64 - _BITS)).astype(np.int64)


def _each(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from first to last of every row, and the rows that they are of."""
    times = last - first
    row = np.repeat(np.arange(len(times)), times)
    return row, np.arange(len(row)) + np.repeat(first - np.cumsum(times) + times, times)


def _crowded(key: np.ndarray, bound) -> np.ndarray:
    """Which of the keys lie in two consecutive steps that hold ``bound(first)`` keys or more."""
    steps, counts = np.unique(key, return_counts=True)
    both = counts.copy()
    both[:-1] += np.where(steps[1:] == steps[:-1] + 1, counts[1:], 0)
    first = steps[both >= bound(steps)]
    if not len(first):
        return np.zeros(len(key), bool)
    steps = np.unique(np.r_[first, first + 1])
    return steps[np.minimum(np.searchsorted(steps, key), len(steps) - 1)] == key


class Index:
    """q-grams of all items in order of their slots, with the places in items and the windows that have each."""

    def __init__(self, parts: list[Part]):
        self.whole: dict[bytes, set[int]] = {}
        for p in parts:
            if not p.bound:
                self.whole.setdefault(p.text, set()).add(p.item)
        self.automaton = None
        if self.whole:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for text in self.whole:
                self.automaton.add_word(f" {text.decode('latin-1')} ", text)
            self.automaton.make_automaton()
        self.parts = parts = [p for p in parts if p.bound]
        codes = [_codes(np.frombuffer(p.text, np.uint8)) for p in parts]
        sizes = [len(c) for c in codes]
        all_codes = np.concatenate([np.zeros(0, U64), *codes])
        which = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        self.start = np.array([p.start for p in parts], np.int64)
        source = np.array([p.source for p in parts], np.int32)
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(p.start, p.start + n, dtype=np.int32) for p, n in zip(parts, sizes))])
        order = np.lexsort((place, source[which], all_codes, _slot(all_codes)))
        all_codes, self.which, place = all_codes[order], which[order], place[order]
        source_of = source[self.which]
        # a place of an item, and the windows that cover it; a code, and its places
        code = np.r_[True, all_codes[1:] != all_codes[:-1]][: len(order)]
        spot = code | np.r_[True, (place[1:] != place[:-1]) | (source_of[1:] != source_of[:-1])][: len(order)]
        at = np.flatnonzero(spot)
        self.source, self.place = source_of[at], place[at]
        self.windows = np.r_[at, len(order)].astype(np.int32)
        self.codes = all_codes[code]
        self.spots = np.r_[np.flatnonzero(code[at]), len(at)].astype(np.int32)
        # the first code of a slot; others follow it
        slots = _slot(self.codes)
        self.slots = np.zeros(1 << _BITS, bool)
        self.slots[slots] = True
        self.code_at = np.zeros(1 << _BITS, np.int32)
        self.code_at[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.crowd = int(np.unique(slots, return_counts=True)[1].max(initial=0))
        self.budget = np.array([p.budget for p in parts], np.int64)
        self.bound = np.array([p.bound for p in parts], np.int64)
        self.step = 2 * self.budget + 1
        self.reach = max((len(p.text) + p.budget - Q + 1 for p in parts), default=1)
        self.least = int(self.bound.min(initial=1 << 30))
        self.least_of = np.full(int(source.max(initial=0)) + 1, 1 << 30)
        np.minimum.at(self.least_of, source, self.bound)
        self.longest = int(place.max(initial=0))
        self.most = int(self.budget.max(initial=0)) + 1

    def marks(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose q-gram a window has, where enough of them lie within reach of each other, and its number."""
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(data) - Q + 1, LOOKUP):
            codes = _codes(data[s : s + LOOKUP + Q - 1])
            slots = _slot(codes)
            at = np.flatnonzero(self.slots[slots])
            number, codes = self.code_at[slots[at]], codes[at]
            for _ in range(self.crowd):
                same = self.codes[number] == codes
                places.append(at[same] + s)
                numbers.append(number[same])
                at, codes, number = at[~same], codes[~same], number[~same] + 1
                inside = number < len(self.codes)
                at, codes, number = at[inside], codes[inside], number[inside]
        at, number = np.concatenate(places), np.concatenate(numbers)
        if self.crowd > 1:
            order = np.argsort(at, kind="stable")
            at, number = at[order], number[order]
        doc = np.searchsorted(bounds, at, "right") - 1
        inside = at + Q <= bounds[doc + 1]
        at, number = at[inside], number[inside]
        # k-th mark and the (k + least - 1)-th within reach: all marks from one to the other stay
        n = self.least
        if len(at) < n:
            return at[:0], number[:0]
        near = at[n - 1 :] - at[: len(at) - n + 1] < self.reach
        cover = np.zeros(len(at) + 1, np.int64)
        cover[:-1][: len(near)] += near
        cover[n : n + len(near)] -= near[: len(cover) - n]
        stay = np.cumsum(cover[:-1]) > 0
        return at[stay], number[stay]

    def bands(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, window and band of every band that reaches its window's bound."""
        at, codes = self.marks(data, bounds)
        doc = np.searchsorted(bounds, at, "right") - 1
        # a text's marks are counted together; texts are taken as many as make PAIRS pairs
        total, cuts = np.cumsum(self.spots[codes + 1] - self.spots[codes], dtype=np.int64), [0]
        ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) + 1 if len(doc) else []
        for e in ends:
            if total[e - 1] - (total[cuts[-1] - 1] if cuts[-1] else 0) >= PAIRS or e == len(at):
                cuts.append(int(e))
        made = [self._count(*self._shared(at[s:e], codes[s:e]), bounds) for s, e in zip(cuts, cuts[1:])]
        none = np.zeros((3, 0), np.int64)
        return tuple(np.concatenate([none, *made], axis=1).astype(np.int64))

    def _shared(self, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a mark and a place of an item, on diagonals where any of the item's windows may reach its bound.

        An alignment with e edits stays on e + 1 diagonals, so it lies in two consecutive steps of that many.
        Texts are not told apart here: at worst more pairs stay.
        """
        row, spot = _each(self.spots[codes], self.spots[codes + 1])
        lowest = int(at[0]) - self.longest
        span = (int(at[-1]) - lowest) // self.most + 2
        shift = np.int64(span * self.most) * self.source - self.place - lowest
        stay = _crowded((at[row] + shift[spot]) // self.most, lambda steps: self.least_of[steps // span])
        return at[row[stay]], spot[stay]

    def _count(self, at: np.ndarray, spot: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row, k = _each(self.windows[spot], self.windows[spot + 1])
        window = self.which[k].astype(np.int64)
        text = (np.searchsorted(bounds, at, "right") - 1)[row]
        diagonal = (at - self.place[spot])[row] + self.start[window] - bounds[text]
        owner = text * len(self.parts) + window
        fine = (diagonal + WINDOW) // (self.budget[window] + 1)
        span = int(fine.max(initial=0)) + 2
        stay = _crowded(owner * span + fine, lambda steps: self.bound[steps // span % len(self.parts)])
        owner, band = owner[stay], diagonal[stay] // self.step[window[stay]]
        lowest = -WINDOW - 1
        span = int(band.max(initial=0)) - lowest + 1
        key = owner * span + (band - lowest)
        keys, counts = np.unique(np.r_[key, key - 1], return_counts=True)
        rest, band = np.divmod(keys, span)
        text, window = np.divmod(rest, max(1, len(self.parts)))
        ok = counts >= self.bound[window]
        return np.stack([text[ok], window[ok], band[ok] + lowest])

    def verify(self, data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, window: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edit distance of each window to a stretch inside its band, and where it ends in the text."""
        distance, end = np.full(len(doc), 1 << 30), np.zeros(len(doc), np.int64)
        size = np.array([len(p.text) for p in self.parts])
        for m, e in {(int(size[w]), int(self.budget[w])) for w in np.unique(window)}:
            chosen = np.flatnonzero((size[window] == m) & (self.budget[window] == e))
            for s in range(0, len(chosen), 2048):
                own = chosen[s : s + 2048]
                width = 2 * (2 * e + 1)
                base = bounds[doc[own]] + band[own] * (2 * e + 1)
                pattern = np.stack([np.frombuffer(self.parts[w].text, np.uint8) for w in window[own]])
                low, high = bounds[doc[own]][:, None], bounds[doc[own] + 1][:, None]
                # outside its text a place has a letter that no window has: to pass it costs an edit
                place = base[:, None] + np.arange(m + width)
                inside = (place >= low) & (place < high)
                letters = np.where(inside, data[np.where(inside, place, 0)], 0)
                offsets = np.arange(width, dtype=np.int16)
                d = np.zeros((len(own), width), np.int16)
                skip = np.full((len(own), width), 1 << 12, np.int16)
                for j in range(m):
                    skip[:, :-1] = d[:, 1:] + 1
                    d += letters[:, j : j + width] != pattern[:, j : j + 1]
                    np.minimum(d, skip, out=d)
                    d -= offsets
                    np.minimum.accumulate(d, axis=1, out=d)
                    d += offsets
                best = d.argmin(axis=1)
                distance[own], end[own] = d[np.arange(len(own)), best], np.minimum(base + m + best, high[:, 0]) - low[:, 0]
        return distance, end

    def contained(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Text, item and first end of the short items that stand in a text."""
        if self.automaton is None:
            return []
        found = {}
        for d, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
            for at, text in self.automaton.iter(f" {data[s:e].tobytes().decode('latin-1')} "):
                for item in self.whole[text]:
                    found.setdefault((d, item), at - 1)
        return [(d, item, at) for (d, item), at in found.items()]

    def search(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """For every text and item of which it holds a window: text, item, least distance, windows, first end."""
        data, bounds = normal(data, bounds)
        doc, window, band = self.bands(data, bounds)
        distance, end = self.verify(data, bounds, doc, window, band)
        found: dict[tuple[int, int], list] = {}
        for d, w, x, at in zip(doc, window, distance, end):
            if x <= self.budget[w]:
                own = found.setdefault((int(d), self.parts[w].item), [int(x), set(), int(at)])
                own[0], own[2] = min(own[0], int(x)), min(own[2], int(at))
                own[1].add(int(w))
        hits = [(d, i, x, len(ws), at) for (d, i), (x, ws, at) in found.items()]
        hits += [(d, i, 0, 1, at) for d, i, at in self.contained(data, bounds) if (d, i) not in found]
        return sorted(hits, key=lambda h: h[0])


_indexes: dict[str, Index] = {}


def _index(shared) -> Index:
    """The index of a broadcast block, built once a worker."""
    block = shared.value
    if block.id not in _indexes:
        _indexes.clear()
        _indexes[block.id] = Index(block.items)
    return _indexes[block.id]


@dataclass
class Block:
    """Windows of one block of the benchmark, as they are sent to the tasks."""

    id: str
    items: list[Part]


def blocks(spark: SparkSession, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", unnamed: bool = False) -> Iterator[Block]:
    """The benchmark in blocks of at most about INDEX_CHARS characters; one block if it is that short.

    Items of null id are taken in if ``unnamed``.
    """
    import uuid

    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), text_of(text_col).alias("t"))
    rows = rows if unnamed else rows.filter("item is not null")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    count = max(1, -(-size // INDEX_CHARS))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("item", "t"), F.lit(count)))
    for b in range(count):  # the driver holds one block at a time
        yield Block(uuid.uuid4().hex, windows([(r["item"], r["t"]) for r in dealt.filter(F.col("b") == b).orderBy("item", "t").toLocalIterator()]))


HITS = "doc_id long, item_id long, distance int, windows int, first_end long"


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, distance, windows, first_end): one for each document and item it holds a window of."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))

    def scan(block):
        def run(batches):
            index = _index(block)
            for batch, words in chunks(batches, 1):
                hits = index.search(words.data, words.bounds)
                if hits:
                    doc, item, distance, number, at = zip(*hits)
                    ids = batch.column(0).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(number, pa.int32()), pa.array(at, pa.int64())], ["doc_id", "item_id", "distance", "windows", "first_end"])

        return run

    found = None
    for block in blocks(spark, benchmark):
        part = rows.mapInArrow(scan(spark.sparkContext.broadcast(block)), HITS)
        found = part if found is None else found.unionAll(part)
    return found


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark."""
    at = docs.columns.index(text_col)

    def scan(block):
        def run(batches):
            index = _index(block)
            for batch, words in chunks(batches, at):
                keep = np.ones(len(batch), bool)
                keep[[h[0] for h in index.search(words.data, words.bounds)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in blocks(spark, benchmark, unnamed=True):
        docs = docs.mapInArrow(scan(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
