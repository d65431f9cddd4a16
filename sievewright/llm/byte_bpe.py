"""Byte-level BPE over whole Arrow columns: distinct pieces are merged side by side in arrays.

A text is cut before every single space or line break that follows a character other than white
space; no pre-token reaches over such a place, so pieces encode independently. Distinct pieces of
a chunk are found by Arrow's dictionary encoding. A piece whose characters have known classes is
cut into pre-tokens where the class changes, and distinct pre-tokens of one length are merged
together, a matrix of symbols with the pair of least rank merged in every row at each step. All
other pieces (runs of white space, apostrophes, special tokens, other scripts, very long ones) go
to the library as they are. Nothing is kept from one chunk to the next.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text that are encoded at once; a longer text is encoded alone, whole.
CHUNK_BYTES = 8 << 20
#: Longest pre-token in bytes that is merged in arrays.
LONGEST = 40
_NONE = np.iinfo(np.int32).max
_LETTER, _DIGIT, _MARK, _SPACE, _ODD = 1, 2, 3, 4, 5


def _kind(ch: str) -> int:
    if ch.isspace():
        return _ODD
    return {"L": _LETTER, "N": _DIGIT, "C": _ODD}.get(unicodedata.category(ch)[0], _MARK)


#: Classes of single bytes; of two-byte characters below U+0560 by lead and continuation byte.
_ONE = np.array([_kind(chr(b)) if b < 128 else _ODD for b in range(256)], np.uint8)
_ONE[[10, 32]] = _SPACE
_ONE[ord("'")] = _ODD
_TWO = np.full((0xD6 - 0xC2, 256), _ODD, np.uint8)
for _cp in range(0x80, 0x560):
    _TWO[(0xC0 | _cp >> 6) - 0xC2, 0x80 | _cp & 63] = _kind(chr(_cp))
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
#: Last bytes that white space of more than one byte can end with, by the byte before.
_WIDE = np.zeros((256, 256), bool)
for _cp in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    _WIDE[tuple(chr(_cp).encode()[-2:])] = True


def byte_letters() -> list[str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` of the given starts and lengths, one behind the other."""
    ends = np.cumsum(lengths)
    where = np.repeat(starts - (ends - lengths), lengths)
    where += np.arange(len(where))
    return flat[where]


class Merges:
    """Rank of a pair of symbols, by two hash tables without collisions."""

    SLOTS = 18

    def __init__(self, pairs: np.ndarray, results: np.ndarray):
        self.results = np.append(results, -1).astype(np.int32)
        keys = pairs[:, 0].astype(np.uint64) << np.uint64(32) | pairs[:, 1].astype(np.uint64)
        rng, left = np.random.default_rng(7), np.arange(len(keys))
        self.levels = []
        while len(left):
            odd = rng.integers(1, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            slot = (keys[left] * odd) >> np.uint64(64 - self.SLOTS)
            _, first = np.unique(slot, return_index=True)
            held = np.full(1 << self.SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
            rank = np.full(1 << self.SLOTS, _NONE, np.int32)
            held[slot[first]], rank[slot[first]] = keys[left[first]], left[first]
            self.levels.append((odd, held, rank))
            left = np.delete(left, first)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.full(keys.shape, _NONE, np.int32)
        for odd, held, rank in self.levels:
            slot = ((keys * odd) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
            np.minimum(out, np.where(held[slot] == keys, rank[slot], _NONE), out=out)
        return out

    def apply(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of symbols of one length: all merged rows one behind the other, and their lengths."""
        n, width = ids.shape
        lengths, rows, done = np.zeros(n, np.int64), np.arange(n), []
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), _NONE)
            over = least == _NONE
            if over.any():
                lengths[rows[over]] = width
                done.append((rows[over], ids[over]))
                going = ~over
                ids, rank, rows, at, least = ids[going], rank[going], rows[going], at[going], least[going]
            if not len(rows):
                break
            k = np.arange(len(rows))
            ids[k, at] = self.results[least]
            keep = np.ones(ids.shape, bool)
            keep[k, at + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            rank = rank[keep[:, 1:]].reshape(len(rows), width - 2)
            width -= 1
            if width > 1:
                on = at > 0
                rank[k[on], at[on] - 1] = self.ranks(ids[k[on], at[on] - 1], ids[k[on], at[on]])
                on = at < width - 1
                rank[k[on], at[on]] = self.ranks(ids[k[on], at[on]], ids[k[on], at[on] + 1])
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        for rows, ids in done:
            flat[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, lengths


def _column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a binary column."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    kind = _ONE[data]
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xD6))
    kind[lead] = kind[lead + 1] = _TWO[data[lead] - 0xC2, data[lead + 1]]
    return kind


class Encoder:
    """Encodes texts as the tokenizer of a file does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.symbols = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.merges = Merges(np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2), np.array([vocab[a + b] for a, b in pairs], np.int64))

    def parts(self, column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """For rows of at most CHUNK_BYTES (one row at least): which, their ids in a row, and how many each has."""
        data, bounds = _bytes(column)
        row = 0
        while row < len(bounds) - 1:
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, "right")) - 1)
            yield slice(row, end), *self._chunk(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row])
            row = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        got = list(self.parts(pa.array(texts, pa.string())))
        return np.concatenate([np.zeros(0, np.int32), *(g[1] for g in got)]), np.concatenate([np.zeros(0, np.int64), *(g[2] for g in got)])

    def _chunk(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = _BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = blank[1:] & (data[:-1] > 32)
            wide = np.flatnonzero(cut[2:-1] & (data[1:-1] >= 0x80)) + 2
            cut[wide[_WIDE[data[wide - 2], data[wide - 1]]]] = False
        cut[bounds] = True
        places = np.flatnonzero(cut)
        coded = _column(data, places).dictionary_encode()
        at = coded.indices.to_numpy()
        flat, starts, lengths = self._pieces(coded.dictionary)
        sizes = lengths[at]
        ends = np.r_[0, np.cumsum(sizes)][np.searchsorted(places, bounds)]
        return ragged(flat, starts[at], sizes), np.diff(ends)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, where each piece's begin, and how many it has."""
        data, bounds = _bytes(pieces)
        n = len(pieces)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = classes(data)
        first = bounds[:-1]
        blank = kind == _SPACE
        blank[first] = False
        odd = (kind == _ODD) | blank
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        slow = np.logical_or.reduceat(odd, first) | ((kind[first] == _SPACE) & (np.diff(bounds) == 1))
        opens = np.empty(len(data) + 1, bool)
        opens[0] = opens[-1] = True
        opens[1:-1] = kind[1:] != kind[:-1]
        opens[bounds] = True
        spaced = first[data[first] == 32] + 1
        opens[spaced[~slow[data[first] == 32]]] = False
        begins = np.flatnonzero(opens)
        owner = np.searchsorted(bounds, begins[:-1], "right") - 1
        slow[owner[np.diff(begins) > LONGEST]] = True
        fast = ~slow[owner]
        begin, size = begins[:-1][fast], np.diff(begins)[fast]
        tokens = _column(ragged(data, begin, size), np.r_[0, np.cumsum(size)]).dictionary_encode()
        word = tokens.indices.to_numpy()
        flat, starts, lengths = self._words(tokens.dictionary)
        out_lengths = np.zeros(n, np.int64)
        out_lengths += np.bincount(owner[fast], lengths[word], n).astype(np.int64)
        out = [ragged(flat, starts[word], lengths[word])]
        out_starts = np.cumsum(out_lengths) - out_lengths
        if slow.any():
            of = np.flatnonzero(slow)
            base = len(out[0])
            texts = pieces.take(pa.array(of)).cast(pa.string()).to_pylist()
            for k in range(0, len(texts), 8192):
                got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + 8192], add_special_tokens=False)]
                size = np.fromiter(map(len, got), np.int64, len(got))
                out.append(np.fromiter(chain.from_iterable(got), np.int32, int(size.sum())))
                out_lengths[of[k : k + 8192]] = size
                out_starts[of[k : k + 8192]] = base + np.cumsum(size) - size
                base += len(out[-1])
        return np.concatenate(out), out_starts, out_lengths

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _pieces, for distinct pre-tokens."""
        data, bounds = _bytes(words)
        size = np.diff(bounds)
        starts, lengths, out, base = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [np.zeros(0, np.int32)], 0
        for width in np.unique(size):
            rows = np.flatnonzero(size == width)
            for k in range(0, len(rows), 1 << 15):
                some = rows[k : k + (1 << 15)]
                flat, n = self.merges.apply(self.symbols[data[bounds[some][:, None] + np.arange(width)]])
                starts[some], lengths[some] = base + np.cumsum(n) - n, n
                out.append(flat)
                base += len(flat)
        return np.concatenate(out), starts, lengths


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder: the vocabulary only, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
