"""Whole Arrow batches of texts as arrays of word hashes, and sorted hash arrays in files.

Texts are never looped over word by word. A batch is one byte buffer; words are found with a
table of byte classes, and each word's 64-bit hash comes from prefix sums of a polynomial over
random byte values modulo 2**64, mixed with the word's length.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is worked on alone, whole.
CHUNK_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20_240_229)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_OTHERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, up to ``n`` of them."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + 65_536)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _odds(bits: int) -> tuple[int, int]:
    top = (1 << bits) - 1
    return 0xBF58476D1CE4E5B9 & top | 1, 0x94D049BB133111EB & top | 1


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of integers of ``bits`` bits that spreads them, moved to the top of 64 bits."""
    top, half = U64((1 << bits) - 1), U64(bits // 2 + 1)
    for odd in _odds(bits):
        x = (x * U64(odd)) & top
        x = x ^ (x >> half)
    return x << U64(64 - bits)


def unspread(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``spread``."""
    top, half = U64((1 << bits) - 1), U64(bits // 2 + 1)
    x = x >> U64(64 - bits)
    for odd in reversed(_odds(bits)):
        x = x ^ (x >> half)  # its own inverse, as half of the bits and one more are left
        x = (x * U64(pow(odd, -1, 1 << bits))) & top
    return x


class Words:
    """Words of some texts: hashes, and for text d the words ``at[d]`` to ``at[d + 1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold: bool = False):
        if fold:
            data = _FOLD[data]
        self.data, self.bounds = data, bounds
        inside = ~_SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        first = bounds[:-1][bounds[:-1] < len(data)]
        opens[first] = inside[first]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = bounds[1:][bounds[1:] > 0] - 1
        closes[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.at = np.searchsorted(self.starts, bounds)
        self._hashes = None

    def _hash(self, values: np.ndarray) -> np.ndarray:
        up, down = _power(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, U64)
        sums[0] = 0
        np.cumsum(values[self.data] * up[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self._hash(_VALUES)
        return self._hashes

    def check_hashes(self) -> np.ndarray:
        """Hashes of the words by other byte values: words that agree in both agree by 128 bits."""
        return self._hash(_OTHERS)


def chunks(batches, text: int, fold: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches of at most CHUNK_BYTES of text (one row at least) with their words."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        row = 0
        while row < len(column):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(row, end - row), Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], fold)
            row = end


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as byte planes of their differences; zero planes take no room once compressed."""
    gaps = np.diff(values, prepend=U64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def pack_values(values: np.ndarray) -> bytes:
    """64-bit integers in any order as byte planes."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_values(blob: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(kind).ravel()


def ranges(sorted_keys: np.ndarray, count: int) -> np.ndarray:
    """Where each of ``count`` equal ranges of the 64-bit keys begins and ends."""
    shift = U64(64 - (count.bit_length() - 1))
    edges = np.arange(1, count, dtype=U64) << shift if count > 1 else np.zeros(0, U64)
    return np.r_[0, np.searchsorted(sorted_keys, edges), len(sorted_keys)]


def range_count(entries: int, per_range: int, least: int) -> int:
    """A power of two, so that a range holds about ``per_range`` entries."""
    n = 8
    while n < least or n * per_range < entries:
        n *= 2
    return n


def local_path(uri: str) -> str | None:
    """The mounted path of a folder that is a file system of this machine, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def save(folder: str, name: str, write: Callable[[object], None]) -> None:
    """Writes a file of the shared folder under a name of its own, then renames it.

    A task that runs twice leaves the same file, and a reader sees whole files only.
    """
    own = f".{name}-{uuid.uuid4().hex[:8]}"
    if path := local_path(folder):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{own}", "wb") as out:
            write(out)
        os.replace(f"{path}/{own}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{own}") as out:
        write(out)
    store.move(f"{path}/{own}", f"{path}/{name}")


def sizes_of(rows: list, parts: int) -> np.ndarray:
    """Entries of each range from rows (part, n); ranges that nothing was sent to have none."""
    sizes = np.zeros(parts, np.int64)
    for r in rows:
        sizes[r["part"]] = r["n"]
    return sizes


def find_unsorted(table: SortedHashes, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """As ``table.find`` for keys in any order."""
    order = np.argsort(keys)
    there, values = table.find(keys[order])
    back = np.empty(len(keys), np.int64)
    back[order] = np.arange(len(keys))
    return there[back], {n: v[back] for n, v in values.items()}


@contextmanager
def no_cycles():
    """Stays the search for reference cycles while many small objects without any are made."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@contextmanager
def opened(folder: str, name: str) -> Iterator[str]:
    """A local path for a file of the shared folder, to be memory-mapped before the block ends.

    On a mounted folder that is the file itself; from another store it is fetched into a file that
    loses its name with the block, so its room is free again when the map is gone.
    """
    if path := local_path(folder):
        yield f"{path}/{name}"
        return
    import shutil
    import tempfile

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as source, tempfile.NamedTemporaryFile() as target:
        shutil.copyfileobj(source, target)
        target.flush()
        yield target.name


class Narrow:
    """Unsigned integers of a mapped file in one byte each; those of 255 and more are listed with their places."""

    def __init__(self, low: np.ndarray, more: np.ndarray):
        self.low, (self.places, self.values) = low, more

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, at) -> np.ndarray:
        got = np.asarray(self.low[at]).astype(U64)
        if len(big := np.flatnonzero(got == 255)):
            places = np.arange(*at.indices(len(self.low))) if isinstance(at, slice) else at
            got[big] = self.values[np.searchsorted(self.places, places[big].astype(U64))]
        return got

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self[:] if dtype is None else self[:].astype(dtype)


class Coded:
    """Numbers of a mapped file as places in a list of the few distinct ones."""

    def __init__(self, codes: np.ndarray, table: np.ndarray):
        self.codes, self.table = codes, table

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, at) -> np.ndarray:
        return self.table[self.codes[at]]


class Packed:
    """Distinct sorted keys of a mapped file: the first of every 16, and 32-bit distances from it."""

    def __init__(self, steps: np.ndarray, heads: np.ndarray):
        self.steps, self.shift, self.heads = steps, heads[0], heads[1:]

    @staticmethod
    def of(keys: np.ndarray) -> list[np.ndarray] | None:
        """The arrays of the file, unless the keys lie too far apart."""
        bits = int(np.bitwise_or.reduce(keys)) if len(keys) else 0
        shift, heads = U64((bits & -bits).bit_length() - 1 if bits else 0), keys[::16]
        steps = (keys - np.repeat(heads, 16)[: len(keys)]) >> shift
        return [steps.astype(np.uint32), np.r_[shift, heads]] if steps.max(initial=0) < 1 << 32 else None

    def __len__(self) -> int:
        return len(self.steps)

    def __getitem__(self, at) -> np.ndarray:
        places = np.arange(*at.indices(len(self.steps))) if isinstance(at, slice) else at
        return self.heads[places >> 4] + (self.steps[at].astype(U64) << self.shift)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self[:] if dtype is None else self[:].astype(dtype)

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = np.searchsorted(self.heads, keys, "right") - 1
        off = keys - self.heads[np.maximum(block, 0)]
        step = off >> self.shift
        ok = (block >= 0) & (step < 1 << 32) & (step << self.shift == off)
        at, hit = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        own = np.flatnonzero(ok)
        base, step = block[own] * 16, step[own].astype(np.uint32)
        low, high = base, np.minimum(base + 15, len(self.steps) - 1)
        for _ in range(4):  # the last place whose step is not larger
            middle = (low + high + 1) >> 1
            up = self.steps[middle] <= step
            low, high = np.where(up, middle, low), np.where(up, high, middle - 1)
        at[own], hit[own] = low, self.steps[low] == step
        return at, hit


def search(column, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in a column of sorted keys that is not empty, and whether they are there."""
    if isinstance(column, Packed):
        return column.search(keys)
    at = np.searchsorted(column, keys)
    at[at == len(column)] = 0
    return at, column[at] == keys


class SortedHashes:
    """Sorted keys with columns of values, one file for each range of the keys, memory-mapped.

    ``sizes`` is the number of keys in each range, as the job that wrote them has counted. A range
    without keys has no file; a file that is missing or of another length is an error, never an
    empty range. With ``ranked``, the number of smaller keys in all ranges is a value too.
    """

    def __init__(self, folder: str, sizes: np.ndarray, columns: dict[str, str], ranked: bool = False):
        self.folder, self.sizes, self.count, self.columns = folder, sizes, len(sizes), columns
        self.offsets = np.cumsum(sizes) - sizes if ranked else None
        self.parts: dict[int, dict[str, np.ndarray]] = {}

    @staticmethod
    def write(folder: str, part: int, arrays: dict[str, np.ndarray], dense: bool = False) -> None:
        """Columns of mostly small integers are written as Narrow, floats of few distinct values as Coded, ``dense`` keys as Packed."""
        for name, values in arrays.items():
            both = [values]
            if name != "key" and values.dtype == U64 and 16 * len(big := np.flatnonzero(values >= 255)) <= len(values):
                both = [np.minimum(values, 255).astype(np.uint8), np.stack([big.astype(U64), values[big]])]
            elif name == "key" and dense:
                both = Packed.of(values) or both
            elif values.dtype == np.float32:
                table, codes = np.unique(values, return_inverse=True)
                both = [codes.astype(np.uint16), table] if len(table) <= 1 << 16 else both
            save(folder, f"{name}-{part:06d}", lambda out, both=both: [np.lib.format.write_array(out, np.ascontiguousarray(v)) for v in both])

    def part(self, i: int) -> dict[str, np.ndarray]:
        if i not in self.parts:
            got = {}
            for name, kind in self.columns.items():
                if not self.sizes[i]:
                    got[name] = np.zeros(0, kind)
                    continue
                with opened(self.folder, f"{name}-{i:06d}") as path:
                    got[name] = np.load(path, mmap_mode="r")
                    if form := {np.uint8: Narrow, np.uint16: Coded, np.uint32: Packed}.get(got[name].dtype.type):
                        with open(path, "rb") as f:
                            f.seek(got[name].offset + got[name].nbytes)
                            got[name] = form(got[name], np.load(f))
                if len(got[name]) != self.sizes[i]:
                    raise ValueError(f"{name}-{i:06d} of {self.folder} has {len(got[name])} entries, not {self.sizes[i]}")
            self.parts[i] = got
        return self.parts[i]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For sorted ``keys``: which are there, and their values (0 elsewhere)."""
        there = np.zeros(len(keys), bool)
        values = {n: np.zeros(len(keys), k) for n, k in self.columns.items() if n != "key"}
        if self.offsets is not None:
            values["rank"] = np.zeros(len(keys), np.int64)
        cuts = ranges(keys, self.count)
        for i in np.flatnonzero(np.diff(cuts)):
            s, e = cuts[i], cuts[i + 1]
            part = self.part(int(i))
            if not len(part["key"]):
                continue
            at, hit = search(part["key"], keys[s:e])
            there[s:e] = hit
            for n in values:
                got = at + self.offsets[i] if n == "rank" else part[n][at]
                values[n][s:e] = np.where(hit, got, 0)
        return there, values
