"""SentencePiece encoding and decoding with the N best segmentations.

Spaces become U+2581, one is put in front, and every piece of the model with a weight is an edge
of the text's lattice; a character that no piece covers falls back to its bytes at a penalty.
Forward Viterbi gives, for each place, the best score from the start. The N best paths are found
by A-star from the end back to the start: a hypothesis is ranked by its own score plus the forward
score of its place, which is exactly the best that can still come, so paths leave the queue in
order and nothing is pruned.

No piece crosses from a character to a following U+2581, nor holds a line break, so the lattice
of a text is a chain of lattices of its units. Each distinct unit is solved once a worker (best
path and loss of its second best); the N best of a text replace at most N - 1 units, those of
least loss, and only these are searched for further paths.

Defined results: null and empty texts have no ids, score 0 and one (empty) segmentation; a text of
any length is segmented whole; ties of scores (to six digits) may leave in any order; an empty table
gives no rows; texts
that contain U+2581 decode to a space there, as in the library; repeated rows are encoded one by
one; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Pieces:
    """The vocabulary of a model file: weights by piece, and what each id decodes to."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        plain = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
                self.ids[piece] = i, model.get_score(i)
                if piece.strip(SPACE) or len(piece) == 1:
                    plain.append(model.get_score(i))
        best = max(plain)
        for piece, (i, _) in list(self.ids.items()):  # runs of spaces are taken whole, as the library does
            if len(piece) > 1 and not piece.strip(SPACE):
                self.ids[piece] = i, len(piece) * best - 0.1
        self.unknown = min(plain) - UNKNOWN_PENALTY
        self.longest: dict[str, int] = {}
        for piece in self.ids:
            self.longest[piece[0]] = max(len(piece), self.longest.get(piece[0], 0))

    def edges(self, unit: str, start: int) -> list[tuple[int, tuple[int, ...], float]]:
        """Pieces that begin at ``start``: end, ids, score."""
        found = []
        for end in range(start + 1, min(len(unit), start + self.longest.get(unit[start], 0)) + 1):
            if (hit := self.ids.get(unit[start:end])) is not None:
                found.append((end, (hit[0],), hit[1]))
        if not found or found[0][0] != start + 1:
            found.append((start + 1, tuple(self.byte_ids[b] for b in unit[start].encode("utf-8", "surrogatepass")), self.unknown))
        return found

    def best(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best path, and the loss of the second best (infinite where there is none)."""
        n = len(unit)
        low = -np.inf
        first, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        first[0] = 0.0
        for start in range(n):
            a, b = first[start], second[start]
            for end, ids, score in self.edges(unit, start):
                s = a + score
                if s > first[end]:
                    second[end] = max(first[end], b + score)
                    first[end], back[end] = s, (start, ids)
                else:
                    second[end] = max(second[end], s)
        path, at = [], n
        while at:
            at, ids = back[at]
            path.append(ids)
        return tuple(i for ids in reversed(path) for i in ids), first[n], first[n] - second[n]

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best paths in order, by backward A-star over the forward scores."""
        size = len(unit)
        forward = [-np.inf] * (size + 1)
        forward[0] = 0.0
        into: list[list] = [[] for _ in range(size + 1)]
        for start in range(size):
            for end, ids, score in self.edges(unit, start):
                into[end].append((start, ids, score))
                forward[end] = max(forward[end], forward[start] + score)
        tick, found = count(), []
        # among equal ranks the hypothesis nearest to the start goes first, so that ties do not fan out
        queue = [(round(-forward[size], 6), size, next(tick), 0.0, None)]
        while queue and len(found) < n:
            _, at, _, score, chain = heapq.heappop(queue)
            if not at:
                ids = []
                while chain:
                    own, chain = chain
                    ids += own
                found.append((score, tuple(ids)))
                continue
            for start, ids, own in into[at]:
                total = score + own
                heapq.heappush(queue, (round(-(total + forward[start]), 6), start, next(tick), total, (ids, chain)))
        return found

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Solver:
    """Best paths of many units at once: units of one length are the rows of a matrix of characters.

    Substrings of all lengths are hashed by columns and looked up among the pieces of that length,
    and the recurrence over places runs on whole columns, keeping the two best scores.
    """

    LONGEST = 48
    _RADIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        by_size: dict[int, list[tuple[int, int, float]]] = {}
        for piece, (i, score) in pieces.ids.items():
            h = 0
            for c in piece:
                h = (h * int(self._RADIX) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            by_size.setdefault(len(piece), []).append((h, i, score))
        self.tables = {}
        for size, rows in by_size.items():
            rows.sort()
            self.tables[size] = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int32, np.float64)))
        self.slots = np.zeros(1 << 20, bool)  # most substrings are no piece, and are told so by one look
        for hashes, _, _ in self.tables.values():
            self.slots[self._slot(hashes)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * self._RADIX >> np.uint64(44)).astype(np.int64)

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all best paths in a row, the number of each, scores, losses of the second best."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        lengths, scores, losses = np.zeros(len(units), np.int32), np.zeros(len(units)), np.zeros(len(units))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alone = list(np.flatnonzero(sizes > self.LONGEST))
        for n in np.unique(sizes[sizes <= self.LONGEST]).tolist():
            chosen = np.flatnonzero(sizes == n)
            for at in range(0, len(chosen), 20_000):
                rows = chosen[at : at + 20_000]
                chars = np.array([units[i] for i in rows], f"U{n}").view(np.uint32).reshape(len(rows), n).astype(np.uint64)
                ok, ids, count, first, loss = self._best(np.ascontiguousarray(chars.T))
                alone += rows[~ok].tolist()
                count[~ok] = 0
                lengths[rows], scores[rows], losses[rows] = count, first, loss
                found.append((rows, count, ids[np.arange(n) < count[:, None]]))
        for i in alone:
            path, scores[i], losses[i] = self.pieces.best(units[i])
            lengths[i] = len(path)
            found.append((np.array([i]), np.array([len(path)]), np.array(path, np.int32)))
        ends = np.cumsum(lengths, dtype=np.int64)
        flat = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        for rows, own, ids in found:
            within = np.arange(len(ids)) - np.repeat(np.cumsum(own) - own, own)
            flat[np.repeat(ends[rows] - lengths[rows], own) + within] = ids
        return flat, lengths, scores, losses

    def _best(self, chars: np.ndarray):
        """For columns of units of one length: solved or not, ids, their number, score, loss."""
        n, k = chars.shape
        low = -np.inf
        first, second = np.full((n + 1, k), low), np.full((n + 1, k), low)
        first[0] = 0.0
        back, via = np.zeros((n + 1, k), np.int64), np.zeros((n + 1, k), np.int32)
        edges: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = [{} for _ in range(n + 1)]
        hashes = chars.copy()
        ok = np.ones(k, bool)
        for size in range(1, min(n, max(self.tables)) + 1):
            if size > 1:
                hashes = hashes[:-1] * self._RADIX + chars[size - 1 :]
            if (table := self.tables.get(size)) is None:
                continue
            starts, units = np.nonzero(self.slots[self._slot(hashes)])
            sought = hashes[starts, units]
            at = np.searchsorted(table[0], sought)
            at[at == len(table[0])] = 0
            hit = table[0][at] == sought
            starts, units, at = starts[hit], units[hit], at[hit]
            if size == 1:
                ok = np.bincount(units, minlength=k) == n
            cuts = np.searchsorted(starts, np.arange(len(hashes) + 1))
            for start in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[start], cuts[start + 1])
                edges[start + size][size] = units[own], table[1][at[own]], table[2][at[own]]
        for end in range(1, n + 1):
            f, s = first[end], second[end]
            for size in sorted(edges[end], reverse=True):
                some, ids, score = edges[end][size]
                one, two = first[end - size, some] + score, second[end - size, some] + score
                mine = f[some]
                s[some] = np.maximum(np.minimum(mine, one), np.maximum(s[some], two))
                better = one > mine
                take = some[better]
                f[take], back[end, take], via[end, take] = one[better], size, ids[better]
        ids, count, at = np.zeros((k, n), np.int32), np.zeros(k, np.int32), np.where(ok, n, 0)
        every = np.arange(k)
        for _ in range(n):
            live = every[at > 0]
            if not len(live):
                break
            ids[live, n - 1 - count[live]] = via[at[live], live]
            count[live] += 1
            at[live] -= back[at[live], live]
        ids = ids[every[:, None], np.minimum(np.arange(n) + (n - count)[:, None], n - 1)]
        with np.errstate(invalid="ignore"):
            return ok, ids, count, first[n], first[n] - second[n]


class Segmenter:
    """N best segmentations of whole texts; distinct units are kept until they become many."""

    KNOWN, KEPT = 200_000, 80_000
    SEARCHED = 20_000

    def __init__(self, path: str, n: int):
        self.pieces, self.n = Pieces(path), n
        self.solver = Solver(self.pieces)
        self.more: dict[str, list] = {}
        self.known: dict[str, int] = {}
        self.flat, self.size = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores, self.losses = np.zeros(0), np.zeros(0)

    def trim(self) -> None:
        """Keeps the units met first, the frequent ones among them."""
        if len(self.known) > self.KNOWN:
            self.known = dict(islice(self.known.items(), self.KEPT))
            self.starts, self.lengths = self.starts[: self.KEPT], self.lengths[: self.KEPT]
            self.scores, self.losses = self.scores[: self.KEPT], self.losses[: self.KEPT]
            self.size = int(self.starts[-1] + self.lengths[-1])

    def units(self, text: str) -> list[str]:
        return _UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, texts: list[list[str]]) -> None:
        """Solves the units of some texts that are not known yet."""
        self.trim()
        fresh = list(set().union(*texts).difference(self.known))
        if not fresh:
            return
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        flat, lengths, scores, losses = self.solver.solve(fresh)
        if self.size + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.size], np.zeros(self.size + len(flat), np.int32)])
        self.flat[self.size : self.size + len(flat)] = flat
        self.starts = np.r_[self.starts, self.size + np.cumsum(lengths) - lengths]
        self.lengths, self.scores, self.losses = np.r_[self.lengths, lengths], np.r_[self.scores, scores], np.r_[self.losses, losses]
        self.size += len(flat)

    def alternatives(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """Losses and ids of the unit's paths, best first."""
        if unit not in self.more:
            if len(self.more) > self.SEARCHED:
                self.more.clear()
            paths = self.pieces.n_best(unit, self.n)
            self.more[unit] = [(paths[0][0] - s, ids) for s, ids in paths]
        return self.more[unit]

    def segment(self, text: str) -> tuple[np.ndarray, float, list[tuple[float, dict[int, tuple[int, ...]]]], np.ndarray]:
        units = self.units(text)
        self.learn([units])
        return self.of_units(units)

    def of_units(self, units: list[str]) -> tuple[np.ndarray, float, list[tuple[float, dict[int, tuple[int, ...]]]], np.ndarray]:
        """Best ids and score; then the N best as scores with the units they replace; ends of the units' ids."""
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        score, loss = float(self.scores[at].sum()), self.losses[at]
        k = min(self.n - 1, len(units))
        near = np.argpartition(loss, k - 1)[:k] if 0 < k < len(units) else np.arange(k)
        near = [int(i) for i in near[np.argsort(loss[near], kind="stable")] if np.isfinite(loss[i])]
        lists = [self.alternatives(units[i]) for i in near]
        best, queue, seen = [], [(0.0, (0,) * len(near))], {(0,) * len(near)}
        while queue and len(best) < self.n:
            lost, chosen = heapq.heappop(queue)
            best.append((score - lost, {near[j]: lists[j][c][1] for j, c in enumerate(chosen) if c}))
            for j, c in enumerate(chosen):
                after = (*chosen[:j], c + 1, *chosen[j + 1 :])
                if c + 1 < len(lists[j]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(queue, (sum(lists[i][x][0] for i, x in enumerate(after)), after))
        return ids, score, best, ends

    @staticmethod
    def replaced(ids: np.ndarray, ends: np.ndarray, swaps: dict[int, tuple[int, ...]]) -> np.ndarray:
        """The ids of a segmentation that takes other paths through some units."""
        parts, at = [], 0
        for unit in sorted(swaps):
            parts += [ids[at : ends[unit - 1] if unit else 0], np.array(swaps[unit], np.int32)]
            at = ends[unit]
        return np.concatenate([*parts, ids[at:]])


SCHEMA = "doc_id long, ids array<int>, score double, nbest_scores array<double>, nbest_lengths array<int>, decoded string"


def segment_rows(model: str | None, n: int, paths: bool = False):
    def run(batches):
        path = model
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        segmenter = Segmenter(path, n)  # of this task alone: a worker that goes on to other stages keeps nothing
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                out, every = [[], [], [], [], []], []
                texts = [segmenter.units(text) for text in some.column(1).to_pylist()]
                segmenter.learn(texts)
                for units in texts:
                    ids, score, best, ends = segmenter.of_units(units)
                    sizes = np.diff(ends, prepend=0)
                    lengths = [len(ids) + sum(len(s) - sizes[u] for u, s in swaps.items()) for _, swaps in best]
                    for column, value in zip(out, (ids, score, [s for s, _ in best], lengths, segmenter.pieces.decode(ids.tolist()))):
                        column.append(value)
                    if paths:
                        every.append([segmenter.replaced(ids, ends, swaps).tolist() for _, swaps in best])
                kinds = (pa.list_(pa.int32()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.string())
                columns, names = [some.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "ids", "score", "nbest_scores", "nbest_lengths", "decoded"]
                if paths:
                    columns, names = [*columns, pa.array(every, pa.list_(pa.list_(pa.int32())))], [*names, "nbest_ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def segment(docs: DataFrame, n: int = 4, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", paths: bool = False) -> DataFrame:
    """Rows (doc_id, ids, score, nbest_scores, nbest_lengths, decoded): the best segmentation and the N best scores.

    With ``paths``, ``nbest_ids`` has the ids of all N, the best first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(segment_rows(model, n, paths), SCHEMA + (", nbest_ids array<array<int>>" if paths else ""))
