"""Token ids of all documents as wavelet matrices, one compressed file a shard.

A shard holds the ids of consecutive documents in ascending order of their ids. The matrix has
one bit-plane for each bit of the largest token id, highest first; after each plane the sequence
is parted stably into zeros and ones. Planes are cut into blocks, each compressed by itself with
the number of ones before it in the header, so that access, counting and lookup of occurrences
decompress the blocks they touch and nothing else.

Layout, little-endian: magic, lengths (tokens, documents, planes, block bytes), ids and ends of
the documents, zeros of each plane, ones before each block, end of each block's bytes, blocks.

Defined results: a null or empty text is the end token alone; rows with equal ids are ordered by
a hash of their texts, then by the texts, null ids come first; a text of any length is encoded
whole, by itself if it is longer than a chunk; an empty table gives no shard; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder_of
from .common import cut, shared_folder, text_of
from .wordhash import opened, save

MAGIC = b"SWWM0001"
BLOCK = 1 << 15
#: Tokens of a shard, after which a task begins another, and bytes of text a task is meant to have.
SHARD_TOKENS = 4_000_000
TASK_BYTES = 32 << 20
#: Tasks of a job at most; on larger inputs each task has more text and writes more shards.
MOST_TASKS = 20_000
NULL_ID = np.iinfo(np.int64).min


def dump(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of a shard: token ids of all its documents, their ids and their ends among the tokens."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    n, planes = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    zeros, ones_before, block_ends, blocks, size = [], [], [], [], 0
    for p in range(planes - 1, -1, -1):
        one = (ids & ids.dtype.type(1 << p)).astype(bool)
        packed = np.packbits(one, bitorder="little")
        ids = np.concatenate([ids[~one], ids[one]])
        zeros.append(n - int(one.sum()))
        count = 0
        for at in range(0, len(packed), BLOCK):
            block = packed[at : at + BLOCK]
            ones_before.append(count)
            count += int(np.bitwise_count(block).sum())
            blocks.append(press.compress(block.tobytes()))
            size += len(blocks[-1])
            block_ends.append(size)
    head = [np.array(x, "<i8").tobytes() for x in ([n, len(doc_ids), planes, BLOCK], doc_ids, ends, zeros, ones_before, block_ends)]
    return b"".join([MAGIC, *head, *blocks])


class WaveletMatrix:
    """One shard, read from a buffer or a memory-mapped file."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.n, docs, self.planes, self.block = np.frombuffer(self.data[8:40], "<i8").tolist()
        self.per_plane = -(-(-(-self.n // 8)) // self.block)
        at, parts = 40, []
        for size in (docs, docs, self.planes, self.planes * self.per_plane, self.planes * self.per_plane):
            parts.append(np.frombuffer(self.data[at : at + 8 * size], "<i8"))
            at += 8 * size
        self.doc_ids, self.ends, self.zeros, self.ones_before, self.block_ends = parts
        self.body = at
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        import mmap

        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _bytes(self, k: int) -> np.ndarray:
        import zstandard

        start = self.body + (int(self.block_ends[k - 1]) if k else 0)
        raw = zstandard.ZstdDecompressor().decompress(self.data[start : self.body + int(self.block_ends[k])], max_output_size=self.block)
        return np.frombuffer(raw, np.uint8)

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes and the ones before each of them in its plane; the last 64 used are kept."""
        if k not in self._held:
            if len(self._held) >= 64:
                self._held.pop(next(iter(self._held)))
            data = self._bytes(k)
            before = np.cumsum(np.r_[self.ones_before[k], np.bitwise_count(data[:-1])])
            self._held[k] = data, before
        return self._held[k]

    def _bit_and_rank(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits at the places, and ones before them; the place n is allowed and has bit 0."""
        bits, ones = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        end = at == self.n
        ones[end] = self.n - self.zeros[plane]
        which = (at // 8) // self.block
        which[end] = -1
        for b in np.unique(which[~end]):
            on = which == b
            data, before = self._block(plane * self.per_plane + int(b))
            byte, bit = (at[on] // 8) - int(b) * self.block, at[on] % 8
            bits[on] = data[byte] >> bit & 1
            ones[on] = before[byte] + np.bitwise_count(data[byte] & ((1 << bit) - 1).astype(np.uint8))
        return bits, ones

    def access(self, at) -> np.ndarray:
        """Tokens at the given places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for p in range(self.planes):
            bits, ones = self._bit_and_rank(p, at)
            out = out << 1 | bits
            at = np.where(bits == 1, self.zeros[p] + ones, at - ones)
        return out

    def _span(self, token: int, start: int, end: int) -> tuple[int, int]:
        at = np.array([start, end], np.int64)
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            _, ones = self._bit_and_rank(p, at)
            at = self.zeros[p] + ones if token >> (self.planes - 1 - p) & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token among the places from ``start`` to ``end``."""
        a, b = self._span(token, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Places of a token's occurrences, ascending: each is selected upward through the planes."""
        a, b = self._span(token, start, self.n if end is None else end)
        at = np.arange(a, b)
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            at = self._select(p, at - self.zeros[p] if one else at, one)
        return at

    def _select(self, plane: int, k: np.ndarray, one: int) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros of a plane."""
        first = self.ones_before[plane * self.per_plane : (plane + 1) * self.per_plane]
        before = first if one else np.arange(self.per_plane) * self.block * 8 - first
        which = np.searchsorted(before, k, "right") - 1
        out = np.zeros(len(k), np.int64)
        for b in np.unique(which):
            on = which == b
            data, _ = self._block(plane * self.per_plane + int(b))
            places = np.flatnonzero(np.unpackbits(data, bitorder="little") == one)
            out[on] = int(b) * self.block * 8 + places[k[on] - before[b]]
        return out

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the partings from the last plane to the first."""
        out = np.zeros(self.n, np.uint32 if self.planes > 16 else np.uint16)
        for p in range(self.planes - 1, -1, -1):
            blocks = [self._bytes(k) for k in range(p * self.per_plane, (p + 1) * self.per_plane)]
            one = np.unpackbits(np.concatenate([np.zeros(0, np.uint8), *blocks]), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(out)
            up[~one] = out[: self.zeros[p]]
            up[one] = out[self.zeros[p] :] | out.dtype.type(1 << (self.planes - 1 - p))
            out = up
        return out

    def document(self, k: int) -> np.ndarray:
        """Tokens of the k-th document of the shard."""
        return self.access(np.arange(self.ends[k - 1] if k else 0, self.ends[k]))


def write_shards(folder: str, tokenizer: str | None, end_id: int):
    """For mapInArrow over sorted (doc_id, text): writes shards, returns one row for each."""

    def run(batches):
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encoder, part = encoder_of(path), TaskContext.get().partitionId()
        held, docs, counts, size, made = [], [], [], 0, 0

        def shard():
            ends = np.cumsum(np.concatenate(counts))
            ids = np.concatenate(held)
            name = f"tokens-{part:06d}-{made:05d}"
            blob = dump(ids, np.concatenate(docs), ends)
            save(folder, name, lambda out: out.write(blob))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([made]), pa.array([name]), pa.array([len(ends)]), pa.array([len(ids)])], ["part", "seq", "name", "n_docs", "n_ids"])

        for batch in batches:
            owners = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for rows, ids, n in encoder.parts(batch.column(1)):
                ids = ids.astype(np.uint16 if max(end_id, int(ids.max(initial=0))) < 1 << 16 else np.uint32)
                held.append(np.insert(ids, np.cumsum(n), end_id))
                docs.append(owners[rows])
                counts.append(n + 1)
                size += len(held[-1])
                if size >= SHARD_TOKENS:
                    yield shard()
                    held, docs, counts, size, made = [], [], [], 0, made + 1
        if held:
            yield shard()

    return run


def write_token_shards(
    spark: SparkSession, docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[str, DataFrame]:
    """Writes the shards; returns their folder and a table of them (name, n_docs, n_ids, start).

    Texts are dealt by range of (id, hash of the text), so rows of one id or of null id spread over tasks too.
    The table stays in the shared folder; the tokens before a shard are summed first within blocks of parts,
    then over the blocks.
    """
    folder = folder or shared_folder(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    volume = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    tasks = max(1, min(-(-volume // TASK_BYTES), MOST_TASKS))
    dealt = rows.repartitionByRange(tasks, "doc_id", "h").sortWithinPartitions("doc_id", "h", "t").select("doc_id", "t")
    made = cut(spark, dealt.mapInArrow(write_shards(folder, tokenizer, end_id), "part long, seq long, name string, n_docs long, n_ids long"), "shards")
    block = F.floor(F.col("part") / 512)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = made.groupBy(block.alias("block")).agg(F.sum("n_ids").alias("ids")).select("block", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("block", block).join(blocks, "block").withColumn("start", F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return folder, placed.select("name", "n_docs", "n_ids", "start")


def read_documents(folder: str):
    """For mapInArrow over (name, start): rows (doc_id, start, n_tokens, ids) from the files."""

    def run(batches):
        for batch in batches:
            for name, start in zip(*(batch.column(i).to_pylist() for i in range(2))):
                with opened(folder, name) as path:
                    shard = WaveletMatrix.open(path)
                ids = shard.tokens().astype("<u4")
                begin = np.r_[0, shard.ends[:-1]]
                for at in range(0, len(begin), 2048):
                    s, e = begin[at : at + 2048], shard.ends[at : at + 2048]
                    blobs = pa.array([ids[a:b].tobytes() for a, b in zip(s, e)], pa.binary())
                    own = shard.doc_ids[at : at + 2048]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(start + s), pa.array(e - s), blobs], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_token_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all documents; ids as little-endian 32-bit integers."""
    count = shards.count()
    names = shards.select("name", "start").repartition(max(1, min(count, MOST_TASKS)), "name")
    return names.mapInArrow(read_documents(folder), "doc_id long, start long, n_tokens long, ids binary")
