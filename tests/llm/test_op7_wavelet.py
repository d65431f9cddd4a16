import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from sievewright.llm import byte_bpe, wavelet
from sievewright.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    """Rows (doc_id, text) in order of id, then in the order given."""
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def by_hash(docs):
    """Ids and texts of all rows, by the hash that orders rows of equal ids."""
    t = F.coalesce("text", F.lit(""))
    return [(r.doc_id, r.text) for r in docs.orderBy(F.xxhash64(t), t).collect()]


def run(spark, docs):
    folder, shards = wavelet.write_token_shards(spark, docs)
    got = wavelet.read_token_shards(spark, folder, shards).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got), key=lambda r: r[1])


def test_query_against_brute_force(spark, sf, monkeypatch):
    docs = read(spark, sf, "documents")
    monkeypatch.setattr(wavelet, "TASK_BYTES", 100_000)
    assert run(spark, docs) == brute(by_hash(docs))


def test_edge_cases(spark):
    texts = ["", None, " ", "a  b", "a\n\nb", " lead", "trail ", "tab\tx", "<|endoftext|> y", "x y z", "n\0ul", "it's we'll 12 'd", "ünï čödé 漢字 🙂", "w " * 70_000]
    rows = [(i % 9 or None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    assert run(spark, docs) == brute(by_hash(docs))
    assert run(spark, docs.limit(0)) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1.,'\n \tsé漢", max_size=40))
def test_pieces_encode_as_the_whole(text):
    encoder = test_pieces_encode_as_the_whole.__dict__.setdefault("encoder", byte_bpe.Encoder(PATH))
    ids, n = encoder.encode([text, "x", text])
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids[: n[0]].tolist() == whole == ids[len(ids) - n[2] :].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.booleans())
def test_access_count_and_locate(tokens, few):
    ids = np.array([t % 5 for t in tokens] if few else tokens, np.uint32)
    old, wavelet.BLOCK = wavelet.BLOCK, 8
    try:
        m = wavelet.WaveletMatrix(wavelet.dump(ids, np.array([4]), np.array([len(ids)])))
    finally:
        wavelet.BLOCK = old
    assert m.tokens().tolist() == ids.tolist() == m.access(np.arange(len(ids))).tolist() == m.document(0).tolist()
    for token in {*ids.tolist()[:5], 3, 1 << 20}:
        assert m.count(token) == (ids == token).sum()
        assert m.locate(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert m.count(token, len(ids) // 3, len(ids) // 2) == (ids[len(ids) // 3 : len(ids) // 2] == token).sum()


def test_rejects_other_files():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"something else" * 10)


def test_chunks_of_any_size(spark, sf, monkeypatch):
    texts = [r.text for r in read(spark, sf, "documents").collect()]
    encoder = byte_bpe.Encoder(PATH)
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 5_000, 1 << 20):
        monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", size)
        ids, n = encoder.encode(texts)
        assert n.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]


def test_every_character_keeps_its_class():
    encoder = byte_bpe.Encoder(PATH)
    chars = [chr(c) for c in range(0x3100) if c < 0xD800] + list("\uac00\uffe5\U0001f600\U00010400\ufeff")
    for make in ("a{}1 b{}", "{} {}x\n{}a  {}", "1{}!{} ", ".{}\u00a0 {}\u3000\n"):
        texts = [make.replace("{}", c) for c in chars]
        ids, n = encoder.encode(texts)
        whole = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [t for t, k, w in zip(texts, np.split(ids, np.cumsum(n)), whole) if k.tolist() != w] == []


def test_one_hot_id_and_null_ids_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "TASK_BYTES", 20_000)
    docs = spark.createDataFrame([(7 if k % 3 else None, f"text number {k} " * 9) for k in range(900)], "doc_id long, text string")
    folder, shards = wavelet.write_token_shards(spark, docs)
    assert shards.count() > 4 and max(r.n_docs for r in shards.collect()) < 450
    assert run(spark, docs) == brute(by_hash(docs))
