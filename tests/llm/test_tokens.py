"""BPE ids, decoding and token counts against the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import random
import sys

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_fixtures import edge, edge_rows, empty  # noqa: F401
from proxima.llm import bpe, counts
from proxima.llm.common import small_batches, text_blocks
from proxima.llm.counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "'re", "'ll", "'LL", "1", "23", "é", "ß", "<|endoftext|>", "!", "?!", " ", "漢字",
         "\U0001f600", "the", "don't", "_", "½", "²", "​", "é", "I'm", "''s", " 's", " '", "\r\n", "'ve", "'v", "<|", "|>", "\x00", " "]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def fuzz():
    rng = random.Random(3)
    mixed = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]
    words = ["".join(rng.choices("abcdefghijklmnop '\n.,st", k=60)) for _ in range(1500)]
    signs = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x1F00, 0x3100),
                                     rng.randrange(0x10000, 0x1FA00)])) for _ in range(30)) for _ in range(1000)]
    return mixed + words + signs + ["a" * 5000, " " * 999, "ab" * 700, ""]


def test_ids_are_the_library_s(lib):
    texts, v, got = fuzz(), bpe.vocabulary(PATH), []
    for a, b, data, off in text_blocks(pa.array(texts), 1 << 16):
        block = bpe.BlockPieces(data, off)
        found = bpe.encode_pieces(v, block.distinct)
        got += [[i for w in block.which[block.edge[k]: block.edge[k + 1]] for i in found[w]] for k in range(b - a)]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [v.decode(g).decode() for g in got] == texts


def test_borders_are_those_of_the_merges():
    v = bpe.vocabulary(PATH)
    rng = random.Random(0)
    tokens = rng.sample(sorted(v.made), 60)
    for a in tokens[:20]:
        for b in tokens:
            piece = v.bytes_of[a] + v.bytes_of[b]
            assert v.fits(a, b) == (v.encode_all([piece])[0] == [a, b])


def test_digests_of_documents(edge, lib):
    got = {(r.doc_id, r.decoded_sha256): r for r in bpe.encode_digests(edge, PATH).collect()}
    for i, t, *_ in edge_rows():
        e = lib.encode(t or "", add_special_tokens=False)
        r = got[i, hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()]
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest())


def test_round_trip_of_ids(edge):
    back = bpe.decode_documents(bpe.encode_documents(edge, PATH), PATH)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(((i, t or "") for i, t, *_ in edge_rows()), key=key)


def test_counts_are_the_library_s(edge, lib, monkeypatch):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(edge, PATH, limit=100).collect())
    want = []
    for i, t, *_ in edge_rows():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 100))
    assert got == sorted(want)


def test_empty_table(empty):
    assert token_counts(empty, PATH).collect() == []
    assert bpe.encode_digests(empty, PATH).collect() == []


def _chunk_rows(texts, bits=3):
    col = pa.array(texts, pa.string())
    chunk = counts._Chunk()
    for a, b, data, off in text_blocks(col, 400):
        chunk.add(pa.array(range(a, b), pa.int64()), data, off)
    return list(chunk.rows(0, bits))


def test_uses_sorted_in_parts_are_the_same(monkeypatch):
    rng = random.Random(3)
    texts = ["", None, *(" ".join(rng.choices(["ab", "c", "dé", "12", "!"], k=rng.randrange(60))) for _ in range(80)), "", "x" * 900]
    want = _chunk_rows(texts)
    monkeypatch.setattr(counts, "SORTED_USES", 5)
    assert _chunk_rows(texts) == want


def test_a_worker_holds_no_tokenizer_after_the_sums(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    path = PATH
    texts = ["one two one", "", None, "tres tres tres été", "one <|endoftext|> two"]
    uses, *sent = _chunk_rows(texts)
    answers = []
    for _, chunk, bucket, blob in sent:
        got = counts._count(path)((pa.scalar(bucket),), pa.table({"chunk": [chunk], "bucket": [bucket], "blob": pa.array([blob], pa.binary())}))
        answers += [{"bucket": r["bucket"], "counts": r["counts"]} for r in got.to_pylist()]
    held = sys.modules["_llm_process_cache"].__dict__["held"]
    assert ("tokenizer", path) in held and os.environ["TOKENIZERS_PARALLELISM"] == "false"
    batch = pa.RecordBatch.from_arrays([pa.array([uses[3]], pa.binary()), pa.array([answers])], names=["blob", "answers"])
    out = pa.Table.from_batches(list(counts._sum([batch])))
    tk = Tokenizer.from_file(path)
    assert out.column("n_tokens").to_pylist() == [len(tk.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert not held


def test_batches_of_text_are_small(spark):
    docs = spark.range(40).coalesce(1).selectExpr("id", "repeat('word ', 50000) as text")     # 10 MB
    small_batches(spark)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"]) for b in batches), "n bigint").collect()
    assert sum(r.n for r in sizes) >= 10_000_000 and max(r.n for r in sizes) <= 5 << 20
