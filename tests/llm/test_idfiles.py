"""Bit-packed id files against the tokenizers library and against their own layout."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import edge, empty  # noqa: F401
from proxima.llm import idfiles as I
from proxima.llm.common import tokenizer_path
from proxima.session import scratch_path

PATH = tokenizer_path("word_bpe_49k.json")


def library(texts):
    tk = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("width", [1, 5, 8, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_bits_round_trip(width, n):
    x = np.random.default_rng(n).integers(0, 1 << width, n).astype(np.uint32)
    words = I.pack_bits(x, width)
    assert len(words) == -(-n // 64) * width
    assert (I.unpack_bits(words, width, n) == x).all()


def test_an_id_too_large_raises():
    with pytest.raises(ValueError):
        I.pack_bits(np.array([1 << 16], np.uint32), 16)


def test_bits_of_a_vocabulary():
    assert [I.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_runs_and_documents_of_a_file():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 60)
    ids = rng.integers(0, 49408, lengths.sum()).astype(np.uint32)
    blob = I.shard_bytes(np.arange(60), np.zeros(60, bool), lengths, ids, 17, (3, 4)) + b"\n"
    shard = I.Shard.open(blob)
    assert shard.place == (3, 4) and len(shard.offsets) == -(-len(ids) // I.BLOCK_IDS) + 1
    ends = np.cumsum(lengths)
    for i in range(60):
        assert (shard.document(i) == ids[ends[i] - lengths[i]: ends[i]]).all()
    for a, b in ((0, len(ids)), (4095, 4097), (8192, 8193), (len(ids) - 1, len(ids)), (7, 7)):
        assert (shard.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        I.Shard.open(blob[:-9])
    with pytest.raises(ValueError):
        I.Shard.open(b"something" * 20)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\xa0  ’'sŚİßÅ<|>09aZé漢\U0001f600\x00"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_words_encode_as_the_library_does(texts):
    texts = texts + ["Don't <|endoftext|> we'LL", "<|startoftext|>x", " ".join(texts)]
    for whole in (False, True):
        ids, n = I.encoded_block(pa.array(texts), PATH, 1, whole)
        assert [a.tolist() for a in np.split(ids, np.cumsum(n)[:-1])] == library(texts)


@pytest.mark.parametrize("shard_ids", [1 << 22, 500])
def test_files_hold_the_table_in_order(spark, edge, monkeypatch, shard_ids):
    monkeypatch.setattr(I, "SHARD_IDS", shard_ids)
    monkeypatch.setattr(I, "TEXT_BYTES", 1 << 12)
    got = I.id_file_report(edge, PATH).collect()
    rows = edge.select("doc_id", "text").collect()
    want = {}
    for r, ids in zip(rows, library([r.text for r in rows])):
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    got = sorted(got, key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())


def test_all_rows_equal(spark):
    docs = spark.createDataFrame([(7, "same text here")] * 300, "doc_id bigint, text string").repartition(5)
    got = I.id_file_report(docs, PATH).collect()
    n = got[0].n_tokens
    assert sorted(r.start for r in got) == [n * i for i in range(300)]


def test_empty_table(spark, empty):
    assert I.id_file_report(empty, PATH).collect() == []


def test_a_rerun_does_not_overwrite(spark, edge):
    path = I.write_id_files(edge, PATH, scratch_path(spark, "ids"))
    assert I.read_id_files(spark, path).count() == edge.count()
    with pytest.raises(Exception):
        I.write_id_files(edge, PATH, path)
