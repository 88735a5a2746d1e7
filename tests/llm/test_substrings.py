"""Substring dedup against every window of every document."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from llm_fixtures import edge, edge_rows, empty  # noqa: F401
from proxima.llm import chunks as C
from proxima.llm import substrings as S
from proxima.llm.substrings import WINDOW, remove_repeats, substring_report

LAST = 2**63 - 1


def brute(rows):
    first = {}
    words = [(LAST if i is None else i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in words:
        for k in range(len(w) - WINDOW + 1):
            key = b" ".join(w[k: k + WINDOW])
            first[key] = min(first.get(key, LAST), i)
    out = []
    for i, w in words:
        gone = bytearray(len(w))
        for k in range(len(w) - WINDOW + 1):
            if first[b" ".join(w[k: k + WINDOW])] < i:
                gone[k: k + WINDOW] = b"\1" * WINDOW
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_matches_brute_force(edge):
    got = sorted((LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                 for r in substring_report(edge).collect())
    assert got == brute(edge_rows())
    assert sum(r[2] for r in got) > 500


def test_columns_travel_along(edge):
    out = remove_repeats(edge)
    assert out.select("row.*").columns == edge.columns
    texts = {(r.row.doc_id, r.row.text, r.row.chunk) for r in out.collect()}
    assert texts == {(r.doc_id, r.text, "clash") for r in edge.collect()}


def test_empty_table(empty):
    assert substring_report(empty).collect() == []


def test_only_aligned_blocks_are_indexed(spark, edge):
    """The index holds one entry per distinct aligned block, a 25th of the probes; a range without blocks answers nothing."""
    chunks = C.packed(edge.select("doc_id", "text"), "text", "test-chunks")
    sent = chunks.select("chunk", "blob").mapInArrow(S._send_probes(4, 1, 0), "bucket int, chunk bigint, keys binary, blocks binary").collect()
    blocks = {}
    for row in chunks.collect():
        part = C.thaw(row.blob)
        for t in part.column(1).to_pylist():
            w = (t or "").encode().split()
            blocks.setdefault(row.chunk, set()).update(b" ".join(w[k: k + 25]) for k in range(0, len(w) - 24, 25))
    indexed = {}
    for r in sent:
        indexed[r.chunk] = indexed.get(r.chunk, 0) + len(r.blocks) // 8
    assert indexed == {k: len(v) for k, v in blocks.items() if v}
    assert sum(len(r.keys) // 4 for r in sent) > 20 * sum(indexed.values())
    import pyarrow as pa
    keys = np.arange(50, dtype=np.uint32) << 2 | 2                   # probes in many documents, no block
    tbl = pa.table({"chunk": [1, 2], "keys": [keys.tobytes()] * 2, "blocks": [b"", b""]})
    answer = S._meet_probes((pa.scalar(3),), tbl).to_pydict()
    assert not any(map(any, answer["mask"])) and answer["least"] == [b"", b""]


def test_equal_hashes_of_different_words_remove_nothing(monkeypatch):
    """Windows are told apart by all 128 bits."""
    keys = (np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    (a, b), least, group = S._least_by_key(keys, np.array([7, 3, 4, 8]))
    assert (a.tolist(), b.tolist(), least.tolist(), group.tolist()) == ([5, 5, 9], [1, 2, 1], [4, 3, 8], [0, 1, 0, 2])


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_words(spark, monkeypatch, seed):
    """Periodic and overlapping repeats at all offsets, over many small chunks."""
    monkeypatch.setattr(C, "CHUNK_BYTES", 2000)
    rng = random.Random(seed)
    passages = [[rng.choice("abcdef") for _ in range(rng.randrange(40, 130))] for _ in range(5)]
    rows = []
    for i in rng.sample(range(1000), 60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            w += p[a: a + rng.randrange(30, 110)] if rng.random() < 0.8 else ["x"] * rng.randrange(20, 90)
            w += [rng.choice("uvwxyz") for _ in range(rng.randrange(0, 9))]
        rows.append((i, " ".join(w)))
    got = substring_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)
