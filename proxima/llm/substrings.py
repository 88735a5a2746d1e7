"""Exact repeats of 50 or more words: fixed-block anchors, rolling probes, extension to maximal runs.

Every document is a reference: its aligned blocks of 25 words (positions 0, 25, 50, ...), and nothing else, are the
index, which holds the least doc_id of each block.  Every rolling window of 25 words probes it.  A window of 50 words
always covers one whole aligned block of any document that holds it, so no repeat is missed.

1. Blocks and probes meet by hash range.  A block that some other document's window asks for is an anchor, and
   whoever asked learns its least doc_id.  Without the index no probe would find anything.
2. A hit is a probe that found an anchor of a document with a smaller doc_id.  The windows of 50 words around a hit, and those
   around an anchor in the documents that own it, are the candidates: together they run as far as the repeat can.
3. Candidates meet by hash range.  Their words are compared as 128 bits, two hashes of 25 words each, which also
   finds the smallest doc_id that holds them.  What is confirmed runs together to the maximal exact repeats.
4. Words covered by a window whose words also start in a document with a smaller doc_id go.

Only hashes move by range (a third of a probe's word, distinct within a chunk); texts move by chunk.

Rules.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Null and empty texts have no words.  Rows with
the same doc_id never remove each other's words; a null doc_id counts as larger than all others.
Windows are judged on the input, not on what is left.  Extra columns travel along unchanged.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proxima.llm import chunks as C
from proxima.llm.common import U64, grams, mix, text_blocks, text_buffers, words, written

WINDOW = 50
BLOCK = (WINDOW + 1) // 2            # largest block that every window covers whole
FP_BITS = 30
NO_ID = np.iinfo(np.int64).max


def _chunk_words(col: pa.Array):
    """Word hashes of a whole chunk and the row of each word."""
    hs, docs = [np.empty(0, U64)], [np.empty(0, np.int64)]
    for a, _, data, off in text_blocks(col):
        h, d, _, _ = words(data, off)
        hs.append(h)
        docs.append(d + a)
    return np.concatenate(hs), np.concatenate(docs)


class _Probes:
    """The rolling windows of a chunk, their distinct keys in key order, and where each is used."""

    def __init__(self, col: pa.Array, bits: int):
        self.h, self.doc = _chunk_words(col)
        self.g = grams(self.h, BLOCK)
        n = len(self.g)
        self.whole = self.doc[:n] == self.doc[BLOCK - 1:][:n] if n else np.empty(0, bool)
        at = np.flatnonzero(self.whole)
        # the key keeps the bucket bits on top of a 30-bit fingerprint
        key = ((self.g[at] >> U64(64 - bits)) << U64(FP_BITS)) | (self.g[at] & U64((1 << FP_BITS) - 1))
        order = np.argsort(key, kind="stable")
        sk = key[order]
        new = np.ones(len(sk), bool)
        new[1:] = sk[1:] != sk[:-1]
        self.starts = np.flatnonzero(new)
        self.keys = sk[self.starts]
        self.at, self.order = at, order
        self.group = np.cumsum(new) - 1

    def flags(self, ids: np.ndarray):
        """Per distinct key: in two documents of this chunk, an aligned block of one, and the least id of those."""
        if not len(self.keys):
            return np.empty(0, bool), np.empty(0, bool), np.empty(0, np.int64)
        pos = self.at[self.order]
        d = self.doc[pos]
        lo, hi = np.minimum.reduceat(d, self.starts), np.maximum.reduceat(d, self.starts)
        block = self.aligned()[pos]
        least = np.minimum.reduceat(np.where(block, ids[d], NO_ID), self.starts)
        return lo != hi, np.logical_or.reduceat(block, self.starts), least

    def aligned(self) -> np.ndarray:
        """Whether a word is the first of an aligned block of its document."""
        head = np.searchsorted(self.doc, self.doc)                 # first word of the document
        return (np.arange(len(self.doc)) - head) % BLOCK == 0

    def candidates(self, anchor: np.ndarray, least: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """First words of the windows around hits, and around the anchors that the documents own."""
        n, span = len(self.g), WINDOW - BLOCK + 1
        if n < span:
            return np.empty(0, np.int64)
        pos = self.at[self.order]
        found, near = np.zeros(n, bool), np.full(n, NO_ID)
        found[pos], near[pos] = anchor[self.group], least[self.group]
        hit = found & ((near < ids[self.doc[:n]]) | self.aligned()[:n])
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        whole = self.doc[: n - span + 1] == self.doc[WINDOW - 1:]
        return np.flatnonzero((sums[span:] > sums[:-span]) & whole)

    def window_keys(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window: a hash of both its halves, and that of its first half."""
        return mix(self.g[i] * U64(0xA24BAED4963EE407) + self.g[i + (WINDOW - BLOCK)]), self.g[i]


def _least_by_key(keys: tuple[np.ndarray, np.ndarray], ids: np.ndarray):
    """Distinct keys sorted, the least id of each, and the group of every input key."""
    order = np.lexsort((keys[1], keys[0]))
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), NO_ID)
    np.minimum.at(least, group, ids)
    return (a[new], b[new]), least, group


def _ids(col: pa.Array) -> np.ndarray:
    return pc.fill_null(col.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False)


def _send_probes(bits: int, text_at: int, id_at: int):
    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = C.thaw(blob.as_buffer())
                p = _Probes(rows.column(text_at), bits)
                multi, block, least = p.flags(_ids(rows.column(id_at)))
                low = ((p.keys & U64((1 << FP_BITS) - 1)).astype(np.uint32) << np.uint32(2)
                       | multi.astype(np.uint32) << np.uint32(1) | block.astype(np.uint32))
                out = [(b, low[s:e].tobytes(), least[s:e][block[s:e]].tobytes()) for b, s, e in C.split_sorted(p.keys, FP_BITS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()),
                     pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())],
                    names=["bucket", "chunk", "keys", "blocks"])
    return run


def _meet_probes(key, tbl):
    """Answers of one hash range: which probes found an anchor, and its least doc_id."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in tbl.column("keys")]
    v = np.concatenate(parts)
    fp = v >> np.uint32(2)
    # the index: the aligned blocks alone
    index, where = np.unique(fp[(v & 1) > 0], return_inverse=True)
    least = np.full(len(index), NO_ID)
    np.minimum.at(least, where, np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in tbl.column("blocks")]))
    # the probes; a block is asked for if two chunks, or two documents of one, have its words
    at = np.minimum(np.searchsorted(index, fp), max(0, len(index) - 1))
    found = index[at] == fp if len(index) else np.zeros(len(fp), bool)
    asked = np.bincount(at[found], minlength=len(index)) > 1
    asked[at[found & ((v & 2) > 0)]] = True
    anchor = found & asked[at] if len(index) else found
    ends = np.cumsum([len(p) for p in parts])
    cuts = [slice(e - len(p), e) for p, e in zip(parts, ends)]
    return pa.table([tbl.column("chunk").cast(pa.int64()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([len(p) for p in parts], pa.int32()),
                     pa.array([np.packbits(anchor[c]).tobytes() for c in cuts], pa.binary()),
                     pa.array([least[at[c][anchor[c]]].tobytes() for c in cuts], pa.binary())], names=["chunk", "bucket", "n", "mask", "least"])


def _hits_by_chunk(hits: DataFrame) -> DataFrame:
    return hits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "mask", "least")).alias("hits"))


def _read_hits(hits, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Per key of a chunk, in key order: whether it found an anchor, and the anchor's least doc_id."""
    anchor, least = np.zeros(total, bool), np.full(total, NO_ID)
    if hits:
        hits = sorted(hits, key=lambda x: x["bucket"])
        anchor[:] = np.concatenate([np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=x["n"]) for x in hits])
        least[anchor] = np.concatenate([np.frombuffer(x["least"], np.int64) for x in hits])
    return anchor, least


def _send_windows(bits: int, text_at: int, id_at: int):
    def run(batches):
        for batch in batches:
            for chunk, blob, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                rows = C.thaw(blob.as_buffer())
                p, ids = _Probes(rows.column(text_at), bits), _ids(rows.column(id_at))
                i = p.candidates(*_read_hits(hits.as_py(), len(p.keys)), ids)
                (keys, more), least, _ = _least_by_key(p.window_keys(i), ids[p.doc[i]])
                out = [(b, *(x[s:e].tobytes() for x in (keys, more, least))) for b, s, e in C.split_sorted(keys, 64 - bits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()),
                     *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))],
                    names=["bucket", "chunk", "keys", "more", "least"])
    return run


def _meet_windows(key, tbl):
    parts = [np.frombuffer(x.as_buffer(), U64) for x in tbl.column("keys")]
    more = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in tbl.column("more")])
    ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in tbl.column("least")])
    _, least, group = _least_by_key((np.concatenate(parts), more), ids)
    earlier = least[group] < ids
    return C.mask_batch(tbl.column("chunk").to_pylist(), key[0].as_py(), [len(p) for p in parts],
                        np.stack([earlier, earlier]))


def _cut(bits: int, text_at: int, id_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            for blob, m1, m2 in zip(batch.column(0), batch.column(1), batch.column(2)):
                rows = C.thaw(blob.as_buffer())
                p = _Probes(rows.column(text_at), bits)
                ids = _ids(rows.column(id_at))
                i = p.candidates(*_read_hits(m1.as_py(), len(p.keys)), ids)
                own = ids[p.doc[i]]
                _, least, group = _least_by_key(p.window_keys(i), own)
                elsewhere = C.read_masks(m2.as_py(), len(least))[0]
                gone = i[elsewhere[group] | (least[group] < own)]
                depth = np.zeros(len(p.h) + 1, np.int32)
                np.add.at(depth, gone, 1)
                np.add.at(depth, gone + WINDOW, -1)
                removed = np.cumsum(depth[:-1]) > 0
                edge = np.searchsorted(p.doc, np.arange(rows.num_rows + 1))
                n_words = np.diff(edge)
                sums = np.concatenate([[0], np.cumsum(removed)])
                n_removed = sums[edge[1:]] - sums[edge[:-1]]
                data, off = text_buffers(rows.column(text_at))
                kept, sha = [], []
                for k in range(rows.num_rows):
                    w = data[off[k]: off[k + 1]].tobytes().split()
                    if n_removed[k]:
                        w = compress(w, ~removed[edge[k]: edge[k + 1]])
                    t = b" ".join(w)
                    sha.append(hashlib.sha256(t).hexdigest())
                    kept.append(t if n_removed[k] else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.StructArray.from_arrays(rows.columns, names=names), pa.array(n_words.astype(np.int64)),
                     pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(sha, pa.string())], names=["row", "n_words", "n_removed", "kept", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``), ``n_words, n_removed, kept, kept_sha256``; ``kept`` is null
    for a text that lost nothing (``kept_sha256`` is still that of its words joined by one space)."""
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    chunks = C.packed(docs, text_col, "chunks")
    bits = C.bucket_bits(chunks)
    probes = chunks.select("chunk", "blob").mapInArrow(
        _send_probes(bits, text_at, id_at), "bucket int, chunk bigint, keys binary, blocks binary")
    hits = _hits_by_chunk(written(probes.groupBy("bucket").applyInArrow(_meet_probes, C.MASK_SCHEMA + ", least binary"), "hits"))
    told = chunks.select("chunk", "blob").join(hits, "chunk", "left")
    windows = told.select("chunk", "blob", "hits").mapInArrow(
        _send_windows(bits, text_at, id_at), "bucket int, chunk bigint, keys binary, more binary, least binary")
    again = C.masks_by_chunk(windows.groupBy("bucket").applyInArrow(_meet_windows, C.MASK_SCHEMA))
    both = told.join(again.withColumnRenamed("masks", "masks2"), "chunk", "left")
    schema = T.StructType([
        T.StructField("row", docs.schema), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
        T.StructField("kept_sha256", T.StringType())])
    return both.select("blob", "hits", "masks2").mapInArrow(_cut(bits, text_at, id_at, docs.columns), schema)


def substring_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
