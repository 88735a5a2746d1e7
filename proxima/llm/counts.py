"""Token counts without ids: each distinct pre-token is counted once and joined to its uses.

1. Texts are split into pre-tokens.  A chunk of texts keeps, per document, which distinct pre-tokens
   it uses and how often; the distinct pre-tokens themselves go to their hash range.
2. A range merges the pre-tokens of all chunks and counts the tokens of each distinct one, once.
3. The counts come back to each chunk in the order it sent its pre-tokens, are joined to the
   per-document frequencies, and ``frequency * count`` is summed per document.

A pre-token moves once per chunk that uses it, however many documents do, so one that is in every
document weighs no more than any other.

Rules.  A null text is empty (0 bytes, 0 tokens); the special string inside a text counts as one
token, as the library does by default; rows are independent, so repeated rows get equal counts;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proxima.llm.bpe import BLOCK_BYTES, BlockPieces
from proxima.llm.chunks import freeze, split_sorted, thaw
from proxima.llm.common import counted_bytes, give_back, let_go, process_cache, text_blocks, written

CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 40 << 20          # bytes of text whose pre-tokens make one hash range
SORTED_USES = 1 << 17            # uses that are sorted at once
_MOVED = "kind int, chunk bigint, bucket int, blob binary"


def _tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core, and the library's threads keep memory
    return process_cache(("tokenizer", path), lambda: Tokenizer.from_file(path), "counts")


class _Chunk:
    """Collects blocks until there is enough text for a chunk."""

    def __init__(self):
        self.size, self.docs, self.bytes, self.hashes, self.texts, self.uses = 0, [], [], [], [], []

    def add(self, ids: pa.Array, data: np.ndarray, off: np.ndarray):
        block = BlockPieces(data, off)
        base = sum(len(h) for h in self.hashes)
        n = len(off) - 1
        per_doc = np.repeat(np.arange(n), np.diff(block.edge))
        key, times = np.unique(per_doc.astype(np.int64) << 32 | block.which, return_counts=True)
        texts = pa.array(block.distinct, pa.string())
        self.docs.append(ids)
        self.bytes.append(np.diff(off))
        self.hashes.append(block.hashes)
        self.texts.append(texts)
        self.uses.append((np.bincount(key >> 32, minlength=n), ((key & 0xFFFFFFFF) + base).astype(np.uint32), times.astype(np.uint32)))
        self.size += len(data)

    def rows(self, chunk: int, bits: int):
        """The row of uses, and one row of distinct pre-tokens per hash range."""
        every = np.concatenate(self.hashes)
        keys, first, place = np.unique(every, return_index=True, return_inverse=True)
        place = place.astype(np.int32)
        per_doc = np.concatenate([u[0] for u in self.uses])
        which = place[np.concatenate([u[1] for u in self.uses])] if len(every) else np.empty(0, np.int32)
        times = np.concatenate([u[2] for u in self.uses])
        self.uses = self.hashes = every = place = None
        # sorted within a document, so that steps are small and pack well; some documents at a time, for memory
        edge = np.concatenate([[0], np.cumsum(per_doc)])
        a = 0
        while a < len(per_doc):
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + SORTED_USES, "right")) - 1)
            part = slice(edge[a], edge[b])
            order = np.lexsort((which[part], np.repeat(np.arange(b - a, dtype=np.int32), per_doc[a:b])))
            which[part], times[part] = which[part][order], times[part][order]
            a = b
        step = np.diff(which, prepend=0)
        heads = edge[:-1][per_doc > 0]
        step[heads] = which[heads]
        del which
        uses = pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()),
             pa.array([freeze(pa.RecordBatch.from_arrays([pa.concat_arrays(self.docs), pa.array(np.concatenate(self.bytes)), pa.array(per_doc)], names=["id", "bytes", "n"]))]),
             pa.array([freeze(pa.RecordBatch.from_arrays(
                 [pa.array((step & 0xFFFF).astype(np.uint16)), pa.array((step >> 16).astype(np.uint16)), pa.array(times)],
                 names=["low", "high", "times"]))])], names=["v", "docs", "uses"])
        yield (0, chunk, -1, freeze(uses))
        distinct = pa.concat_arrays(self.texts)
        for b, s, e in split_sorted(keys, 64 - bits):
            texts = distinct.take(pa.array(first[s:e]))
            yield (1, chunk, b, freeze(pa.RecordBatch.from_arrays([texts], names=["piece"])))


def _split(bits: int):
    def run(batches):
        chunk, seq = _Chunk(), TaskContext.get().partitionId() << 32

        def out(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                names=["kind", "chunk", "bucket", "blob"])
        for batch in batches:
            for a, b, data, off in text_blocks(batch.column(1), BLOCK_BYTES):
                chunk.add(batch.column(0).slice(a, b - a), data, off)
                if chunk.size >= CHUNK_BYTES:
                    yield out(chunk.rows(seq, bits))
                    chunk, seq = _Chunk(), seq + 1
                    give_back()
        if chunk.docs:
            yield out(chunk.rows(seq, bits))
    return run


def _count(path: str):
    def run(key, tbl):
        tk = _tokenizer(path)
        parts = [thaw(b.as_buffer()).column(0) for b in tbl.column("blob")]
        coded = pa.concat_arrays(parts).dictionary_encode()
        distinct, counts = coded.dictionary, []
        for i in range(0, len(distinct), 4096):
            counts.extend(len(e.ids) for e in tk.encode_batch_fast(distinct.slice(i, 4096).to_pylist(), add_special_tokens=False))
        n = np.array(counts, np.uint32)[coded.indices.to_numpy()]
        ends = np.cumsum([len(p) for p in parts])
        blobs = [n[e - len(p): e].tobytes() for p, e in zip(parts, ends)]
        del coded, distinct
        give_back()                                     # the worker may idle beside those of the next stage
        return pa.table([tbl.column("chunk"), tbl.column("bucket"), pa.array(blobs, pa.binary())],
                        names=["chunk", "bucket", "counts"])
    return run


def _sum(batches):
    for batch in batches:
        for blob, answers in zip(batch.column(0), batch.column(1)):
            x = thaw(blob.as_buffer())
            docs, uses = thaw(x.column("docs")[0].as_buffer()), thaw(x.column("uses")[0].as_buffer())
            per_doc = docs.column("n").to_numpy()
            step = uses.column("low").to_numpy().astype(np.int64) | uses.column("high").to_numpy().astype(np.int64) << 16
            heads = np.concatenate([[0], np.cumsum(per_doc)])
            n_tokens = np.zeros(len(per_doc), np.int64)
            if len(step):
                counts = np.concatenate([np.frombuffer(a["counts"], np.uint32)
                                         for a in sorted(answers.as_py(), key=lambda a: a["bucket"])]).astype(np.int64)
                # positions within a document: running sums of the steps, begun anew at each document
                run = np.cumsum(step)
                used = per_doc > 0
                before = run[heads[:-1][used]] - step[heads[:-1][used]]
                which = run - np.repeat(before, per_doc[used])
                weight = counts[which] * uses.column("times").to_numpy()
                n_tokens[used] = np.add.reduceat(weight, heads[:-1][used])
            yield pa.RecordBatch.from_arrays([docs.column("id"), docs.column("bytes").cast(pa.int64()), pa.array(n_tokens)],
                                             names=["doc_id", "n_bytes", "n_tokens"])
        let_go()                                        # the tokenizer too: the worker may idle beside the next operator's


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    size = counted_bytes(docs, text_col)
    bits = max(3, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))
    docs = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    moved = written(docs.mapInArrow(_split(bits), _MOVED), "pre-tokens", partition_by="kind")
    counts = moved.where("kind = 1").select("bucket", "chunk", "blob").groupBy("bucket").applyInArrow(
        _count(path), "chunk bigint, bucket int, counts binary")
    answers = counts.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    uses = moved.where("kind = 0").select("chunk", "blob").join(answers, "chunk", "left")
    out = uses.select("blob", "answers").mapInArrow(_sum, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
