"""Chunks of rows for operators that pass over the same texts more than once.

``packed`` writes a frame as rows ``(chunk, bytes, blob)``: a few megabytes of text each, the blob
an Arrow stream with zstd.  A chunk keeps its number and order, so later passes can be told about
its contents by position instead of by key.

``by_bucket`` / ``masks_by_chunk`` are the two moves between chunks and hash ranges: a pass sends,
for each bucket of the hash space, its sorted keys as one blob; whoever reduces the bucket answers
with two bits per key; the answers of a chunk come back as one row.  Keys are distinct within a
chunk (combined before the shuffle), so a key that a third of all rows share fills no bucket more
than any other: it occurs at most once per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import U64, text_blocks, written

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20          # text bytes whose keys make one bucket
MASK_SCHEMA = "chunk bigint, bucket int, n int, mask binary"


def freeze(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thaw(blob) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as r:
        return r.read_next_batch()


def packed(df: DataFrame, text_col: str, name: str) -> DataFrame:
    at = df.columns.index(text_col)

    def run(batches):
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, _ in text_blocks(batch.column(at), CHUNK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seq], pa.int64()), pa.array([len(data)], pa.int64()),
                     pa.array([freeze(pa.RecordBatch.from_arrays(part.columns, schema=part.schema))], pa.binary())],
                    names=["chunk", "bytes", "blob"])
                seq += 1
    return written(df.mapInArrow(run, "chunk bigint, bytes bigint, blob binary"), name)


def bucket_bits(chunks: DataFrame) -> int:
    """log2 of the number of buckets, from the counted text bytes."""
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    return max(4, int(np.ceil(np.log2(max(1, total / BUCKET_BYTES)))))


def split_sorted(keys: np.ndarray, shift: int):
    """``(bucket, start, end)`` of the runs of sorted ``keys`` that share their top bits."""
    b = (keys >> U64(shift)).astype(np.int64)
    cut = np.flatnonzero(np.diff(b)) + 1
    starts = np.concatenate([[0], cut]) if len(b) else np.empty(0, np.int64)
    ends = np.concatenate([cut, [len(b)]]) if len(b) else starts
    return zip(b[starts].tolist(), starts.tolist(), ends.tolist())


def masks_by_chunk(masks: DataFrame) -> DataFrame:
    """One row per chunk with the answers of all buckets (two bits for each of its keys)."""
    return masks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "mask")).alias("masks"))


def read_masks(masks, total: int) -> np.ndarray:
    """The two flag rows for a chunk's keys in key order, from its ``masks`` value."""
    if not masks:
        return np.zeros((2, total), bool)
    parts = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=2 * m["n"]).reshape(2, m["n"])
             for m in sorted(masks, key=lambda m: m["bucket"])]
    return np.concatenate(parts, axis=1).astype(bool)


def mask_batch(chunks, bucket: int, sizes, flags: np.ndarray) -> pa.Table:
    """Answers for one bucket: ``flags`` has two rows over the keys of all its chunks, end to end."""
    ends = np.cumsum(sizes)
    blobs = [np.packbits(flags[:, e - s: e]).tobytes() for s, e in zip(sizes, ends)]
    return pa.table([pa.array(chunks, pa.int64()), pa.array([bucket] * len(blobs), pa.int32()),
                     pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "n", "mask"])
