"""Helpers shared by the operators: scratch tables, per-process caches, text blocks, word hashes.

Text work runs in Arrow batches.  ``text_blocks`` cuts a batch into blocks of bounded bytes, so
the NumPy temporaries of a task stay a few megabytes whatever the batch holds; one document is
never cut, so a block grows to the longest single text at most.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from proxima.session import delete_path, on_release, scratch_path

U64 = np.uint64
BLOCK_BYTES = 1 << 19
BROADCAST_ROWS = 1_000_000      # of a key and a few numbers each
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


# ----------------------------------------------------------------- tables and sizes
def small_batches(spark: SparkSession) -> None:
    """Cuts the session's Arrow batches to ``BATCH_BYTES`` where it has Spark's default of 64 MiB, which each running task
    would hold up to four times: in the JVM and in its Python worker, coming and going.  No result depends on it."""
    if spark.conf.get(BATCH_CONF) in (f"{64 << 20}b", f"{64 << 20}"):     # a default of None would hide Spark's own
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file: the only one the queries use; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: the lineage is cut, and
    the rows survive lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    on_release(lambda: delete_path(df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A frame of the driver's few ``rows``, sent as Arrow: given as tuples they would pass through Python on the executors,
    in a second daemon with workers of its own that stay beside the others for a minute."""
    cols = list(zip(*rows)) or [()] * len(columns)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(cols, columns.values())], names=list(columns)))


def counted_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column, by one aggregation.  Used to size ranges and buckets."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def written_and_seen(df: DataFrame, name: str, *cols: str) -> tuple[DataFrame, tuple]:
    """``written``, with the number of rows and a sum of hashes of ``cols`` taken in the same job."""
    obs = Observation()
    out = written(df.observe(obs, F.count(F.lit(1)).alias("n"),
                             F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s")), name)
    got = obs.get
    return out, (got["n"], got["s"])


def joined_if_small(big: DataFrame, small: DataFrame, on: str, how: str, rows: int | None = None) -> DataFrame:
    """Join a big frame with a written table of keys and a few numbers: broadcast when the *counted*
    rows are at most BROADCAST_ROWS, a shuffle join beyond.  Same rows either way."""
    rows = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and what one keeps for later another may need now."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):              # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def let_go() -> None:
    """Drops the values kept for an owner (see ``process_cache``) and gives their memory back: for an operator's last step."""
    store = sys.modules.get("_llm_process_cache")
    if store is not None:
        store.__dict__.setdefault("held", {}).clear()
    give_back()


def process_cache(key, build: Callable, owner: str | None = None):
    """A value built once per Python process.  The package is pickled by value, so module globals
    do not outlive a task; this store does (Python workers are reused).

    Values of an ``owner`` stay until a task of another owner asks for one of its own: a worker that goes from one
    operator to the next holds the tables of one of them.  Values without an owner are small and shared.
    """
    store = sys.modules.setdefault("_llm_process_cache", types.ModuleType("_llm_process_cache")).__dict__
    if owner is not None and store.get("owner") != owner:
        held = store.setdefault("held", {})
        if held:
            held.clear()
            give_back()
        store["owner"] = owner
    kept = store.setdefault("shared" if owner is None else "held", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


# ----------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of an odd 64-bit base (grown on demand, kept per process)."""
    have = process_cache("powers", lambda: [np.ones(1, U64)])
    if len(have[0]) < n:
        size = 1 << max(8, int(n - 1).bit_length())
        have[0] = np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(size - 1, 0x9E3779B97F4A7C15, U64))])
    return have[0]


def symbol_table(lower: bool) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower``, A-Z share the values of a-z."""
    def build():
        t = np.random.default_rng(20240501).integers(1, 2**64 - 1, 256, dtype=U64) | U64(1)
        if lower:
            t[65:91] = t[97:123]
        return t
    return process_cache(("symbols", lower), build)


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``values`` (runs lie end to end, none empty)."""
    if not len(starts):
        return np.empty(0, U64)
    rel = np.arange(len(values), dtype=np.int64) - np.repeat(starts, lengths)
    sums = np.add.reduceat(values * _powers(int(lengths.max()) + 1)[rel], starts)
    return mix(sums + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """The words ``[^\\x20\\x09-\\x0D]+`` of the texts ``data[offsets[i]:offsets[i+1]]`` (UTF-8):
    ``(hash uint64, text index, start byte, end byte)``, in order."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~blank
    first = solid.copy()
    first[1:] &= blank[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(data)]
    first[heads] = solid[heads]                    # a text never continues the word before it
    start = np.flatnonzero(first)
    if not len(start):
        return np.empty(0, U64), np.empty(0, np.int64), start, start
    word_no = np.cumsum(first)[solid]              # 1-based word of every solid byte
    lengths = np.bincount(word_no, minlength=len(start) + 1)[1:]
    cut = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = run_hashes(symbol_table(lower)[data[solid]], cut, lengths)
    return h, np.searchsorted(offsets, start, "right") - 1, start, start + lengths


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive hashes (order matters), by doubling: log2(size) passes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out, done, part, span, rest, step = None, 0, h, 1, size, 1
    while rest:
        if rest & 1:
            out = part.copy() if out is None else mix(out[: len(part) - done] * U64(0x9E3779B97F4A7C15) + part[done:])
            done += span
        rest >>= 1
        if rest:
            part = mix(part[: len(part) - span] * U64(0xC2B2AE3D27D4EB4F + 2 * step) + part[span:])
            span *= 2
            step += 1
    return out[:n]


# ----------------------------------------------------------------- Arrow
def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def text_blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows with at most ``limit`` bytes, or
    one longer text."""
    data, off = text_buffers(col)
    a, n = 0, len(col)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a]: off[b]], off[a: b + 1] - off[a]
        a = b
    if len(data) > limit:
        give_back()


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
