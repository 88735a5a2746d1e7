"""Token ids in bit-packed files.

Every id takes the least number of bits that the vocabulary needs.  Blocks of ``BLOCK_IDS`` ids begin at
a byte offset that the file lists, so any run of ids is unpacked by NumPy from the blocks it touches.

A file holds whole documents in order of doc_id, about ``SHARD_IDS`` ids of them or one longer document:

    8 bytes   PXIDBIT1
    6 x u64   bits of an id, ids of a block, ids, documents, range, number in the range
    i64[]     doc_id of every document (0 where null), then one byte each: 1 for a null doc_id
    u64[]     first id of every document, and the number of ids
    u64[]     byte offset of every block in the payload, and the payload's size
    u64[]     payload; id i of a block lies at its bits i * bits, lowest bit first
    1 byte    line feed

all little-endian.  Texts are sorted in ranges of doc_id; a range encodes them and writes its files in
order, so all files in order of (range, number) hold the ids of the whole table in order of doc_id.  Spark's
text writer puts one record in each file.

Encoding asks the tokenizer once for each distinct word that a worker meets and remembers up to ``KNOWN_WORDS``
of them.  A word here ends at ASCII white space, which the tokenizer must drop and never join across, as
``word_bpe_49k.json`` does, and signs at the end of a word of plain Latin letters are a word of their own, as its
pattern has it; ``whole=True`` hands it the whole texts instead.

Rules.  A null text is empty and has the end id alone.  Null doc_ids come first.  Rows that repeat a doc_id
stand in order of their length, then of a hash of their text, then as they are read.  A text of any length is one document.  Extra columns are ignored.
An empty table writes no file and gives no rows.  An id that does not fit the bits raises.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proxima.llm.common import U64, counted_bytes, joined_if_small, process_cache, run_hashes, symbol_table, text_buffers, written
from proxima.session import delete_path, on_release, scratch_path

MAGIC = b"PXIDBIT1"
BLOCK_IDS = 4096                 # a multiple of 64, so that full blocks end at whole words
SHARD_IDS = 1 << 22
RANGE_BYTES = 64 << 20           # of text that is sorted and encoded in one task
TEXT_BYTES = 2 << 20             # of text that is encoded at once
KNOWN_WORDS = 1 << 21            # whose ids a worker remembers: about 120 MB
END_ID = 1


# ----------------------------------------------------------------- bits
def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    """``ids`` as 64-bit words, ``width`` bits each; 64 of them fill ``width`` words."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit {width} bits")
    rows = -(-len(ids) // 64)
    x = np.zeros((rows, 64), U64)
    x.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, width), U64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= x[:, j] << U64(shift)
        if shift + width > 64:
            out[:, word + 1] |= x[:, j] >> U64(64 - shift)
    return out.reshape(-1)


def unpack_bits(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed ``words``."""
    w = words.reshape(-1, width)
    out = np.empty((len(w), 64), np.uint32)
    mask = U64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = w[:, word] >> U64(shift)
        if shift + width > 64:
            v = v | (w[:, word + 1] << U64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


# ----------------------------------------------------------------- one file
def shard_bytes(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray, width: int,
                place: tuple[int, int]) -> bytes:
    """A file of the given documents, without the line feed that ends it."""
    payload = pack_bits(ids, width)
    blocks = -(-len(ids) // BLOCK_IDS)
    offsets = np.minimum(np.arange(blocks + 1, dtype=U64) * U64(BLOCK_IDS * width // 8), U64(payload.nbytes))
    first = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<6Q", width, BLOCK_IDS, len(ids), len(doc_ids), *place),
                     doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), first.tobytes(),
                     offsets.astype("<u8").tobytes(), payload.astype("<u8").tobytes()])


@dataclass
class Shard:
    """An opened file: ``ids(a, b)`` and ``document(i)`` unpack only the blocks they touch."""
    width: int
    block_ids: int
    place: tuple[int, int]
    doc_ids: np.ndarray
    null: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    payload: memoryview

    @classmethod
    def open(cls, data) -> Shard:
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of packed ids")
        width, block_ids, n, docs, *place = struct.unpack_from("<6Q", data, 8)
        blocks, at = -(-n // block_ids), 56

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out
        doc_ids, null = take("<i8", docs), take(np.uint8, docs)
        first, offsets = take("<u8", docs + 1).astype(np.int64), take("<u8", blocks + 1).astype(np.int64)
        if int(first[-1]) != n or at + int(offsets[-1]) + 1 != len(data):
            raise ValueError("a file of packed ids is cut short")
        return cls(width, block_ids, tuple(place), doc_ids, null.astype(bool), first, offsets, data[at: at + int(offsets[-1])])

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b`` of the file."""
        if a >= b:
            return np.empty(0, np.uint32)
        p, q = a // self.block_ids, -(-b // self.block_ids)
        words = np.frombuffer(self.payload[self.offsets[p]: self.offsets[q]], "<u8")
        return unpack_bits(words, self.width, b - p * self.block_ids)[a - p * self.block_ids:]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


# ----------------------------------------------------------------- encoding
def _tokenizer(path: str) -> Tokenizer:
    def build():
        tk = Tokenizer.from_file(path)
        tk.no_truncation()
        tk.no_padding()
        return tk
    return process_cache(("id-tokenizer", path), build, "idfiles")


#: Letters that are alone in their normal form and have one lower-case letter, then signs of ASCII.
_PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[!-/:-@\\[-`{-~]*)$"
_BETWEEN = "0"                   # a word of its own between the plain words that are encoded together


class Words:
    """Ids of distinct words; ``ids[edge[i]:edge[i + 1]]`` are those of word ``i``.

    Remembered words are found by a 64-bit hash and compared; one that shares a hash with another word is encoded
    anew each time it is met.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.between = tokenizer, tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.forget()

    def forget(self):
        self.known, self.edge, self.ids = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.hashes, self.at = np.empty(0, U64), np.empty(0, np.int64)

    def encoded(self, words: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, number of ids per word)``.  Plain words are encoded many at a time, the others one by one."""
        texts, sizes, ids = words.to_pylist(), [], []
        if len(self.between) == 1 and plain.all() and len(texts):
            got = np.array(self.tokenizer.encode(f" {_BETWEEN} ".join(texts), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(got == self.between[0])
            if len(cut) == len(texts) - 1:
                return np.delete(got, cut), np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            sizes.append(len(e.ids))
            ids.extend(e.ids)
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def of(self, words: pa.Array, plain: np.ndarray) -> np.ndarray:
        """The places of distinct ``words``; of ``plain`` ones the tokenizer sees nothing but letters."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        data, off = text_buffers(words)
        h = np.full(len(words), 1, U64)
        full = np.flatnonzero(np.diff(off))
        h[full] = run_hashes(symbol_table(False)[data], off[:-1][full], np.diff(off)[full])
        out = np.full(len(words), -1, np.int64)
        if len(self.at):
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.at) - 1)
            hit = np.flatnonzero(self.hashes[place] == h)
            at = self.at[place[hit]]
            same = pc.equal(self.known.take(pa.array(at)), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            out[hit[same]] = at[same]
        new = np.flatnonzero(out < 0)
        new = new[np.argsort(~plain[new], kind="stable")]           # plain ones first
        if len(new):
            sizes, ids = [np.diff(self.edge)], [self.ids]
            cuts = sorted({*range(0, len(new), 2048), int(plain[new].sum()), len(new)})
            for s, e in zip(cuts, cuts[1:]):
                got = self.encoded(words.take(pa.array(new[s:e])), plain[new[s:e]])
                ids.append(got[0])
                sizes.append(got[1])
            out[new] = len(self.known) + np.arange(len(new))
            self.edge = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            self.ids = np.concatenate(ids)
            self.known = pa.concat_arrays([self.known, words.take(pa.array(new))])
            hashes, at = np.concatenate([self.hashes, h[new]]), np.concatenate([self.at, out[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.at = hashes[order], at[order]
        return out


def _runs(head: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of runs of ``n`` from ``head`` on, end to end."""
    edge = np.cumsum(n)
    return np.repeat(head - (edge - n), n) + np.arange(edge[-1] if len(n) else 0)


def encoded_block(texts: pa.Array, path: str, end_id: int | None, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, number of ids per text)`` of some texts, end to end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    pieces = pa.LargeListArray.from_arrays(np.arange(len(texts) + 1), texts) if whole else pc.ascii_split_whitespace(texts)
    coded = pieces.flatten().dictionary_encode()
    words = process_cache(("id-words", path), lambda: Words(_tokenizer(path)), "idfiles")
    distinct = coded.dictionary.cast(pa.large_string())
    # a distinct word is itself, or its letters and then the signs after them
    cut = pc.extract_regex(distinct, _PLAIN)
    split = cut.is_valid().to_numpy(zero_copy_only=False) & (not whole)
    stem = pc.if_else(pa.array(split), cut.field("stem").cast(pa.large_string()), distinct)
    rest = cut.field("rest").cast(pa.large_string()).filter(pa.array(split))
    both = pa.concat_arrays([stem, rest]).dictionary_encode()
    plain = np.zeros(len(both.dictionary), bool)
    parts_at = both.indices.to_numpy()
    plain[parts_at[: len(distinct)][split]] = True
    place = words.of(both.dictionary, plain)[parts_at]
    size = np.diff(words.edge)
    part = np.zeros((len(distinct), 2), np.int64)
    n_part = np.zeros((len(distinct), 2), np.int64)
    part[:, 0], n_part[:, 0] = words.edge[place[: len(distinct)]], size[place[: len(distinct)]]
    part[split, 1], n_part[split, 1] = words.edge[place[len(distinct):]], size[place[len(distinct):]]
    flat = words.ids[_runs(part.reshape(-1), n_part.reshape(-1))]   # of the distinct words, end to end
    n_word = n_part.sum(axis=1)
    which = coded.indices.to_numpy()
    n = n_word[which]
    ids = flat[_runs((np.cumsum(n_word) - n_word)[which], n)]
    ends = np.concatenate([[0], np.cumsum(n)])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
    lengths = np.diff(ends)
    if end_id is None:
        return ids, lengths
    return np.insert(ids, ends[1:], end_id), lengths + 1


def _blocks(batch: pa.RecordBatch):
    _, off = text_buffers(batch.column(1))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(off, off[a] + TEXT_BYTES, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


# ----------------------------------------------------------------- writing
def _shards(path: str, end_id: int | None, whole: bool, width: int):
    def run(batches):
        at, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0                              # (doc_ids, lengths, ids) of the file to come

        def out():
            keys = pa.concat_arrays([h[0] for h in held])
            blob = shard_bytes(pc.fill_null(keys, 0).to_numpy(), pc.is_null(keys).to_numpy(zero_copy_only=False),
                               np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), width, (at, seq))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["file"])
        for batch in batches:
            for part in _blocks(batch):
                ids, lengths = encoded_block(part.column(1), path, end_id, whole)
                edge = np.concatenate([[0], np.cumsum(lengths)])
                a = 0
                while a < len(part):
                    b = max(a + 1, int(np.searchsorted(edge, edge[a] + SHARD_IDS - size, "right")) - 1)
                    held.append((part.column(0).slice(a, b - a), lengths[a:b], ids[edge[a]: edge[b]]))
                    size += int(edge[b] - edge[a])
                    a = b
                    if size >= SHARD_IDS or a < len(part):
                        yield out()
                        held, size, seq = [], 0, seq + 1
        if held:
            yield out()
    return run


def write_id_files(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID, whole: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> str:
    """Files of the ids of all texts under ``path``; returns it.  A rerun never overwrites."""
    spark = docs.sparkSession
    width = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted_bytes(docs, text_col) // RANGE_BYTES))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("n").asc(), F.col("h").asc(), F.col("at").asc()]
    ranged = (rows.select("*", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
              .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text"))
    (ranged.mapInArrow(_shards(tokenizer, end_id, whole, width), "file binary").select(F.col("file").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("compression", "none").text(path))
    return path


# ----------------------------------------------------------------- reading
def _opened(batches):
    for batch in batches:
        for data in batch.column(0):
            shard = Shard.open(data.as_buffer())
            ids = shard.ids(0, int(shard.first[-1]))
            n = len(shard.doc_ids)
            a = 0
            while a < n:                                    # rows of about a mebibyte
                b = max(a + 1, int(np.searchsorted(shard.first, shard.first[a] + (1 << 18), "right")) - 1)
                cut = shard.first[a: b + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, shard.place[0]), pa.int64()), pa.array(np.full(b - a, shard.place[1]), pa.int64()),
                     pa.array(shard.doc_ids[a:b], pa.int64(), mask=shard.null[a:b]), pa.array(cut[:-1], pa.int64()),
                     pa.array([ids[s:e].tobytes() for s, e in zip(cut, cut[1:])], pa.binary())],
                    names=["range", "seq", "doc_id", "first", "ids"])
                a = b


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """``range, seq, doc_id, first, ids`` of every document: its file, its first id there, and its ids as
    little-endian 32-bit integers."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_opened, "range bigint, seq bigint, doc_id bigint, first bigint, ids binary")


def file_starts(docs: DataFrame) -> DataFrame:
    """``range, seq, before``: the ids in all earlier files, from rows ``range, seq, first, n``.  Sums run over the
    files of a range, the ranges of a group of 1024, and the groups."""
    def ahead(key, by):
        before = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    files = docs.groupBy("range", "seq").agg(F.max(F.col("first") + F.col("n")).alias("n")).withColumn("grp", F.shiftright("range", 10))
    ranges = files.groupBy("grp", "range").agg(F.sum("n").alias("n"))
    groups = ranges.groupBy("grp").agg(F.sum("n").alias("n"))
    f = files.select("grp", "range", "seq", ahead("seq", ["grp", "range"]))
    r = ranges.select("range", ahead("range", ["grp"]).alias("r"))
    g = groups.select("grp", ahead("grp", [F.lit(0)]).alias("g"))
    return f.join(r, "range").join(g, "grp").select("range", "seq", (F.col("ahead") + F.col("r") + F.col("g")).alias("before"))


def id_file_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes files of ``docs`` to the scratch folder and reads them back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    path = write_id_files(docs, tokenizer, scratch_path(spark, "llm-id-files"))
    on_release(lambda: delete_path(spark, path))
    read = read_id_files(spark, path).select(
        "range", "seq", "doc_id", "first", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n"), F.crc32("ids").alias("ids_crc32"))
    read = written(read, "id-rows")
    starts = written(file_starts(read), "id-starts")
    out = joined_if_small(read, starts, ["range", "seq"], "inner")
    return out.select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
