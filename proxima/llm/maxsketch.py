"""Ranked lexical search with hashed max-sketches.

A term's share of a score is its weight, which depends on the corpus, times its *impact* in a document, which
depends on how often it stands there and on the document's length:

    weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    impact = (10**9 * tf) div (1000 * tf + 20 m),   m = 50 + (50 * n * N) div L

with N documents that have a term, L terms in all, n in the document.  Integers are 64 bits wide.

1. One pass counts N, L and the document frequencies of the terms that the queries hold.
2. A second pass folds the impacts of all terms of a document into a sketch: two rows of coordinates, at least four
   for each distinct term, each coordinate the largest impact among the terms that hash to it.  The lesser of
   a query term's two coordinates is never below its impact, so the weighted sum over a query's terms bounds the score.
3. All queries of a batch look up all documents of a block at once.  Each query then takes documents by falling
   bound and scores them exactly, until the next bound is below its k-th score so far.  Bounds equal to it
   are still scored, since ties go to the lower doc_id.  A task keeps k documents per query; windows merge the tasks.

Terms are compared by 64-bit hashes.  Queries travel to the tasks in batches of at most ``QUERY_BYTES`` of text (or one
longer query); every batch is a search of all documents.

Rules.  A null or empty text has no terms and is in no result; an item without terms has no result.  A
repeated item is searched once per row.  Repeated doc_ids are ranked row by row; null ones come last
among equal scores.  Terms of any length and texts of any length are whole.  Extra columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxima.llm.common import U64, run_hashes, symbol_table, text_blocks
from proxima.session import send

TOP = 50
QUERY_BYTES = 4 << 20            # text of the queries of one batch
BLOCK_BYTES = 1 << 19            # text of the documents of one block
CELLS = 1 << 21                  # (document, query term) cells that are looked up at once
SLOTS = 4                        # coordinates per distinct term and row of a sketch, at least
STEP = 32                        # documents that a query scores before it looks at its k-th score again
SCHEMA = "item bigint, item_id bigint, task int, doc_id bigint, score bigint"


# ----------------------------------------------------------------- terms
def term_bytes() -> np.ndarray:
    """Which bytes belong to a term: 0-9, A-Z, a-z and every byte of a code point from U+0080."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text index)`` of every term of the texts ``data[off[i]:off[i + 1]]``, A-Z as a-z."""
    solid = term_bytes()[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = solid[heads]                     # a text never continues the term before it
    start = np.flatnonzero(first)
    if not len(start):
        return np.empty(0, U64), np.empty(0, np.int64)
    lengths = np.bincount(np.cumsum(first)[solid], minlength=len(start) + 1)[1:]
    cut = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return run_hashes(symbol_table(True)[data[solid]], cut, lengths), np.searchsorted(off, start, "right") - 1


@dataclass
class Counted:
    """The distinct terms of each text of a block, in order of (text, hash), and how often they stand there."""
    hash: np.ndarray
    text: np.ndarray
    tf: np.ndarray
    edge: np.ndarray            # first entry of every text, and the number of entries
    n: np.ndarray               # terms of every text

    @classmethod
    def of(cls, data: np.ndarray, off: np.ndarray) -> Counted:
        h, text = terms(data, off)
        docs = len(off) - 1
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        return cls(h[at], text[at], tf, np.searchsorted(text[at], np.arange(docs + 1)), np.bincount(text, minlength=docs))


# ----------------------------------------------------------------- queries
@dataclass
class Queries:
    """Terms of a batch: query q has ``hash[edge[q]:edge[q + 1]]``, sorted."""
    item_ids: list
    hash: np.ndarray
    edge: np.ndarray
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list) -> Queries:
        """From ``(item_id, text)`` rows; rows without terms are left out."""
        ids, each = [], []
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            h, _ = terms(raw, np.array([0, len(raw)]))
            if len(h):
                ids.append(item_id)
                each.append(np.unique(h))
        return cls(ids, np.concatenate(each) if each else np.empty(0, U64), np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int64))

    @property
    def vocabulary(self) -> np.ndarray:
        return np.unique(self.hash)

    def weighted(self, documents: int, df: np.ndarray) -> Queries:
        """With the weights that belong to the frequencies ``df`` of ``vocabulary``."""
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in df], np.int64)
        return Queries(self.item_ids, self.hash, self.edge, w[np.searchsorted(self.vocabulary, self.hash)])


# ----------------------------------------------------------------- sketches and scores
def impacts(c: Counted, documents: int, total: int) -> np.ndarray:
    m = 50 + (50 * c.n * documents) // max(total, 1)
    return (1_000_000_000 * c.tf) // (1000 * c.tf + 20 * m[c.text])


@dataclass
class Sketches:
    """The max-sketches of a block: text i has ``mask[i] + 1`` coordinates a row, from ``base[i]`` on."""
    rows: tuple[np.ndarray, np.ndarray]
    base: np.ndarray
    mask: np.ndarray

    @classmethod
    def of(cls, c: Counted, impact: np.ndarray) -> Sketches:
        need = np.maximum(SLOTS * np.diff(c.edge), 8)
        size = 1 << np.ceil(np.log2(need)).astype(np.int64)
        base, mask = np.cumsum(size) - size, size - 1
        rows = []
        for shift in (0, 32):
            row = np.zeros(int(size.sum()), np.int64)
            at = base[c.text] + ((c.hash >> U64(shift)).astype(np.int64) & mask[c.text])
            np.maximum.at(row, at, impact)
            rows.append(row)
        return cls(tuple(rows), base, mask)

    def bounds(self, q: Queries) -> np.ndarray:
        """An upper bound of the score of every text (row) for every query (column)."""
        low = [(q.hash >> U64(s)).astype(np.int64) for s in (0, 32)]
        out = np.empty((len(self.base), len(q.edge) - 1), np.int64)
        step = max(1, CELLS // max(1, len(q.hash)))
        for s in range(0, len(out), step):
            base, mask = self.base[s: s + step, None], self.mask[s: s + step, None]
            least = np.minimum(self.rows[0][base + (low[0] & mask)], self.rows[1][base + (low[1] & mask)])
            out[s: s + step] = np.add.reduceat(least * q.weight, q.edge[:-1], axis=1)
        return out


def exact_scores(c: Counted, impact: np.ndarray, text: np.ndarray, query: np.ndarray, q: Queries) -> np.ndarray:
    """The scores of pairs (text, query)."""
    size = q.edge[query + 1] - q.edge[query]
    pair = np.repeat(np.arange(len(text)), size)
    at = np.repeat(q.edge[query] - (np.cumsum(size) - size), size) + np.arange(len(pair))
    want, doc = q.hash[at], text[pair]
    # binary search of a hash among the sorted hashes of its text
    lo, hi = c.edge[doc], c.edge[doc + 1]
    end = hi.copy()
    while len(lo) and (lo < hi).any():
        mid = (lo + hi) // 2
        low = (lo < hi) & (c.hash[np.minimum(mid, len(c.hash) - 1)] < want)
        hi = np.where((lo < hi) & ~low, mid, hi)
        lo = np.where(low, mid + 1, lo)
    there = lo < end
    there[there] = c.hash[lo[there]] == want[there]
    part = np.zeros(len(pair), np.int64)
    part[there] = impact[lo[there]] * q.weight[at[there]]
    return np.add.reduceat(part, np.cumsum(size) - size) if len(text) else np.empty(0, np.int64)


class Best:
    """The best documents of every query so far; ``scored`` counts the exact scores that were asked for."""

    def __init__(self, queries: int, k: int):
        self.k, self.scored = k, 0
        self.query, self.score, self.doc = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.null = np.empty(0, bool)
        self.floor = np.zeros(queries, np.int64)    # the k-th score, 0 while there are fewer

    def add(self, query, score, doc, null):
        ok = score > 0
        self.query, self.score = np.concatenate([self.query, query[ok]]), np.concatenate([self.score, score[ok]])
        self.doc, self.null = np.concatenate([self.doc, doc[ok]]), np.concatenate([self.null, null[ok]])
        order = np.lexsort((self.doc, self.null, -self.score, self.query))
        q = self.query[order]
        starts = np.searchsorted(q, np.arange(len(self.floor) + 1))
        rank = np.arange(len(q)) - starts[q]
        order = order[rank < self.k]
        self.query, self.score, self.doc, self.null = self.query[order], self.score[order], self.doc[order], self.null[order]
        ends = np.searchsorted(self.query, np.arange(len(self.floor)), "right")
        full = np.diff(np.append(0, ends)) == self.k
        self.floor = np.where(full, self.score[np.maximum(ends - 1, 0)], 0) if len(self.score) else self.floor

    def take_block(self, data: np.ndarray, off: np.ndarray, docs: np.ndarray, null: np.ndarray, q: Queries, documents: int, total: int):
        """Searches one block of texts."""
        c = Counted.of(data, off)
        if not len(c.hash) or not len(q.item_ids):
            return
        impact = impacts(c, documents, total)
        bound = Sketches.of(c, impact).bounds(q)
        text, query = np.nonzero((bound >= self.floor) & (bound > 0))
        b = bound[text, query]
        order = np.lexsort((-b, query))
        text, query, b = text[order], query[order], b[order]
        while len(text):
            # the next few of every query, by falling bound
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            now = rank < STEP
            self.scored += int(now.sum())
            self.add(query[now], exact_scores(c, impact, text[now], query[now], q), docs[text[now]], null[text[now]])
            left = ~now & (b >= self.floor[query])
            text, query, b = text[left], query[left], b[left]


# ----------------------------------------------------------------- Spark
def _ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)


def corpus_statistics(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """``(documents with a term, terms, document frequencies of the sorted hashes vocabulary)``.  ``docs``: doc_id, text."""
    sent = send(docs.sparkSession, vocabulary)

    def run(batches):
        known = sent.value
        df, n, total = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for _, _, data, off in text_blocks(batch.column(1), BLOCK_BYTES):
                c = Counted.of(data, off)
                n, total = n + int((c.n > 0).sum()), total + int(c.n.sum())
                if len(known):
                    at = np.minimum(np.searchsorted(known, c.hash), len(known) - 1)
                    df += np.bincount(at[known[at] == c.hash], minlength=len(known))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], term]), pa.int64()),
                                          pa.array(np.concatenate([[n, total], df[term]]), pa.int64())], names=["term", "n"])
    got = {r["term"]: int(r["n"]) for r in docs.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.array([got.get(i, 0) for i in range(len(vocabulary))], np.int64)
    return got.get(-2, 0), got.get(-1, 0), df


def _search(docs: DataFrame, q: Queries, k: int, documents: int, total: int) -> DataFrame:
    sent = send(docs.sparkSession, q)

    def run(batches):
        q, best = sent.value, None
        for batch in batches:
            ids, null = _ids(batch.column(0))
            best = best or Best(len(q.item_ids), k)
            for a, b, data, off in text_blocks(batch.column(1), BLOCK_BYTES):
                best.take_block(data, off, ids[a:b], null[a:b], q, documents, total)
        if best is not None:
            items = pa.array(q.item_ids, pa.int64())
            n = len(best.query)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.query, pa.int64()), items.take(pa.array(best.query)), pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()),
                 pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())], names=["item", "item_id", "task", "doc_id", "score"])

    def cut(df, *by):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # tasks are merged in groups of 256 first, so that no item's rows grow with the number of tasks in one step
    some = cut(docs.mapInArrow(run, SCHEMA).withColumn("tasks", F.shiftright("task", 8)), "item", "tasks").drop("rank")
    return cut(some, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // QUERY_BYTES))
    out = None
    for b in range(batches):
        of_batch = items if batches == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == b)
        q = Queries.of([tuple(r) for r in of_batch.orderBy("item_id").collect()])      # about QUERY_BYTES
        documents, total, df = corpus_statistics(docs, q.vocabulary)
        found = _search(docs, q.weighted(documents, df), k, documents, total)
        out = found if out is None else out.union(found)
    return out
