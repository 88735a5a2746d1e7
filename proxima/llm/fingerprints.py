"""Document fingerprints from closed syncmers, compared by position.

A k-mer of code points is a closed syncmer when the least of its inner s-mers lies at its first or
last place.  Whether it is one depends on its own letters only, so an edit elsewhere changes no
anchor.  The fingerprint lists anchors as ``hash, position``: all whose hash lies below one fixed
value, an eighth of the hashes, so its length grows with the text and two fingerprints hold the same
part of whatever the texts share, however long they are.  A text with few of them lists its LEAST
smallest ones, or all it has.

Likeness.  Both lists are cut at the lower of their two hash bounds (the fixed value, or the last hash
of a list of the smallest), so each holds all its anchors below one value.  Anchors with equal hashes vote for the shift between their positions, and an
anchor counts as matched when its shift has two votes or more (one, if either list has fewer than
four anchors).  The likeness is the matched share of the longer list: 1 for equal texts, near 0 for
texts that share only scattered words.

``edited_pairs`` needs the next document of each row.  Rows are spread by ranges of doc_id and sorted
inside a range; the first document of a range is sent to the range before it as well, so nothing is
gathered and every text moves once.

Rules.  A null text is empty; its fingerprint is the empty string, and two empty ones are alike (1.0).
A text shorter than
an anchor is one.  Texts of fewer than 64 letters have shorter anchors, those of 256 or more longer
ones, and those between have both, listed one after the other with a slash between; two fingerprints are
compared by the longest size both have.  Below 64 beside 256 or more letters there is none: likeness 0,
where no more than a quarter could agree.  Equal texts have equal fingerprints.  Rows with equal doc_id
are ordered by the rest of the row; rows with a null doc_id come last.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import U64, counted_bytes, mix

K, S = 12, 4
SHORT, SHORT_K, SHORT_S = 64, 4, 2   # texts below SHORT letters have anchors of SHORT_K letters only
BOTH = 4 * SHORT                 # texts below BOTH letters have anchors of SHORT_K letters too
LEAST = 64                       # anchors of a text with few below BELOW
BELOW = 1 << 29                  # hashes of 32 bits: one anchor in eight, about 28 for 1000 letters
SEGMENT = 1 << 18
RANGE_BYTES = 16 << 20           # bytes of text that make one range of ids
MAX_RANGES = 20_000              # ranges stream from disk, so larger ones cost no memory
_HASH_BYTES = 4


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` (a power of two or a sum of doubling steps) consecutive values."""
    out, done, span, part = None, 0, 1, x
    rest = size
    n = len(x) - size + 1
    while rest:
        if rest & 1:
            out = part[:n] if out is None else mix(out * U64(0x9E3779B97F4A7C15) + part[done: done + n])
            done += span
        rest >>= 1
        if rest:
            part = mix(part[:-span] * U64(0xC2B2AE3D27D4EB4F) + part[span:])
            span *= 2
    return out


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values, by doubling."""
    span, m = 1, x
    while 2 * span <= size:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return m if span == size else np.minimum(m[: len(x) - size + 1], m[size - span: size - span + len(x) - size + 1])


def _segment_anchors(x: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    inner = _runs(x, s)                               # len(x) - s + 1 inner hashes
    w, m = k - s + 1, len(x) - k + 1
    least = _window_min(inner, w)                     # of the inner hashes of each k-mer
    at = np.flatnonzero((inner[:m] == least) | (inner[w - 1: w - 1 + m] == least))
    # the k-mer's own hash from three inner ones that cover it
    h = mix(inner[at] * U64(0xD6E8FEB86659FD93) + mix(inner[at + s] * U64(0xA24BAED4963EE407) + inner[at + k - s]))
    return h, at


def anchors(text: str, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, position)`` of every closed syncmer, in order; of the shorter ones, if ``short`` asks for
    them or the text has no others.  Anchors know no context, so a long
    text is worked off in segments that overlap by k - 1."""
    n = len(text)
    k, s = (K, S) if n >= SHORT and not short else (SHORT_K, SHORT_S)
    if n < k:
        if not n:
            return np.empty(0, U64), np.empty(0, np.int64)
        x = mix(mix(code_points(text).astype(U64) + U64(1)) + np.arange(n, dtype=U64))
        return mix(x.sum(keepdims=True) + U64(n)), np.zeros(1, np.int64)
    parts = []
    for a in range(0, n - k + 1, SEGMENT):
        x = mix(code_points(text[a: a + SEGMENT + k - 1]).astype(U64) + U64(1))
        h, at = _segment_anchors(x, k, s)
        parts.append((h, at + a))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def sketch(h: np.ndarray, at: np.ndarray) -> str:
    """The anchors below BELOW, or the LEAST smallest if they are more, by (hash, position), in hexadecimal.  The j-th place of a hash
    counts as an anchor of its own, so a text that repeats itself is sampled like any other."""
    order = np.argsort(h, kind="stable")
    sh = h[order]
    new = np.ones(len(h), bool)
    new[1:] = sh[1:] != sh[:-1]
    first = np.flatnonzero(new)
    times = np.arange(len(h)) - first[np.cumsum(new) - 1]
    h = np.empty_like(h)
    h[order] = mix(sh + times.astype(U64) * U64(0x9E3779B97F4A7C15))
    h = (h >> U64(64 - 8 * _HASH_BYTES)).astype(np.int64)
    size = max(LEAST, int(np.count_nonzero(h < BELOW)))
    if len(h) > size:
        cut = h[np.argpartition(h, size)[:size]].max()
        keep = np.flatnonzero(h <= cut)
        h, at = h[keep], at[keep]
    order = np.lexsort((at, h))[:size]
    return np.stack([h[order], at[order]], axis=1).astype(">u4").tobytes().hex()


def listed(text: str, h: np.ndarray, at: np.ndarray) -> str:
    """The fingerprint of a text from its ``anchors``: the longer ones, a slash, the shorter ones."""
    if not text or len(text) >= BOTH:
        return sketch(h, at)
    return f"{sketch(h, at)}/{sketch(*anchors(text, short=True))}" if len(text) >= SHORT else f"/{sketch(h, at)}"


def fingerprint(text: str | None) -> str:
    return listed(text or "", *anchors(text or ""))


def edited_sketch(text: str, h: np.ndarray, at: np.ndarray, edited: str, same: int) -> str:
    """The fingerprint of ``edited``, whose first ``same`` letters are those of ``text``: anchors of
    the common part are kept and only the rest is read again."""
    start = same - K + 1
    if len(edited) - start < SHORT or start < 0:
        return fingerprint(edited)
    keep = at + K <= same
    th, ta = anchors(edited[start:])
    return listed(edited, np.concatenate([h[keep], th]), np.concatenate([at[keep], ta + start]))


def _read(fp: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fp), ">u4").astype(np.int64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def likeness(a: str, b: str) -> float:
    """Share of anchors matched at agreeing positions, from two fingerprints (0 to 1)."""
    if a == b:
        return 1.0
    a, _, short_a = a.partition("/")
    b, _, short_b = b.partition("/")
    if not a or not b:
        a, b = short_a, short_b
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    (ha, pa_), (hb, pb) = _read(a), _read(b)
    bound = min(max(int(x[-1]), BELOW - 1) if len(x) >= LEAST else 1 << 32 for x in (ha, hb))
    na, nb = int(np.searchsorted(ha, bound, "right")), int(np.searchsorted(hb, bound, "right"))
    ha, pa_, hb, pb = ha[:na], pa_[:na], hb[:nb], pb[:nb]
    first = np.searchsorted(hb, ha, "left")
    times = np.searchsorted(hb, ha, "right") - first
    i = np.repeat(np.arange(na), times)
    if not len(i):
        return 0.0
    j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + first[i]
    _, back, votes = np.unique(pa_[i] - pb[j], return_inverse=True, return_counts=True)
    ok = votes[back] >= (2 if min(na, nb) >= 4 else 1)
    return min(len(np.unique(i[ok])), len(np.unique(j[ok]))) / max(na, nb)


# ----------------------------------------------------------------- operators
def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for every row."""
    def run(batches):
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([fingerprint(t) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id bigint, n_chars bigint, fingerprint string")


_PAIR_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double")


def _walk_ranges(batches):
    """Rows of a range in descending order, each with the row after it.  The rows marked ``look`` come
    last in a range: the first of them follows the range's last row, and none is a result."""
    names = [x.split()[0] for x in _PAIR_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows: list[tuple] = []

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        rows.clear()
        return out

    held = None
    for b in batches:
        for r, i, t, look in zip(*(b.column(k) for k in range(4))):
            r, text, look = r.as_py(), t.as_py() or "", look.as_py()
            if look and held is None:
                continue
            h, at = anchors(text)
            fp = listed(text, h, at)
            if held is not None and held[0] == r:
                _, doc, own, oh, oat, ofp = held
                cut = len(own) // 3
                edited = own[: len(own) - cut] + text[:cut]
                efp = edited_sketch(own, oh, oat, edited, len(own) - cut)
                rows.append((doc, len(own), hashlib.sha256(edited.encode()).hexdigest(), ofp, efp,
                             likeness(ofp, efp), likeness(ofp, fp)))
                if len(rows) >= 512:
                    yield batch()
            held = None if look else (r, i.as_py(), text, h, at, fp)
    if rows:
        yield batch()


def _range_of(bounds: list[int]):
    """How many of the sorted ``bounds`` lie below ``id``, by two scans of about their square root."""
    col, width = F.col("id"), max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i: i + width] for i in range(0, len(bounds), width)] or [[]]
    def longs(v):
        return F.array(*(F.lit(x).cast("bigint") for x in v)) if v else F.array().cast("array<bigint>")
    below = F.size(F.filter(longs([g[0] for g in groups if g]), lambda x: x < col))     # groups begun below id
    inner = F.element_at(F.array(*(longs(g) for g in groups)), F.greatest(below, F.lit(1)))
    return F.greatest(below - 1, F.lit(0)) * width + F.size(F.filter(inner, lambda x: x < col))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see the module's rules."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranges, null_ranges = (min(MAX_RANGES, max(least, counted_bytes(rows, "text") // RANGE_BYTES))
                           for least, rows in ((8, docs), (1, docs.where("id is null"))))
    docs = docs.withColumn("h", F.xxhash64("text"))
    # descending order: range 0 holds the largest ids, nulls come last; at most one row per range
    # (a bound, a first id) reaches the driver
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = [int(x) for x in sorted(set(docs.where("id is not null").approxQuantile("id", cuts, 0.2 / ranges)))]
    # rows without an id stand in order of the hash of their text, and are cut by it
    by_hash = F.floor((F.col("h") / float(1 << 63) + 1) / 2 * null_ranges)
    by_hash = F.least(F.lit(null_ranges - 1), by_hash) + (len(bounds) + 1)
    at = F.when(F.col("id").isNull(), by_hash).otherwise(len(bounds) - _range_of(bounds))
    keyed = docs.select(at.cast("int").alias("range"), "id", "h", "text")
    # the first row of a range: the largest id, and of its rows the least hash
    first = F.max(F.struct("id", F.bitwise_not("h").alias("h")))
    firsts = sorted((r["range"], r["first"]["id"], ~r["first"]["h"]) for r in keyed.groupBy("range").agg(first.alias("first")).collect())
    heads = spark.createDataFrame([(r, i, h, firsts[k - 1][0]) for k, (r, i, h) in enumerate(firsts)],   # the very first closes the last range
                                  "range int, first bigint, first_h bigint, before int")
    own = F.struct(F.col("range").alias("r"), F.lit(0).alias("look"))
    ahead = F.struct(F.col("before").alias("r"), F.lit(1).alias("look"))
    moved = (keyed.join(F.broadcast(heads), "range")
             .select(F.explode(F.when(F.col("id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h")), F.array(own, ahead)).otherwise(F.array(own))).alias("x"),
                     "id", "h", "text"))
    return (moved.select("x.r", "id", "text", "x.look", "h").repartitionById(len(bounds) + 1 + null_ranges, "r")
            .sortWithinPartitions("r", "look", F.col("id").desc_nulls_last(), "h", "text").drop("h")
            .mapInArrow(_walk_ranges, _PAIR_SCHEMA))
