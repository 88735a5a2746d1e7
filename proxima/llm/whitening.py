"""Whitening of embeddings from exact integer covariances.

1. Every entry becomes the integer ``floor(64 * c) + 1000000``; the distinct integer vectors are the fit list.
2. Shifted by the least value of its dimension, an entry needs a few bits.  A task packs each bit of each
   dimension across its rows into 64-bit words.  The sum of products of two dimensions is the
   sum, over pairs of their bits, of ``2^(a+b)`` times the set bits of the AND of the two planes.  Sums are
   exact, so they do not depend on how rows are dealt.
3. The width**2 sums reach the driver, are centred as integers (``n * sum(xy) - sum(x) * sum(y)``), divided once by
   n**2, and handed to ``eigh``.
4. Each row is centred by its exact ``n * x - S``, projected on the components, and scaled.

Rules.  Vectors that are null or hold null or non-finite entries have no result, nor have those whose
length is not the most common one (the smaller, if two are).  ``64 * c`` beyond 2**40 counts as that bound.
Repeated rows are all returned and fitted once.  ``deviation`` is null where it does not fit a long.  A
component without variance (fewer distinct vectors than dimensions, equal entries) has a null ``whitened`` and
takes no part in ``identity_error``, which is 0 if none has any.  Extra columns are ignored.  Without a usable vector there are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import U64, written

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)         # of 64 * c, so that sums of products fit 38 digits
PACKED_ROWS = 1 << 13            # rows whose bits are packed at once
FLAT = 1e-13                     # share of the largest eigenvalue that counts as no variance
COMPONENTS = 16


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums`` per dimension; ``vectors[:, k]`` is component k + 1."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def flat(self) -> np.ndarray:
        """Components without variance."""
        return ~(self.values > FLAT * max(float(self.values.max(initial=0.0)), 0.0))


def integers(vector: Column) -> Column:
    """The integer vector, null if the vector is null, empty or holds null or non-finite entries."""
    c = vector.cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(c, lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x * SCALE))) + F.lit(SHIFT).cast("bigint"))
    return F.when((F.size(c) > 0) & ~bad, whole)


def int_matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), dim)


# ----------------------------------------------------------------- bit planes
def planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """One row of 64-bit words per bit of every column of ``y`` (non-negative), in column order."""
    n = len(y)
    out = np.zeros((sum(bits), -(-n // 64)), U64)
    raw, at = out.view(np.uint8), 0
    for j, b in enumerate(bits):
        for a in range(b):
            packed = np.packbits(((y[:, j] >> a) & 1).astype(np.uint8))
            raw[at, : len(packed)] = packed
            at += 1
    return out


def add_counts(counts: np.ndarray, p: np.ndarray) -> None:
    """Adds to ``counts[i, j]``, j >= i, the rows that have both bit i and bit j."""
    for i in range(len(p)):
        counts[i, i:] += np.bitwise_count(p[i] & p[i:]).sum(axis=1, dtype=np.int64)


def weighted(counts: np.ndarray, bits: list[int]) -> list[int]:
    """Sums of products of columns i <= j, row by row, from the counts of their bits."""
    full = np.triu(counts) + np.triu(counts, 1).T
    edge = np.concatenate([[0], np.cumsum(bits)])
    out = []
    for i in range(len(bits)):
        for j in range(i, len(bits)):
            part = full[edge[i]: edge[i + 1], edge[j]: edge[j + 1]]
            out.append(sum(int(v) << (a + b) for (a, b), v in np.ndenumerate(part) if v))
    return out


def products(fit: DataFrame, low: list[int], bits: list[int]) -> list[int]:
    """Exact sums of ``y_i * y_j`` over the rows of ``fit`` (``x``), where ``y = x - low``."""
    dim = len(low)

    def run(batches):
        counts = np.zeros((sum(bits), sum(bits)), np.int64)
        for batch in batches:
            y = int_matrix(batch.column(0), dim) - np.array(low, np.int64)
            for s in range(0, len(y), PACKED_ROWS):
                add_counts(counts, planes(y[s: s + PACKED_ROWS], bits))
        yield pa.RecordBatch.from_arrays([pa.array([weighted(counts, bits)], pa.list_(pa.decimal128(38, 0)))], names=["sums"])
    parts = fit.select("x").mapInArrow(run, "sums array<decimal(38,0)>")
    rows = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    return [int(v) for _, v in sorted((r["at"], r["v"]) for r in rows)]


# ----------------------------------------------------------------- the fit
def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of a frame ``x`` of distinct integer vectors of one length; None if it is empty."""
    stats = sorted(tuple(r) for r in fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
    if not stats:
        return None
    n, dim = int(stats[0][1]), len(stats)
    sums, low = [int(r[2]) for r in stats], [int(r[3]) for r in stats]
    bits = [(int(r[4]) - int(r[3])).bit_length() for r in stats]
    y_sums = [s - n * a for s, a in zip(sums, low)]
    v = np.zeros((dim, dim))
    found = iter(products(fit, low, bits))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * next(found) - y_sums[i] * y_sums[j]) / (n * n)      # integers until here
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    return Whitening(n, sums, np.maximum(e[order], 0.0), np.ascontiguousarray(u[:, order]), float(np.trace(v)))


def deviations(x: np.ndarray, w: Whitening) -> np.ndarray:
    """``n * x - S`` exactly: int64, or Python integers where they would not fit."""
    near = [round(s / w.n) if w.n else 0 for s in w.sums]
    rest = [s - w.n * c for s, c in zip(w.sums, near)]
    d = x - np.array(near, np.int64)
    if w.n * int(np.abs(d).max(initial=0)) + max(map(abs, rest), default=0) < 1 << 62:
        return w.n * d - np.array(rest, np.int64)
    return w.n * d.astype(object) - np.array(rest, object)


def squares(dev: np.ndarray) -> pa.Array:
    """Row sums of squares as longs, null beyond."""
    top = int(np.abs(dev).max(initial=0)) if dev.size else 0
    if top * top * max(1, dev.shape[1]) < 1 << 63:
        d = dev.astype(np.int64)
        return pa.array((d * d).sum(axis=1), pa.int64())
    d = dev.astype(object)
    return pa.array([v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()], pa.int64())


def projected(dev: np.ndarray, w: Whitening) -> np.ndarray:
    """Whitened rows; NaN in components without variance."""
    centred = (dev / w.n).astype(np.float64)
    scale = np.where(w.flat, np.nan, np.sqrt(np.where(w.flat, 1.0, w.values)))
    return centred @ w.vectors / scale


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    dim, use = len(w.sums), np.flatnonzero(~w.flat)
    k = len(use)
    if not k:
        return 0.0

    def run(batches):
        sums, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = projected(deviations(int_matrix(batch.column(0), dim), w), w)[:, use]
            sums += z.sum(axis=0)
            cross += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sums, cross.reshape(-1)])], pa.list_(pa.float64()))], names=["sums"])
    rows = fit.select("x").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    got = np.array([v for _, v in sorted((r["at"], r["v"]) for r in rows)]) / w.n
    mean, cross = got[:k], got[k:].reshape(k, k)
    return float(np.abs(cross - np.outer(mean, mean) - np.eye(k)).max())


# ----------------------------------------------------------------- the operator
def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), integers(F.col(vec_col)).alias("x")).where("x is not null"), "integers")
    widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == widths["w"])
    fit = written(rows.select("x").distinct(), "fit-list")
    w = fitted(fit, components)
    error = identity_error(fit, w)
    dim, k = len(w.sums), len(w.values)
    share = w.values / w.trace if w.trace > 0 else np.zeros(k)

    def run(batches):
        for batch in batches:
            dev = deviations(int_matrix(batch.column(1), dim), w)
            z, m = projected(dev, w).reshape(-1), len(dev)
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, w.n), pa.int64()),
                 squares(dev).take(row), pa.array(z, pa.float64(), mask=np.isnan(z)), pa.array(np.tile(share, m), pa.float64()),
                 pa.array(np.full(m * k, error), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.select("vec_id", "x").mapInArrow(run, schema)
