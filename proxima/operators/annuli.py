"""Range counts, nearest and farthest distances by rings around pivots, without all pairs.

Train rows belong to the parts and rings of a pivot tree (``operators/pivot.py``); of a ring only the number of its rows
and their least and largest distance to the pivot, ``lo`` and ``hi``, are told to the tasks.  For a test row at distance D
from that pivot every row of the ring lies between ``max(D - hi, lo - D, 0)`` and ``D + hi``:

* a ring wholly inside ``max_distance`` is counted without a distance, one wholly outside not at all;
* one row of the ring lies within ``D + lo``, so a ring whose lower bound is above the least of these cannot hold the nearest;
* one row lies beyond ``hi - D`` and ``D - lo``, so a ring whose upper bound is below the largest of these cannot hold the
  farthest.

Test rows travel only to the rings that are left over, one copy each, and the block kernel gives the exact statistics
there.  A relative slack covers rounding; it can only add rings.  Rows without a finite distance to a pivot go through the
block plan of ``vectorized.pair_stats``, and so does everything when a sample of test rows says that more than
``FALLBACK_SHARE`` of all pairs would be left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.operators import vectorized as V
from proxima.operators.candidates import TEST_F, TEST_ID, TRAIN_F, TRAIN_ID
from proxima.operators.boxes import arrays
from proxima.operators.pivot import (FALLBACK_SHARE, RINGS, SAMPLE_ROWS, SLACK, PivotTree, assign_rows, by_cells, chunked_distances,
                                     hashed_sample, in_rings, pivot_count)
from proxima.session import send, written

COUNT, ENDS, FINITE = 1, 2, 4        # what a test row wants of a ring: its admissible rows, nearest and farthest, its finite rows
OVERFLOW = 1e153                     # distances beyond may be infinite once squared


def ring_needs(x: np.ndarray, tree: PivotTree, count: np.ndarray, lo: np.ndarray, hi: np.ndarray, bound: float):
    """Per chunk of finite test rows ``(first row, row, cell, wants, rows inside the bound, finite rows)``; the last two per
    row of the chunk, of the rings that need not be looked at for them.  ``count``, ``lo`` and ``hi`` are per cell."""
    rings = [(count[r::RINGS], lo[r::RINGS], hi[r::RINGS]) for r in range(RINGS)]
    for s, e, d in chunked_distances(x, tree.pivots):
        nearest, farthest = np.full(e - s, np.inf), np.full(e - s, -np.inf)
        for _, a, b in rings:
            nearest = np.fmin(nearest, np.fmin.reduce(d + a, axis=1))
            farthest = np.fmax(farthest, np.fmax.reduce(np.maximum(b - d, d - a), axis=1))
        inside, finite = np.zeros(e - s, np.int64), np.zeros(e - s, np.int64)
        rows, cells, wants = [], [], []
        for r, (m, a, b) in enumerate(rings):
            top, some = d + b, m > 0
            slack = SLACK * top + SLACK
            low = np.maximum(np.maximum(d - b, a - d), 0.0)
            sure = top + slack < bound
            want = COUNT * (~sure & (low - slack < bound))
            want |= ENDS * ((low - slack <= nearest[:, None]) | (top + slack >= farthest[:, None]))
            want |= FINITE * (top > OVERFLOW)
            want *= some
            inside += (sure * m).sum(axis=1)
            finite += ((top <= OVERFLOW) * m).sum(axis=1)
            i, j = np.nonzero(want)
            rows.append(i)
            cells.append(j * RINGS + r)
            wants.append(want[i, j])
        yield s, *(np.concatenate(v) for v in (rows, cells, wants)), inside, finite


def _stats_rows(ids, n, low, high, first, last, inside, finite) -> pa.RecordBatch:
    cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), low, high, pa.array(np.full(len(ids), first[0]), pa.int64()), pa.array(first[1]),
            pa.array(np.full(len(ids), last[0]), pa.int64()), pa.array(last[1]), pa.array(inside, pa.int64()), pa.array(finite, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in V.STATS_SCHEMA.split(", ")])


def pair_stats_annuli(test: DataFrame, train: DataFrame, dim: int, n_train: int, block_bytes: int, partitions: int,
                      max_distance: float | None = None, fallback: bool = False, report: dict | None = None) -> DataFrame:
    """``test_id, n, min_d, max_d, first_d, last_d, n_admissible, n_finite`` of every test row, as ``vectorized.pair_stats``.

    With ``fallback`` the block plan is used where rings leave most pairs over.  ``report`` gets the number of
    ``pairs`` whose distances are computed, and of ``all`` pairs.
    """
    spark = test.sparkSession
    bound = math.inf if max_distance is None else float(max_distance)
    row_bytes = 8 * dim + 32

    def by_blocks(t, r):
        n, m = (max(1, -(-x.count() * row_bytes // block_bytes)) for x in (t, r))
        return V.pair_stats_parts(t, r, dim, n, m, max_distance, max(1, min(n * m, partitions)))
    pivots = hashed_sample(train, TRAIN_ID, TRAIN_F, dim, pivot_count(n_train, dim), n_train)
    if not len(pivots):
        return V.merged_stats(by_blocks(test, train))
    tree = PivotTree.of(pivots)
    tree_bc = send(spark, arrays(tree))
    placed = written(assign_rows(train, TRAIN_ID, TRAIN_F, tree_bc, dim), "annuli-train")
    ringed, count, lo, hi = in_rings(placed.where("part >= 0"), len(tree.pivots))
    if fallback:
        sample = hashed_sample(test, TEST_ID, TEST_F, dim, SAMPLE_ROWS, max(1, test.count()))
        left = sum(int(count[c].sum()) for _, _, c, _, _, _ in ring_needs(sample, tree, count, lo, hi, bound))
        if left > FALLBACK_SHARE * max(1, len(sample)) * max(1, int(count.sum())):
            return V.merged_stats(by_blocks(test, train))

    # what every test row needs: its base statistics, and a copy for each ring that is left
    ends = placed.where("part >= 0").agg(*(f(F.struct(TRAIN_ID, TRAIN_F)) for f in (F.min, F.max))).first()
    known = send(spark, (arrays(tree), count, lo, hi, [(r[TRAIN_ID], np.array(r[TRAIN_F], float)) for r in ends]))

    def needs(batches):
        tree, count, lo, hi, ((first, fx), (last, lx)) = known.value
        tree = PivotTree(*tree)
        total = int(count.sum())
        for batch in batches:
            x = V.matrix(batch.column(1), dim)
            ids = V.int_ids(batch.column(0))
            fine = np.flatnonzero(tree.assign(x)[0] >= 0)
            odd = np.setdiff1d(np.arange(len(x)), fine)
            if len(odd):                                # for the block plan
                yield _needed(batch, odd, np.full(len(odd), -2), np.zeros(len(odd), np.int64))
            for s, row, cell, want, inside, finite in ring_needs(x[fine], tree, count, lo, hi, bound):
                part = fine[s: s + len(inside)]
                d = [V.pair_distances(x, v[:, None], part, np.zeros(len(part), np.int64)) for v in (fx, lx)]
                yield _needed(batch, part, np.full(len(part), -1), np.zeros(len(part), np.int64), np.stack([inside, finite]), d, (total, first, last))
                for a in range(0, len(row), 1 << 15):
                    yield _needed(batch, part[row[a: a + (1 << 15)]], cell[a: a + (1 << 15)], want[a: a + (1 << 15)])
    names = V.STATS_SCHEMA.replace("test_id bigint, ", "")
    found = written(test.select(TEST_ID, TEST_F).mapInArrow(needs, f"{TEST_ID} bigint, {TEST_F} array<double>, cell int, want int, {names}"), "annuli-needs")
    counts = found.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    tests, at = np.zeros(len(count), np.int64), counts.column("cell").to_numpy()
    tests[at[at >= 0]] = counts.column("n").to_numpy()[at >= 0]
    odd, bad = int(counts.column("n").to_numpy()[at == -2].sum()), n_train - int(count.sum())
    if report is not None:
        tested = int(counts.column("n").to_numpy()[at < 0].sum())
        report |= {"pairs": int((tests * count).sum()) + odd * int(count.sum()) + bad * tested, "all": tested * n_train}

    def kernel(left, right):
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.Table.from_batches([], schema=V._STATS_ARROW)
        got = V.block_stats(V.int_ids(left.column(TEST_ID)), V.matrix(left.column(TEST_F), dim), V.int_ids(right.column(TRAIN_ID)),
                            V.matrix(right.column(TRAIN_F), dim), bound)
        want = left.column("want").to_numpy()
        for bit, name in ((COUNT, "n_admissible"), (FINITE, "n_finite"), (0, "n")):
            kept = np.where(want & bit, got.column(name).to_numpy(), 0)
            got = got.set_column(got.column_names.index(name), name, pa.array(kept, pa.int64()))
        return got
    parts = found.where("cell = -1").select(TEST_ID, *(c.split()[0] for c in names.split(", ")))
    if tests.any():
        parts = parts.unionByName(by_cells(found.where("cell >= 0"), ringed, tests, count, [TRAIN_ID, TRAIN_F], row_bytes, block_bytes, partitions,
                                           kernel, V.STATS_SCHEMA, (TEST_ID, TEST_F, "want"))[0])
    if odd:
        parts = parts.unionByName(by_blocks(found.where("cell = -2").select(TEST_ID, TEST_F), placed.where("part >= 0")))
    if bad:
        parts = parts.unionByName(by_blocks(test, placed.where("part < 0")))
    return V.merged_stats(parts)


def _needed(batch, row, cell, want, sums=None, d=None, told=None) -> pa.RecordBatch:
    """Rows ``test_id, test_features, cell, want`` and, for base rows, statistics without distances of their own."""
    at, n = pa.array(row), len(row)
    empty = pa.nulls(n, pa.float64())
    if sums is None:
        stats = [pa.nulls(n, t) for t in V._STATS_ARROW.types[1:]]
    else:
        total, first, last = told
        stats = _stats_rows(np.zeros(n), np.full(n, total), empty, empty, (first, d[0]), (last, d[1]), *sums).columns[1:]
    feats = batch.column(1).take(at) if sums is None else pa.nulls(n, batch.column(1).type)
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), feats, pa.array(cell, pa.int32()), pa.array(want, pa.int32()), *stats],
                                      names=[TEST_ID, TEST_F, "cell", "want", *V._STATS_ARROW.names[1:]])
