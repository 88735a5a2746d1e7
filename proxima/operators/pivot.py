"""Exact kNN join with a tree of pivots and triangle-inequality pruning.

For two sides too large to broadcast, the block join compares every test block with every
train block.  Here the work follows the data instead (the pivot-based kNN join for MapReduce,
Lu, Shen, Chen, Ooi, VLDB 2012, with two levels of pivots):

1. About ``P = 2 sqrt(n)`` pivots are taken from the train side: rows below a hash threshold that leaves a few more than
   P, and of those the P of least hash.  The first ``sqrt(P)`` are centres, and each pivot belongs to its nearest one.
2. Every row is compared with the centres and with the pivots of the nearest one, ``2 sqrt(P)`` distances, and belongs
   to the *part* of the nearest of these.  Any part would do: results rest on the distance to the pivot alone.  Test rows
   are written with it, and the test rows of a part are cut at quantiles of the distance into *rings*, so a few far rows widen
   only their own ring.
3. The k least distances of train rows to their own pivot, part by part, bound the k-th neighbour of every pivot: a row at
   distance x from pivot j is within ``d(i, j) + x`` of pivot i.  The bound takes these over the parts of the same centre,
   and over all parts by way of the centres.
4. For a test row q of part i, ``d(q, r) <= d(q, p_i) + d(p_i, r)``, so every q of a ring with distances in [lo, hi] has k train
   rows within ``theta = hi + bound_i``; and ``d(q, r) >= |d(r, p_i) - d(q, p_i)|``, so a train row r is sent to the ring
   only if ``lo - theta <= d(r, p_i) <= hi + theta``.  A centre whose pivots, by its distance and radius, all fail that
   is skipped without looking at them.  A small relative slack covers rounding (it can only add candidates).  Rows without a
   finite distance are never neighbours and are dropped; a test row that is not finite meets none.
5. Each ring is split into test sub-blocks x train sub-blocks of bounded size (a ring holding a
   third of the rows is split like any other), the block kernel keeps k per test row and
   sub-block, and a window merges the train sub-blocks.

For narrow vectors (``TREE_DIM``) far test rows would make steps 3 and 4 send them everything: distance to one pivot says nothing
of direction.  There train rows are written once with their part, the box around each part is known, and the k nearest rows of a
bounded sample of the train side bound every test row's k-th neighbour.  A test row travels to the parts whose box is within
that bound, which on average hold few rows; step 5 follows, and a window merges the parts.

A task holds the tree and one chunk of distances, whatever n is; distances to pivots are used chunk by chunk and never
kept.  Only the pivots, one row of statistics per ring and ``P x k`` distances reach the driver; their number is
bounded by ``PIVOT_BYTES``.  Whether pruning pays is judged on a bounded sample of train (by boxes: of test) rows, with the true
bounds, and the block join takes over if not: that decides the plan, never the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from proxima.operators.candidates import TEST_F, TEST_ID, TRAIN_F, TRAIN_ID, tail_of
from proxima.operators.topk import check_k, top_k
from proxima.operators.boxes import FAN, GROUP, TREE_DIM, BoxTree, arrays, close_runs, gaps, least_copies
from proxima.operators.vectorized import (BOUND_ROWS, CHUNK_CELLS, HELD_QUERIES, NEIGHBOUR_SCHEMA, block_kernel, distance_block, gathered,
                                          hashed_sample, int_ids, matrix)
from proxima.session import send, written

SLACK = 1e-9  # relative widening of the pruning bounds, far above double rounding error

# Fall back to the block join when the sample says that the pruned plan would still compare more
# than this share of all pairs (high-dimensional data separates poorly around pivots).
FALLBACK_SHARE = 0.5
SAMPLE_ROWS = 2000
PIVOT_BYTES = 8 << 20                # of pivot vectors, or of their k distances
RING_QUANTILES = (0.5, 0.9, 0.99)    # a part's rings: near half, and three shells around it
RINGS = len(RING_QUANTILES) + 1
SENT_ROWS = 1 << 15                  # train rows that one Arrow batch sends


def pivot_count(n_train: int, dim: int = 1, k: int = 1) -> int:
    """About 2 sqrt(n) pivots, at least 2, as long as what the driver gets of each stays within PIVOT_BYTES."""
    room = max(2, PIVOT_BYTES // (8 * max(dim, k, 1)))
    return int(min(n_train, max(2, min(room, math.ceil(2 * math.sqrt(max(n_train, 1)))))))


# ----------------------------------------------------------------- the tree
def chunked_distances(x: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first row, end row, distances to all points)`` in chunks of bounded size; the array is used again."""
    p, points_t = len(points), np.ascontiguousarray(points.T)
    step = max(1, min(len(x), CHUNK_CELLS // max(p, 1)))
    out, tmp = np.empty((step, p)), np.empty((step, p))
    for s in range(0, len(x), step):
        e = min(len(x), s + step)
        yield s, e, distance_block(x[s:e], points_t, out[: e - s], tmp[: e - s])


def nearest_point(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``points`` for every row and its distance (NaN, or infinite, for rows that are not finite)."""
    at, d = np.zeros(len(x), np.int64), np.full(len(x), np.nan)
    for s, e, dist in chunked_distances(x, points):
        at[s:e] = np.argmin(dist, axis=1)                      # of NaN the first
        d[s:e] = dist[np.arange(e - s), at[s:e]]
    return at, d


@dataclass(frozen=True)
class PivotTree:
    """Pivots in order of their centre: centre g has ``pivots[starts[g]:starts[g + 1]]``, all within ``radius[g]``."""
    pivots: np.ndarray
    centres: np.ndarray
    starts: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray) -> PivotTree:
        pivots = pivots[np.sort(np.unique(pivots, axis=0, return_index=True)[1])]      # copies would fill one centre
        centres = pivots[: max(1, math.isqrt(len(pivots)))]
        group, d = nearest_point(pivots, centres)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(len(centres) + 1))
        radius = np.zeros(len(centres))
        np.maximum.at(radius, group, d)
        return cls(pivots[order], centres, starts, radius)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(part, distance to its pivot)`` of every row; part -1 and 0 for a row that is not finite."""
        part, dist = np.full(len(x), -1, np.int32), np.zeros(len(x))
        group, near = nearest_point(x, self.centres)
        fine = np.flatnonzero(np.isfinite(near))
        fine = fine[np.argsort(group[fine], kind="stable")]
        cut = np.searchsorted(group[fine], np.arange(len(self.centres) + 1))
        for g in np.flatnonzero(np.diff(cut)):
            rows = fine[cut[g]: cut[g + 1]]
            if self.starts[g] == self.starts[g + 1]:           # a copy of an earlier centre
                continue
            at, d = nearest_point(x[rows], self.pivots[self.starts[g]: self.starts[g + 1]])
            ok = np.isfinite(d)
            part[rows[ok]], dist[rows[ok]] = (at + self.starts[g])[ok], d[ok]
        return part, dist

    def bounds(self, parts: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
        """Per pivot a distance within which k train rows lie, infinite if fewer are given: ``dist`` are the least
        distances of the train rows of the parts ``parts`` to their pivots."""
        order = np.lexsort((dist, parts))
        parts, dist = parts[order], dist[order]
        edge = np.searchsorted(parts, self.starts)             # rows of every centre's pivots
        out, tops = np.full(len(self.pivots), np.inf), []
        for g, centre in enumerate(self.centres):
            a, b = self.starts[g], self.starts[g + 1]
            rows = slice(edge[g], edge[g + 1])
            if edge[g + 1] > edge[g]:
                from_centre = _distances(centre[None, :], self.pivots[a:b])[0]
                tops.append((g, np.sort(from_centre[parts[rows] - a] + dist[rows])[:k]))
                if edge[g + 1] - edge[g] >= k:
                    for s, e, d in chunked_distances(self.pivots[a:b], self.pivots[a:b]):
                        step = max(1, CHUNK_CELLS // (edge[g + 1] - edge[g]))
                        for i in range(s, e, step):
                            reach = d[i - s: min(i + step, e) - s][:, parts[rows] - a] + dist[rows]
                            out[a + i: a + min(i + step, e)] = np.partition(reach, k - 1, axis=1)[:, k - 1]
        owner = np.concatenate([np.full(len(v), g) for g, v in tops]) if tops else np.empty(0, np.int64)
        value = np.concatenate([v for _, v in tops]) if tops else np.empty(0)
        if len(value) >= k:                                    # by way of the centres
            for g, centre in enumerate(self.centres):
                a, b = self.starts[g], self.starts[g + 1]
                if b > a:
                    top = np.partition(_distances(centre[None, :], self.centres)[0][owner] + value, k - 1)[k - 1]
                    out[a:b] = np.minimum(out[a:b], _distances(centre[None, :], self.pivots[a:b])[0] + top)
        return out

    def cells(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(row, cell)`` of every ring that may need a row: ``lo[ring, pivot] <= distance <= hi[ring, pivot]``."""
        least = np.array([lo[:, a:b].min(initial=np.inf) for a, b in zip(self.starts, self.starts[1:])])
        most = np.array([hi[:, a:b].max(initial=-np.inf) for a, b in zip(self.starts, self.starts[1:])])
        for s, e, near in chunked_distances(x, self.centres):
            wide = (near + self.radius) * (1 + SLACK) + SLACK >= least
            wide &= (near - self.radius) * (1 - SLACK) - SLACK <= most          # False for NaN
            for g in np.flatnonzero(wide.any(axis=0)):
                rows = np.flatnonzero(wide[:, g]) + s
                a, b = self.starts[g], self.starts[g + 1]
                for p, q, d in chunked_distances(x[rows], self.pivots[a:b]):
                    for ring in range(RINGS):
                        i, j = np.nonzero((d >= lo[ring, a:b]) & (d <= hi[ring, a:b]))
                        if len(i):
                            yield rows[p + i], (j + a) * RINGS + ring


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return distance_block(a, np.ascontiguousarray(b.T), np.empty((len(a), len(b))), np.empty((len(a), len(b))))


# ----------------------------------------------------------------- Spark
def assign_rows(rows: DataFrame, id_col: str, feat_col: str, tree_bc, dim: int) -> DataFrame:
    """``id, features, part, dq``: the part and the distance to its pivot."""
    def run(batches):
        tree = PivotTree(*tree_bc.value)
        for batch in batches:
            part, dq = tree.assign(matrix(batch.column(1), dim))
            yield pa.record_batch({id_col: batch.column(0), feat_col: batch.column(1),
                                   "part": pa.array(part, pa.int32()), "dq": pa.array(dq, pa.float64())})

    return rows.select(id_col, feat_col).mapInArrow(
        run, f"{id_col} bigint, {feat_col} array<double>, part int, dq double")


def in_rings(assigned: DataFrame, n_piv: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """``assigned`` with the ``cell`` (part and ring) of each row; and per cell the rows, and their least and largest
    distance to the pivot (NaN where there are none)."""
    # one row per part (its ring bounds), joined back to cut the rings
    quantiles = assigned.groupBy("part").agg(F.percentile_approx("dq", list(RING_QUANTILES), 10_000).alias("q"))
    ringed = (assigned.join(F.broadcast(quantiles), "part")  # at most P rows
              .withColumn("cell", (F.col("part") * RINGS + F.size(F.filter("q", lambda b: b < F.col("dq")))).cast("int")))
    stats = ringed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dq").alias("lo"), F.max("dq").alias("hi")).toArrow()
    count, near, far = np.zeros(n_piv * RINGS, np.int64), np.full(n_piv * RINGS, np.nan), np.full(n_piv * RINGS, np.nan)
    at = stats.column("cell").to_numpy()
    for into, name in ((count, "n"), (near, "lo"), (far, "hi")):
        into[at] = stats.column(name).to_numpy()
    return ringed, count, near, far


def nearest_of_parts(train: DataFrame, tree_bc, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(part, distance)``: the k least distances of train rows to their pivot, for every part."""
    def run(batches):
        tree = PivotTree(*tree_bc.value)
        for batch in batches:
            part, d = tree.assign(matrix(batch.column(0), dim))
            ok = np.flatnonzero(part >= 0)
            order = ok[np.lexsort((d[ok], part[ok]))]
            part, d = part[order], d[order]
            starts = np.searchsorted(part, part)                # of the run that a row is in
            keep = np.arange(len(part)) - starts < k
            yield pa.record_batch({"part": pa.array(part[keep], pa.int32()), "d": pa.array(d[keep], pa.float64())})

    rank = F.row_number().over(Window.partitionBy("part").orderBy("d"))
    got = (train.select(TRAIN_F).mapInArrow(run, "part int, d double")
           .withColumn("_n", rank).where(F.col("_n") <= k).select("part", "d").toArrow())
    return got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy()


def send_train(train: DataFrame, tree_bc, reach_bc, dim: int) -> DataFrame:
    """``train_id, train_features, label (or rows), cell`` once per ring the row may serve.

    ``reach``: per ring (row) and pivot (column), the least and the largest distance to the pivot
    that may matter; an empty interval for a ring without test rows.
    """
    tail = tail_of(train)

    def run(batches):
        tree, (lo, hi) = PivotTree(*tree_bc.value), reach_bc.value
        for batch in batches:
            held, size = [], 0

            def out():
                row = pa.array(np.concatenate([h[0] for h in held]), pa.int64())
                cell = np.concatenate([h[1] for h in held])
                return pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns), pa.array(cell, pa.int32())],
                                                  names=[TRAIN_ID, TRAIN_F, tail, "cell"])
            for row, cell in tree.cells(matrix(batch.column(1), dim), lo, hi):
                for s in range(0, len(row), SENT_ROWS):
                    held.append((row[s: s + SENT_ROWS], cell[s: s + SENT_ROWS]))
                    size += len(held[-1][0])
                    if size >= SENT_ROWS:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()

    schema = train.select(TRAIN_ID, TRAIN_F, tail).schema
    return train.select(TRAIN_ID, TRAIN_F, tail).mapInArrow(run, schema.add("cell", IntegerType()))


def reach_of(near: np.ndarray, far: np.ndarray, bound: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest useful distance of a train row to each pivot, per ring.  ``near`` and ``far``
    (ring x pivot) are the least and largest test distance of a ring, NaN without test rows."""
    theta = np.minimum(far + bound, limit)
    some = ~np.isnan(near)
    with np.errstate(invalid="ignore"):                        # infinite bounds stay infinite
        lo = near - theta
        lo = np.where(some, lo - SLACK * np.abs(lo) - SLACK, np.inf)
        hi = np.where(some, (far + theta) * (1 + SLACK) + SLACK, -np.inf)
    return lo, hi


def sampled_share(tree: PivotTree, sample: np.ndarray, lo: np.ndarray, hi: np.ndarray, count: np.ndarray) -> float:
    """Estimated share of all pairs that the pruned plan compares: ``count`` test rows per cell against the
    cells that a sample of train rows is sent to."""
    pairs = sum(int(count[cell].sum()) for _, cell in tree.cells(sample, lo, hi))
    return pairs / max(1, int(count.sum()) * len(sample))


def neighbours_pivot(test: DataFrame, train: DataFrame, k: int, dim: int, n_train: int, n_test: int,
                     block_bytes: int, partitions: int,
                     max_distance: float | None = None, fallback=None) -> DataFrame:
    """Neighbours of every test row (``test_id, rank, train_id, distance, label``), exactly.

    ``fallback`` (a function returning the block-join plan) is used instead when a sample says that
    the pruned plan would compare more than ``FALLBACK_SHARE`` of all pairs.
    """
    check_k(k)
    spark = test.sparkSession
    row_bytes = 8 * dim + 32
    limit = float("inf") if max_distance is None else float(max_distance)
    pivots = hashed_sample(train, TRAIN_ID, TRAIN_F, dim, pivot_count(n_train, dim, k), n_train)
    if pivots.shape[0] == 0:  # no finite train row: nobody has a neighbour
        return spark.createDataFrame([], NEIGHBOUR_SCHEMA)
    tree = PivotTree.of(pivots)
    n_piv = len(tree.pivots)
    tree_bc = send(spark, arrays(tree))
    if 0 < dim <= TREE_DIM:
        return _by_boxes(test, train, k, dim, n_train, n_test, block_bytes, partitions, limit, tree_bc, n_piv, fallback)

    ringed, count, near, far = in_rings(written(assign_rows(test, TEST_ID, TEST_F, tree_bc, dim), "pivot-test").where("part >= 0"), n_piv)
    cells = n_piv * RINGS
    bound = tree.bounds(*nearest_of_parts(train, tree_bc, dim, k), k)
    by_ring = [v.reshape(-1, RINGS).T for v in (near, far)]
    lo, hi = reach_of(*by_ring, bound, limit)
    if fallback is not None:
        sample = hashed_sample(train, TRAIN_ID, TRAIN_F, dim, SAMPLE_ROWS, n_train)
        if sampled_share(tree, sample, lo, hi, count) > FALLBACK_SHARE:
            return fallback()
    sent = written(send_train(train, tree_bc, send(spark, (lo, hi)), dim), "pivot-train")
    got = sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    arrived = np.zeros(cells, np.int64)
    arrived[got.column("cell").to_numpy()] = got.column("n").to_numpy()

    per_block, one = by_cells(ringed, sent, count, arrived, [TRAIN_ID, TRAIN_F, tail_of(train)], row_bytes, block_bytes, partitions,
                              block_kernel(k, dim, limit), NEIGHBOUR_SCHEMA)
    if one:
        return per_block  # every test row met all its candidates in one group
    return top_k(per_block.drop("rank"), k)


def part_rows(train: DataFrame, tree_bc, dim: int, k: int) -> DataFrame:
    """``train_id, train_features, label (or rows), cell``: train rows with their part; of equal vectors in a batch the ``k`` of
    least id, and no row that is not finite."""
    tail = tail_of(train)

    def run(batches):
        tree = PivotTree(*tree_bc.value)
        for batch in batches:
            x = matrix(batch.column(1), dim)
            rows = least_copies(x, int_ids(batch.column(0)), k)
            part, _ = tree.assign(x[rows])
            rows, part = rows[part >= 0], part[part >= 0]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(part, pa.int32())],
                                             names=[TRAIN_ID, TRAIN_F, tail, "cell"])

    rows = train.select(TRAIN_ID, TRAIN_F, tail)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType())]))


def needed_boxes(x: np.ndarray, boxes: BoxTree, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, box)``: the boxes within ``reach`` (squared) of finite rows in the order of ``close_runs``."""
    for s in range(0, len(x), GROUP):
        g = x[s: s + GROUP]
        at = boxes.within(g.min(axis=0), g.max(axis=0), reach[s: s + GROUP].max())
        for i in range(0, len(at), SENT_ROWS // GROUP):
            some = at[i: i + SENT_ROWS // GROUP]
            near = gaps(g.T[:, :, None], g.T[:, :, None], boxes.low[:, None, some], boxes.high[:, None, some]) <= reach[s: s + GROUP, None]
            row, box = np.nonzero(near)
            yield row + s, some[box]


def _by_boxes(test: DataFrame, train: DataFrame, k: int, dim: int, n_train: int, n_test: int, block_bytes: int, partitions: int,
              limit: float, tree_bc, n_piv: int, fallback) -> DataFrame:
    """The pivot join of narrow vectors: train rows stay in their part, of which the box is known, and test rows travel."""
    spark = test.sparkSession
    sent = written(part_rows(train, tree_bc, dim, k), "pivot-train")
    ends = [f(F.col(TRAIN_F)[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(dim)]
    got = sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).toArrow()      # one row per part
    part = got.column("cell").to_numpy()
    low, high = (np.array([got.column(f"{name}{j}").to_numpy() for j in range(dim)]) for name in ("low", "high"))
    arrived = np.zeros(n_piv, np.int64)
    arrived[part] = got.column("n").to_numpy()
    order = close_runs((low / 2 + high / 2).T, FAN)
    part, boxes = part[order], BoxTree.of_boxes(low[:, order], high[:, order])
    sample = hashed_sample(train, TRAIN_ID, TRAIN_F, dim, min(n_train, BOUND_ROWS), n_train)
    known = BoxTree.of(sample, np.arange(len(sample)), k)
    if fallback is not None:
        some = hashed_sample(test, TEST_ID, TEST_F, dim, SAMPLE_ROWS, n_test)
        some = some[close_runs(some, GROUP)]
        pairs = sum(int(arrived[part[box]].sum()) for _, box in needed_boxes(some, boxes, known.kth_reach(some, k, limit)))
        if pairs > FALLBACK_SHARE * max(1, len(some)) * max(1, int(arrived.sum())):
            return fallback()
    told = send(spark, (arrays(known), arrays(boxes), part))

    def run(batches):
        known, boxes, part = BoxTree(*told.value[0]), BoxTree(*told.value[1]), told.value[2]
        for table in gathered(batches, HELD_QUERIES):
            batch = table.combine_chunks()
            x = matrix(batch.column(1), dim)
            rows = np.flatnonzero(np.isfinite(x).all(axis=1))
            rows = rows[close_runs(x[rows], GROUP)]
            x = x[rows]
            held, size = [], 0

            def out():
                row, cell = (np.concatenate(v) for v in zip(*held))
                return pa.table([*(c.take(pa.array(rows[row], pa.int64())) for c in batch.columns), pa.array(part[cell], pa.int32())],
                                names=[TEST_ID, TEST_F, "cell"]).to_batches()
            for row, cell in needed_boxes(x, boxes, known.kth_reach(x, k, limit)):
                held.append((row, cell))
                size += len(row)
                if size >= SENT_ROWS:
                    yield from out()
                    held, size = [], 0
            if held:
                yield from out()

    rows = test.select(TEST_ID, TEST_F)
    if rows.rdd.getNumPartitions() < partitions:                 # the search is the work, not the rows
        rows = rows.repartition(partitions)
    asked = written(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType())])), "pivot-test")
    got = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    count = np.zeros(n_piv, np.int64)
    count[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    per_block, _ = by_cells(asked, sent, count, arrived, [TRAIN_ID, TRAIN_F, tail_of(train)], 8 * dim + 32, block_bytes, partitions,
                            block_kernel(k, dim, limit), NEIGHBOUR_SCHEMA)
    return top_k(per_block.drop("rank"), k)


def by_cells(test: DataFrame, train: DataFrame, tests: np.ndarray, trains: np.ndarray, train_cols: list[str], row_bytes: int,
             block_bytes: int, partitions: int, kernel, schema: str, test_cols: tuple[str, ...] = (TEST_ID, TEST_F)) -> tuple[DataFrame, bool]:
    """``kernel`` over the test and train rows of each ``cell``, split into sub-blocks of bounded size on both sides;
    and whether every cell's train rows are one sub-block.  ``tests`` and ``trains`` count the rows of each cell."""
    used = np.flatnonzero(tests)
    s_blocks, r_blocks = (np.maximum(1, -(-v[used] * row_bytes // block_bytes)) for v in (tests, trains))
    sizes = F.broadcast(test.sparkSession.createDataFrame(pa.table({
        "cell": pa.array(used, pa.int32()), "_s": pa.array(s_blocks, pa.int64()), "_r": pa.array(r_blocks, pa.int64())})))   # one row per cell
    t = (test.join(sizes, "cell")
         .select(*test_cols, "cell", F.pmod(F.xxhash64(TEST_ID), F.col("_s")).alias("sb"),
                 F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_r") - 1)).alias("rb")))
    r = (train.join(sizes, "cell")
         .select(*train_cols, "cell", F.pmod(F.xxhash64(TRAIN_ID), F.col("_r")).alias("rb"),
                 F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_s") - 1)).alias("sb")))
    keys = ["cell", "sb", "rb"]
    # bytes that move decide the number of tasks: about two blocks each
    moved = row_bytes * int((tests[used] * r_blocks + trains[used] * s_blocks).sum())
    n = max(1, min(int((s_blocks * r_blocks).sum()), max(partitions, math.ceil(moved / (2 * block_bytes)))))
    out = (t.repartition(n, *keys).groupBy(*keys)
           .cogroup(r.repartition(n, *keys).groupBy(*keys)).applyInArrow(kernel, schema))
    return out, bool((r_blocks == 1).all())
