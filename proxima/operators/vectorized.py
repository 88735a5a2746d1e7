"""Vectorised top-k: distances and selection in NumPy inside Spark tasks.

Spark still partitions and shuffles the work; NumPy only replaces the per-pair rows.  Instead
of materialising one row per (test, train) pair and sorting them, a task holds a block of each
side as matrices, computes the distance block chunk by chunk, and emits at most k rows per
test row.  Three shapes:

* ``neighbours_broadcast_train`` -- ``mapInArrow`` over the test side with the (size-checked)
  train matrix in a broadcast variable: map-only, no shuffle at all (but many narrow test rows are first dealt by where they lie).
* ``neighbours_broadcast_test``  -- ``mapInArrow`` over the train side with the (size-checked)
  test matrix broadcast; each task keeps a running top-k per test row, then one window merges
  the per-task winners.
* ``neighbours_blocks``          -- neither side broadcast: both hashed into blocks, replicated
  over the block grid, grouped by block pair with ``cogroup().applyInArrow``; a group holds one
  block of each side, so its size is bounded by the block sizes.

Distances are added left to right over the dimensions, exactly like the column expression, so
both paths return bit-identical distances and the same neighbours on ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from proxima.operators.boxes import GROUP, TREE_DIM, BoxTree, arrays, cell_of, close_runs, least_copies, median_cuts
from proxima.operators.candidates import (ROWS, TEST_F, TEST_ID, TRAIN_F, TRAIN_ID, block_rows, spread,
                                          tail_of)
from proxima.operators.topk import check_k, top_k
from proxima.session import send

NEIGHBOUR_SCHEMA = "test_id bigint, rank int, train_id bigint, distance double, label double"
PREDICTION_SCHEMA = "test_id bigint, prediction int"

# Cells of one distance chunk (rows x columns); 2^22 doubles = 32 MiB per buffer.
CHUNK_CELLS = 1 << 22

# From this width on a matrix product says first which pairs cannot matter (``near_squares``).
FILTER_DIM = 16
QUERY_ROWS = 1 << 13             # wide test rows of a block searched at a time
GROUPS_PER_NEIGHBOUR = 16        # minima of so many groups of columns for each of the k bound the k-th
DENSE_SHARE = 0.125              # of a chunk's pairs left: beyond, the whole chunk is computed exactly
UNIT = 2.0 ** -53                # rounding unit of a double
LARGEST_SQUARE = 1e300           # vectors with a larger norm are left to the plain kernel

# Narrow vectors (up to ``TREE_DIM``) are searched by boxes (``operators/boxes.py``).
TREE_ROWS = 1024                 # fewer train rows are compared one by one
TREE_PAIRS = 1 << 20             # as are fewer pairs
HELD_QUERIES = 1 << 16           # queries of a task searched together: the more, the closer they lie
HELD_WINNERS = 1 << 20           # winners of those, at most
HELD_TRAIN = 1 << 18             # train rows of a task searched together
BOUND_ROWS = 1 << 16             # train rows in a sample that bounds the k-th distance of every test row


# --------------------------------------------------------------------------- numpy kernels

def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list<double> Arrow column as an (n, dim) float64 matrix (NULL elements become NaN)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.empty((0, dim), dtype=np.float64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if flat.size != n * dim:
        raise ValueError(f"vectors do not all have {dim} values")
    return np.asarray(flat, dtype=np.float64).reshape(n, dim)


def int_ids(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Row ids as int64, never through floating point (a NULL id raised before it came here)."""
    if col.null_count:
        raise ValueError("a row id is NULL")
    return col.cast(pa.int64()).to_numpy()


def distance_block(q: np.ndarray, r_t: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows of ``q`` (m, d) and columns of ``r_t`` (d, n).

    The squares are added one dimension at a time, starting from zero, which is the left-to-right
    order of the SQL expression: the results are bit-identical to it.
    """
    out.fill(0.0)
    for j in range(q.shape[1]):
        np.subtract(q[:, j:j + 1], r_t[j:j + 1, :], out=tmp)
        np.multiply(tmp, tmp, out=tmp)
        out += tmp
    np.sqrt(out, out=out)
    return out


def pair_distances(q: np.ndarray, r_t: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Distances of single pairs, with the operations and the order of ``distance_block``."""
    out = np.empty(qi.size)
    step = max(1, CHUNK_CELLS // max(1, q.shape[1]))
    for s in range(0, qi.size, step):
        a, b = qi[s:s + step], ri[s:s + step]
        total = np.zeros(a.size)
        for j in range(q.shape[1]):
            diff = q[a, j] - r_t[j, b]
            total += diff * diff
        out[s:s + step] = np.sqrt(total)
    return out


def near_squares(q: np.ndarray, qn: np.ndarray, r_t: np.ndarray, rn: np.ndarray, out: np.ndarray):
    """Squared distances by ``|q|^2 + |r|^2 - 2 q.r`` into ``out``, and per row of ``q`` a bound of their error.

    The bound covers the rounding of this formula and of the left-to-right sum of squares.  With u the
    rounding unit and N = |q|^2 + |r|^2: a dot product of d terms, in any order, is off by at most
    d u |q||r| (1 + d u), a norm by d u of itself, the two additions by 2 u of at most 2 N: in all less than
    (2 d + 5) u N.  The sum of squares is off by (d + 2) u of at most 2 N.  Eight times d and 32 more units is
    over both together.  It also exceeds what underflow can lose.
    """
    np.matmul(q, r_t, out=out)
    out *= -2.0
    out += rn
    out += qn[:, None]
    return out, (8 * q.shape[1] + 32) * UNIT * (qn + rn.max()) + 1e-290


def filterable(q: np.ndarray, r: np.ndarray):
    """Norms of both sides if the filter may be used: wide vectors, all finite and none huge."""
    if q.shape[1] < FILTER_DIM or not q.size or not r.size:
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        qn, rn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
    return (qn, rn) if max(qn.max(), rn.max()) < LARGEST_SQUARE else None     # False for NaN


def kth_bound(s: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that at least ``k`` of its entries do not exceed: the k-th least of the minima of
    equal groups of columns, or of all columns where they are few."""
    n = s.shape[1]
    groups = GROUPS_PER_NEIGHBOUR * k
    size = n // groups
    if size >= 4:
        s = s[:, :groups * size].reshape(len(s), groups, size).min(axis=2)
    return np.partition(s, k - 1, axis=1)[:, k - 1]


def filtered_pairs(s: np.ndarray, err: np.ndarray, k: int, bound: float):
    """Which pairs of a chunk may be among the ``k`` nearest below ``bound``, ties of the rounded root included."""
    top = (kth_bound(s, k) + err if s.shape[1] > k else np.full(len(s), np.inf))
    top = np.minimum(top, bound * bound) if bound < 1e150 else top
    return s <= (top * (1 + 16 * UNIT) + err)[:, None]


def rank_cut(qi: np.ndarray, d: np.ndarray, rid: np.ndarray, k: int):
    """Order candidates by (query, distance, train id), rank them within each query, keep <= k.

    Returns (order, rank) where ``order`` indexes the kept candidates in output order.
    """
    if qi.size == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    order = np.lexsort((rid, d, qi))
    q_sorted = qi[order]
    first = np.empty(q_sorted.size, dtype=bool)
    first[0] = True
    np.not_equal(q_sorted[1:], q_sorted[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, q_sorted.size))
    rank = np.arange(q_sorted.size) - np.repeat(starts, lengths) + 1
    keep = rank <= k
    return order[keep], rank[keep].astype(np.int32)


def tree_topk(q: np.ndarray, tree: BoxTree, k: int, bound: float):
    """``block_topk`` by boxes."""
    rows = np.flatnonzero(np.isfinite(q).all(axis=1))
    rows = rows[close_runs(q[rows], GROUP)]
    found = [(rows[qi], tree.rows[at], d) for qi, at, d in tree.search(q[rows], k, bound)]
    if not found:
        e = np.empty(0, dtype=np.int64)
        return e, e.copy(), np.empty(0)
    return tuple(np.concatenate(v) for v in zip(*found))


def block_topk(q: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int, bound: float, tree: BoxTree | None = None):
    """Per row of ``q``, its k nearest rows of ``r`` by (distance, train id).

    Returns (query index, train index, distance), at most k entries per query row, unordered.
    Inadmissible distances (NaN, infinite, >= bound) are never returned.

    Ties are cut exactly without gathering them: every candidate strictly closer than the row's
    k-th smallest distance is kept, and of those at exactly that distance only the lowest ids
    needed to reach k (the block is scanned in id order).  A block where a third of the rows
    are copies of one vector therefore still yields k entries per row, not a third of the
    block.

    Wide vectors go through ``near_squares`` first: only pairs that a proven bound cannot rule out get their
    exact distance.  The result is the same, bit by bit.  So it is by boxes, for narrow vectors: ``tree`` holds the rows of
    ``r``, or is made here if there are many pairs.
    """
    m, n = q.shape[0], r.shape[0]
    if tree is None and 0 < q.shape[1] <= TREE_DIM and n >= TREE_ROWS and m * n >= TREE_PAIRS:
        tree = BoxTree.of(r, r_ids, k)
    if tree is not None:
        return tree_topk(q, tree, k, bound)
    qs, rs, ds = [], [], []
    if m == 0 or n == 0:
        e = np.empty(0, dtype=np.int64)
        return e, e.copy(), np.empty(0)
    by_id = np.argsort(r_ids, kind="stable")
    if (by_id[1:] < by_id[:-1]).any():
        r = r[by_id]
    norms = filterable(q, r)
    r_t, whole = r.T, None           # the filter reads the rows where they lie; only whole chunks need a copy by dimension
    step = max(1, min(m, CHUNK_CELLS // n))
    out = np.empty((step, n))
    tmp = None
    for s in range(0, m, step):
        e = min(m, s + step)
        if norms:
            near, err = near_squares(q[s:e], norms[0][s:e], r_t, norms[1], out[: e - s])
            left = filtered_pairs(near, err, k, bound)
            if np.count_nonzero(left) <= DENSE_SHARE * left.size:
                qi, ri = np.nonzero(left)
                d = pair_distances(q[s:e], r_t, qi, ri)
                ok = np.flatnonzero(d < bound)
                keep = ok[rank_cut(qi[ok], d[ok], r_ids[by_id[ri[ok]]], k)[0]]
                qs.append(qi[keep] + s)
                rs.append(by_id[ri[keep]])
                ds.append(d[keep])
                continue
        if whole is None:
            whole, tmp = np.ascontiguousarray(r_t), np.empty((step, n))
        dist = distance_block(q[s:e], whole, out[: e - s], tmp[: e - s])
        ok = dist < bound  # False for NaN
        dist = np.where(ok, dist, np.inf)
        if n > k:
            kth = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
            mask = dist < kth
            need = k - mask.sum(axis=1, keepdims=True)
            tie = (dist == kth) & ok
            mask |= tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= need)
        else:
            mask = ok
        qi, ri = np.nonzero(mask)
        qs.append(qi + s)
        rs.append(by_id[ri])
        ds.append(dist[qi, ri])
    return np.concatenate(qs), np.concatenate(rs), np.concatenate(ds)


def label_arrays(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Labels as float64 plus a validity mask: NULL stays missing, apart from a NaN label."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = col.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    valid = np.asarray(col.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    return values, valid


def train_block(ids: pa.Array, features: pa.Array, tail: pa.Array, dim: int) -> dict:
    """Arrays of train rows, or of the entries of ``operators/entries.py``: ``tail`` is the label column,
    or the rows (id, label) that share the vector, in order of id."""
    out = {"x": matrix(features, dim), "ids": int_ids(ids)}
    if isinstance(tail, pa.ChunkedArray):
        tail = tail.combine_chunks()
    if pa.types.is_list(tail.type):
        out["starts"] = np.concatenate([[0], np.cumsum(tail.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        rows = tail.flatten()
        out["row_ids"] = int_ids(rows.field(0))
        out["labels"], out["valid"] = label_arrays(rows.field(1))
    else:
        out["labels"], out["valid"] = label_arrays(tail)
    return out


def in_id_order(tr: dict) -> dict:
    """A ``train_block`` in order of id (entries as they are)."""
    if "starts" in tr or not (tr["ids"][1:] < tr["ids"][:-1]).any():
        return tr
    order = np.argsort(tr["ids"], kind="stable")
    return {name: v[order] for name, v in tr.items()}


def train_rows(tr: dict, qi: np.ndarray, ri: np.ndarray, d: np.ndarray, k: int):
    """``(query, train id, distance, row of the labels)``: entries as their rows, cut to the ``k`` nearest, in order."""
    if "starts" in tr:
        n = tr["starts"][ri + 1] - tr["starts"][ri]
        row = np.repeat(tr["starts"][ri] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        qi, d, ids = np.repeat(qi, n), np.repeat(d, n), tr["row_ids"][row]
    else:
        row, ids = ri, tr["ids"][ri]
    order, _ = rank_cut(qi, d, ids, k)
    return qi[order], ids[order], d[order], row[order]


def winners(q: np.ndarray, tr: dict, k: int, bound: float):
    """``(query index, train id, distance, label, label valid)`` of the k nearest train rows of every query, in
    order of (query, distance, id).

    The k nearest entries hold the k nearest rows: an entry left out has k before it, each with a row that
    comes before all of its own.  Queries with equal vectors are searched once.
    """
    one, back = q, None
    if len(q) > 1 and q.shape[1]:
        _, first, same = np.unique(np.ascontiguousarray(q).view(np.dtype((np.void, 8 * q.shape[1]))).reshape(-1),
                                   return_index=True, return_inverse=True)
        if len(first) <= 0.9 * len(q):
            one, back = q[first], same.reshape(-1)
    qi, ids, d, row = train_rows(tr, *block_topk(one, tr["x"], tr["ids"], k, bound, tr.get("tree")), k)
    if back is not None:                              # every copy of a query gets its winners
        edge = np.searchsorted(qi, np.arange(len(one) + 1))
        n = (edge[1:] - edge[:-1])[back]
        at = np.repeat(edge[:-1][back] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        qi, ids, d, row = np.repeat(np.arange(len(q)), n), ids[at], d[at], row[at]
    return qi, ids, d, tr["labels"][row], tr["valid"][row]


def neighbours_table(q_ids, qi, ids, d, labels, valid) -> pa.Table:
    """The rows of ``winners`` with their rank."""
    starts = np.searchsorted(qi, np.arange(len(q_ids)))
    return pa.table({
        "test_id": pa.array(q_ids[qi], pa.int64()),
        "rank": pa.array((np.arange(len(qi)) - starts[qi] + 1).astype(np.int32), pa.int32()),
        "train_id": pa.array(ids, pa.int64()),
        "distance": pa.array(d, pa.float64()),
        "label": pa.array(labels, pa.float64(), mask=~valid),
    })


def vote_arrays(q_ids: np.ndarray, qi: np.ndarray, labels: np.ndarray, vote: str,
                valid: np.ndarray | None = None) -> pa.Table:
    """Predictions for every query row from its kept neighbours (NULL when it has none).

    Neighbours with a NULL label (``valid`` False) do not vote, as ``count(label)`` skips them
    in the SQL form; a NaN label counts as non-zero there and here.
    """
    m = q_ids.size
    if valid is not None:
        qi, labels = qi[valid], labels[valid]
    n = np.bincount(qi, minlength=m)
    if vote == "nonzero_majority":
        zeros = np.bincount(qi, weights=(labels == 0).astype(np.float64), minlength=m)
        pred = (n - zeros >= zeros).astype(np.int32)
    else:
        if labels.size and not np.all(labels == np.floor(labels)):
            raise ValueError("label_sum needs whole-number labels")
        total = np.bincount(qi, weights=labels, minlength=m)
        pred = (2 * total > n).astype(np.int32)
    return pa.table({"test_id": pa.array(q_ids, pa.int64()),
                     "prediction": pa.array(pred, pa.int32(), mask=n == 0)})


# --------------------------------------------------------------------------- Spark plans

def collect_side(df: DataFrame, id_col: str, feat_col: str, dim: int, tail: str | None = None, k: int | None = None):
    """Arrays of a side that the caller has size-checked, for a broadcast variable; with ``k`` a train side of narrow
    vectors comes as a tree of boxes."""
    tbl = df.select(*([id_col, feat_col] + ([tail] if tail else []))).toArrow()
    if tail:
        side = train_block(tbl.column(0), tbl.column(1), tbl.column(2), dim)
        if k and 0 < dim <= TREE_DIM and len(side["ids"]) >= TREE_ROWS:
            side |= {"tree": arrays(BoxTree.of(side["x"], side["ids"], k)), "x": side["x"][:0]}
            return side
        return in_id_order(side)                                 # once here, so that no task sorts a copy of its own
    return {"ids": int_ids(tbl.column(0)), "x": matrix(tbl.column(1), dim)}


def hashed_sample(df: DataFrame, id_col: str, feat_col: str, dim: int, count: int, n: int) -> np.ndarray:
    """``count`` finite vectors of the ``n`` rows, those of least id hash (fewer if there are not so many).

    A threshold that passes about twice as many leaves little to sort; it is widened while too few pass.
    """
    finite = ~F.exists(F.col(feat_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(feat_col).isNotNull() & finite).select(F.xxhash64(id_col).alias("_h"), id_col, feat_col)
    share = (2 * count + 64) / max(n, 1)
    while True:
        some = rows if share >= 1 else rows.where(F.col("_h") < F.lit(int(-(1 << 63) + share * (1 << 64))))
        got = some.orderBy("_h", id_col).limit(count).select(feat_col).toArrow()
        if got.num_rows >= count or share >= 1:
            return matrix(got.column(0), dim)
        share *= 8


def gathered(batches, rows: int):
    """Arrow batches joined to tables of at least ``rows`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def close_together(test: DataFrame, dim: int, n_test: int, partitions: int) -> DataFrame:
    """Narrow test rows over ``partitions`` tasks, such that rows which follow each other in a task lie close together.

    A task searches ``HELD_QUERIES`` rows at a time.  Of rows in any order these lie everywhere, however many there are, and a
    group of them meets train rows in proportion to the train side; of rows dealt like this a group meets a bounded number.
    Rows are cut by cell and id, so that any number of copies is spread.
    """
    cuts = send(test.sparkSession, median_cuts(hashed_sample(test, TEST_ID, TEST_F, dim, min(n_test, BOUND_ROWS), n_test)))

    def run(batches):
        for batch in batches:
            cell = cell_of(matrix(batch.column(1), dim), cuts.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[TEST_ID, TEST_F, "_cell"])

    rows = test.select(TEST_ID, TEST_F)
    celled = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_cell", IntegerType())]))
    return celled.repartitionByRange(partitions, "_cell", TEST_ID).sortWithinPartitions("_cell").drop("_cell")


def neighbours_broadcast_train(test: DataFrame, train: DataFrame, k: int, dim: int,
                               max_distance: float | None = None, vote: str | None = None,
                               partitions: int | None = None, n_test: int | None = None) -> DataFrame:
    """Map-only kNN: the size-checked train matrix is broadcast, test rows stay in place.

    With ``vote`` the task also votes, returning ``test_id, prediction`` for every test row
    (NULL when none is admissible); otherwise neighbours.  Narrow test rows, if ``n_test`` says that they are more than one
    task searches at a time, are first dealt by where they lie (``close_together``).
    """
    check_k(k)
    spark = test.sparkSession
    side = collect_side(train, TRAIN_ID, TRAIN_F, dim, tail_of(train), k)
    bc = send(spark, side)
    bound = float("inf") if max_distance is None else float(max_distance)
    if "tree" in side and (n_test or 0) > HELD_QUERIES:
        t = close_together(test, dim, n_test, partitions or max(2 * spark.sparkContext.defaultParallelism, -(-n_test // HELD_QUERIES)))
    else:
        t = spread(test.select(TEST_ID, TEST_F), partitions)

    def run(batches):
        tr = bc.value
        if "tree" in tr:
            tr = tr | {"tree": BoxTree(*tr["tree"])}
            batches = gathered(batches, max(1, min(HELD_QUERIES, HELD_WINNERS // k)))
        for batch in batches:
            q_ids = int_ids(batch.column(0))
            q = matrix(batch.column(1), dim)
            qi, ids, d, labels, valid = winners(q, tr, k, bound)
            tbl = (neighbours_table(q_ids, qi, ids, d, labels, valid) if vote is None
                   else vote_arrays(q_ids, qi, labels, vote, valid))
            yield from tbl.to_batches()

    return t.mapInArrow(run, PREDICTION_SCHEMA if vote else NEIGHBOUR_SCHEMA)


def neighbours_broadcast_test(test: DataFrame, train: DataFrame, k: int, dim: int,
                              max_distance: float | None = None,
                              partitions: int | None = None, slices: int = 1, n_train: int | None = None) -> DataFrame:
    """The size-checked test matrix is broadcast; each train task keeps a running top-k per
    test row, and a window then merges at most k rows per test row and task.

    A side over the limit is broadcast in ``slices``, by hash of the id.  Narrow vectors go by boxes if ``n_train``
    train rows are many: the k nearest of a bounded sample bound each test row's k-th distance, train rows are dealt by the
    nearest of the sample's regions, and a task answers only for test rows that it can serve.
    """
    check_k(k)
    bound = float("inf") if max_distance is None else float(max_distance)
    parts = [test if slices == 1 else test.where(F.pmod(F.xxhash64(TEST_ID), F.lit(slices).cast("bigint")) == i) for i in range(slices)]
    if 0 < dim <= TREE_DIM and (n_train or 0) >= TREE_ROWS:
        partials = _test_boxes(parts, train, k, dim, bound, partitions, n_train)
    else:
        r = spread(train.select(TRAIN_ID, TRAIN_F, tail_of(train)), partitions)
        partials = [_test_partial(part, r, k, dim, bound) for part in parts]
    out = partials[0]
    for more in partials[1:]:
        out = out.unionByName(more)
    return top_k(out, k)


PARTIAL_SCHEMA = "test_id bigint, train_id bigint, distance double, label double"


def _test_partial(test: DataFrame, r: DataFrame, k: int, dim: int, bound: float) -> DataFrame:
    side = collect_side(test, TEST_ID, TEST_F, dim)
    bc = send(test.sparkSession, side)

    def run(batches):
        ts = bc.value
        q_ids, q = ts["ids"], ts["x"]
        best = None  # (qi, train ids, distances, labels, label valid) of the running top-k
        for batch in batches:
            cand = winners(q, train_block(batch.column(0), batch.column(1), batch.column(2), dim), k, bound)
            if best is not None:
                cand = tuple(np.concatenate([a, b]) for a, b in zip(best, cand))
            order, _ = rank_cut(cand[0], cand[2], cand[1], k)
            best = tuple(a[order] for a in cand)
        if best is not None and best[0].size:
            order, rank = rank_cut(best[0], best[2], best[1], k)
            yield pa.record_batch({
                "test_id": pa.array(q_ids[best[0][order]], pa.int64()),
                "train_id": pa.array(best[1][order], pa.int64()),
                "distance": pa.array(best[2][order], pa.float64()),
                "label": pa.array(best[3][order], pa.float64(), mask=~best[4][order]),
            })

    return r.mapInArrow(run, PARTIAL_SCHEMA)


def _test_boxes(tests: list[DataFrame], train: DataFrame, k: int, dim: int, bound: float, partitions: int | None,
                n_train: int) -> list[DataFrame]:
    """The winners of every train task for the test rows within its reach, per slice of the test side."""
    spark, tail = train.sparkSession, tail_of(train)
    tasks = partitions or 2 * spark.sparkContext.defaultParallelism
    sample = hashed_sample(train, TRAIN_ID, TRAIN_F, dim, min(n_train, BOUND_ROWS), n_train)
    if not len(sample):                                  # no finite train row
        return [spark.createDataFrame([], PARTIAL_SCHEMA)]
    known_bc = send(spark, arrays(BoxTree.of(sample, np.arange(len(sample)), k)))
    run_rows = -(-len(sample) // (4 * tasks))
    near = sample[close_runs(sample, run_rows)]
    centres = np.array([near[s: s + run_rows].mean(axis=0) for s in range(0, len(near), run_rows)])

    def deal(batches):
        points, out, tmp = np.ascontiguousarray(centres.T), None, None
        for batch in batches:
            x = matrix(batch.column(1), dim)
            rows = least_copies(x, int_ids(batch.column(0)), k)
            at = np.empty(len(rows), np.int32)
            step = max(1, CHUNK_CELLS // len(centres))
            for s in range(0, len(rows), step):
                q = x[rows[s: s + step]]
                if out is None or len(out) < len(q):
                    out, tmp = np.empty((len(q), len(centres))), np.empty((len(q), len(centres)))
                at[s: s + step] = np.argmin(distance_block(q, points, out[: len(q)], tmp[: len(q)]), axis=1)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(at, pa.int32())],
                                             names=[TRAIN_ID, TRAIN_F, tail, "_region"])

    def reach(batches):
        known = BoxTree(*known_bc.value)
        for table in gathered(batches, HELD_QUERIES):
            x = matrix(table.column(1), dim)
            rows = np.flatnonzero(np.isfinite(x).all(axis=1))
            rows = rows[close_runs(x[rows], GROUP)]
            yield from pa.table({TEST_ID: table.column(0).take(pa.array(rows, pa.int64())), TEST_F: table.column(1).take(pa.array(rows, pa.int64())),
                                 "_reach": pa.array(known.kth_reach(x[rows], k, bound), pa.float64())}).to_batches()

    r = spread(train.select(TRAIN_ID, TRAIN_F, tail), partitions)
    r = r.mapInArrow(deal, StructType([*r.schema.fields, StructField("_region", IntegerType())])).repartition(tasks, "_region").drop("_region")
    return [_boxes_partial(t.select(TEST_ID, TEST_F).repartition(tasks).mapInArrow(
        reach, f"{TEST_ID} bigint, {TEST_F} array<double>, _reach double"), r, k, dim, bound) for t in tests]


def _boxes_partial(test: DataFrame, r: DataFrame, k: int, dim: int, bound: float) -> DataFrame:
    tbl = test.toArrow()
    side = {"ids": int_ids(tbl.column(0)), "x": matrix(tbl.column(1), dim), "reach": tbl.column(2).to_numpy()}
    order = close_runs(side["x"], GROUP)
    bc = send(r.sparkSession, {name: v[order] for name, v in side.items()})

    def run(batches):
        ts = bc.value
        for table in gathered(batches, HELD_TRAIN):
            tr = train_block(table.column(0), table.column(1), table.column(2), dim)
            tree = BoxTree.of(tr["x"], tr["ids"], k)
            for qi, at, d in tree.search(ts["x"], k, bound, ts["reach"]):
                qi, ids, d, row = train_rows(tr, qi, tree.rows[at], d, k)
                yield from pa.table({
                    "test_id": pa.array(ts["ids"][qi], pa.int64()),
                    "train_id": pa.array(ids, pa.int64()),
                    "distance": pa.array(d, pa.float64()),
                    "label": pa.array(tr["labels"][row], pa.float64(), mask=~tr["valid"][row]),
                }).to_batches()

    return r.mapInArrow(run, PARTIAL_SCHEMA)


def neighbours_blocks(test: DataFrame, train: DataFrame, k: int, dim: int,
                      test_blocks: int, train_blocks: int,
                      max_distance: float | None = None, partitions: int | None = None) -> DataFrame:
    """Block nested-loop kNN with a NumPy kernel per block pair.

    Each ``(tb, rb)`` group emits at most k rows (plus boundary ties cut exactly) per test row;
    with more than one train block a window merges the per-block winners.
    """
    check_k(k)
    bound = float("inf") if max_distance is None else float(max_distance)
    n = partitions or test_blocks * train_blocks
    # hash-partitioned on the block pair with an explicit count: the cogroup reuses it, and
    # adaptive execution cannot fold the CPU-bound groups into a few tasks
    t = (block_rows(test.select(TEST_ID, TEST_F), TEST_ID, test_blocks, train_blocks, "tb", "rb")
         .repartition(n, "tb", "rb"))
    r = (block_rows(train.select(TRAIN_ID, TRAIN_F, tail_of(train)), TRAIN_ID, train_blocks, test_blocks,
                    "rb", "tb").repartition(n, "tb", "rb"))

    per_block = (t.groupBy("tb", "rb").cogroup(r.groupBy("tb", "rb"))
                 .applyInArrow(block_kernel(k, dim, bound), NEIGHBOUR_SCHEMA))
    if train_blocks == 1:
        return per_block
    return top_k(per_block.drop("rank"), k)


def block_kernel(k: int, dim: int, bound: float):
    """The per-group function of a cogrouped block pair: test block x train block -> top-k."""
    def run(left, right):
        q_ids = int_ids(left.column(TEST_ID))
        if q_ids.size == 0 or right.num_rows == 0:
            return pa.Table.from_batches([], schema=_NEIGHBOUR_ARROW)
        tail = right.column(ROWS if ROWS in right.column_names else "label")
        tr, q = train_block(right.column(TRAIN_ID), right.column(TRAIN_F), tail, dim), matrix(left.column(TEST_F), dim)
        if dim <= TREE_DIM:
            return neighbours_table(q_ids, *winners(q, tr, k, bound))
        tr = in_id_order(tr)                                     # wide rows: no further copy of either side
        return pa.concat_tables([neighbours_table(q_ids[s: s + QUERY_ROWS], *winners(q[s: s + QUERY_ROWS], tr, k, bound))
                                 for s in range(0, len(q), QUERY_ROWS)])

    return run


_NEIGHBOUR_ARROW = pa.schema([("test_id", pa.int64()), ("rank", pa.int32()),
                              ("train_id", pa.int64()), ("distance", pa.float64()),
                              ("label", pa.float64())])


# --------------------------------------------------------------------------- pair statistics

STATS_SCHEMA = ("test_id bigint, n bigint, min_d double, max_d double, first_id bigint, "
                "first_d double, last_id bigint, last_d double, n_admissible bigint, n_finite bigint")


def block_stats(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray,
                bound: float) -> pa.Table:
    """Per query row, statistics of its distances to every row of ``r`` -- no pair rows.

    ``n`` pairs, ``min_d``/``max_d`` (NaN ignored by the minimum and propagated by the maximum,
    as Spark orders NaN above every number), the distances to the lowest and highest train id
    (the first and last cells of the row's distance row), how many are below ``bound`` and how many
    below infinity (those that can be neighbours at all).
    """
    m, n = q.shape[0], r.shape[0]
    lo, hi = int(np.argmin(r_ids)), int(np.argmax(r_ids))
    r_t = np.ascontiguousarray(r.T)
    step = max(1, min(m, CHUNK_CELLS // max(n, 1)))
    out, tmp = np.empty((step, n)), np.empty((step, n))
    mins, maxs, firsts, lasts, adm, fin = [], [], [], [], [], []
    norms = filterable(q, r)
    for s in range(0, m, step):
        e = min(m, s + step)
        if norms:
            some = filtered_stats(q[s:e], norms[0][s:e], r_t, norms[1], lo, hi, bound, out[: e - s])
            if some is not None:
                for part, values in zip((mins, maxs, firsts, lasts, adm), some):
                    part.append(values)
                fin.append(np.full(e - s, n))
                continue
        dist = distance_block(q[s:e], r_t, out[: e - s], tmp[: e - s])
        nan = np.isnan(dist)
        mins.append(np.where(nan.all(axis=1), np.nan, np.nanmin(np.where(nan, np.inf, dist), axis=1)))
        maxs.append(np.max(dist, axis=1))
        firsts.append(dist[:, lo].copy())
        lasts.append(dist[:, hi].copy())
        adm.append((dist < bound).sum(axis=1))
        fin.append((dist < np.inf).sum(axis=1))
    cat = np.concatenate
    return pa.table({
        "test_id": pa.array(q_ids, pa.int64()),
        "n": pa.array(np.full(m, n), pa.int64()),
        "min_d": pa.array(cat(mins), pa.float64()),
        "max_d": pa.array(cat(maxs), pa.float64()),
        "first_id": pa.array(np.full(m, r_ids[lo]), pa.int64()),
        "first_d": pa.array(cat(firsts), pa.float64()),
        "last_id": pa.array(np.full(m, r_ids[hi]), pa.int64()),
        "last_d": pa.array(cat(lasts), pa.float64()),
        "n_admissible": pa.array(cat(adm), pa.int64()),
        "n_finite": pa.array(cat(fin), pa.int64()),
    })


def filtered_stats(q, qn, r_t, rn, lo: int, hi: int, bound: float, out: np.ndarray):
    """Least, largest, first, last distance and the number below ``bound`` of every row, exact distances only where
    the error bound leaves a doubt; None when it leaves it about too many pairs."""
    near, err = near_squares(q, qn, r_t, rn, out)
    err = err[:, None]
    room = 1 + 16 * UNIT
    low = near <= (near.min(axis=1, keepdims=True) + err) * room + err
    high = near >= (near.max(axis=1, keepdims=True) - err) / room - err
    if bound < 1e150:
        edge = bound * bound if bound > 0 else -np.inf
        sure = near < edge / room - err
        doubt = ~sure & (near <= edge * room + err)
    else:
        sure, doubt = np.ones_like(low), np.zeros_like(low)
    if sum(map(np.count_nonzero, (low, high, doubt))) > DENSE_SHARE * low.size:
        return None
    m = len(q)

    def of(mask):
        qi, ri = np.nonzero(mask)                    # every row has one at least, in order
        return qi, pair_distances(q, r_t, qi, ri)
    qi, d = of(low)
    least = np.minimum.reduceat(d, np.searchsorted(qi, np.arange(m)))
    qi, d = of(high)
    most = np.maximum.reduceat(d, np.searchsorted(qi, np.arange(m)))
    qi, d = of(doubt)
    count = np.count_nonzero(sure, axis=1) + np.bincount(qi[d < bound], minlength=m)
    each = np.arange(m)
    return (least, most, pair_distances(q, r_t, each, np.full(m, lo)), pair_distances(q, r_t, each, np.full(m, hi)), count)


def pair_stats(test: DataFrame, train: DataFrame, dim: int, test_blocks: int, train_blocks: int,
               max_distance: float | None = None, partitions: int | None = None) -> DataFrame:
    """``test_id, n, min_d, max_d, first_d, last_d, n_admissible, n_finite`` over all pairs of a row.

    The statistics of a test row's whole distance row, computed block by block (same block
    grid as ``neighbours_blocks``): each block pair emits one row per test row, and one
    partial-then-final aggregation merges the train blocks.  No pair is ever a row.
    """
    return merged_stats(pair_stats_parts(test, train, dim, test_blocks, train_blocks, max_distance, partitions))


def pair_stats_parts(test: DataFrame, train: DataFrame, dim: int, test_blocks: int, train_blocks: int,
                     max_distance: float | None = None, partitions: int | None = None) -> DataFrame:
    """The statistics of every test row over each train block."""
    bound = float("inf") if max_distance is None else float(max_distance)
    n = partitions or test_blocks * train_blocks
    t = (block_rows(test.select(TEST_ID, TEST_F), TEST_ID, test_blocks, train_blocks, "tb", "rb")
         .repartition(n, "tb", "rb"))
    r = (block_rows(train.select(TRAIN_ID, TRAIN_F), TRAIN_ID, train_blocks, test_blocks,
                    "rb", "tb").repartition(n, "tb", "rb"))

    def run(left, right):
        q_ids, r_ids = int_ids(left.column(TEST_ID)), int_ids(right.column(TRAIN_ID))
        if q_ids.size == 0 or r_ids.size == 0:
            return pa.Table.from_batches([], schema=_STATS_ARROW)
        return block_stats(q_ids, matrix(left.column(TEST_F), dim), r_ids,
                           matrix(right.column(TRAIN_F), dim), bound)

    return t.groupBy("tb", "rb").cogroup(r.groupBy("tb", "rb")).applyInArrow(run, STATS_SCHEMA)


def pair_stats_broadcast_train(test: DataFrame, train: DataFrame, dim: int,
                               max_distance: float | None = None,
                               partitions: int | None = None) -> DataFrame:
    """``pair_stats`` with the size-checked train side broadcast: map-only, test rows stay in place."""
    side = collect_side(train, TRAIN_ID, TRAIN_F, dim)
    bc = send(test.sparkSession, side)
    bound = float("inf") if max_distance is None else float(max_distance)

    def run(batches):
        tr = bc.value
        for batch in batches:
            if tr["ids"].size:
                yield from block_stats(int_ids(batch.column(0)), matrix(batch.column(1), dim),
                                       tr["ids"], tr["x"], bound).to_batches()

    out = spread(test.select(TEST_ID, TEST_F), partitions).mapInArrow(run, STATS_SCHEMA)
    return out.drop("first_id", "last_id")


def merge_stats(a: pa.Table | None, b: pa.Table) -> pa.Table:
    """The statistics of two sets of train rows as those of both; the test rows of ``a`` and ``b`` are the same."""
    if a is None:
        return b
    x, y = ({c: t.column(c).to_numpy() for c in t.column_names} for t in (a, b))
    low, high = y["first_id"] < x["first_id"], y["last_id"] > x["last_id"]
    out = {"test_id": x["test_id"], "n": x["n"] + y["n"], "min_d": np.fmin(x["min_d"], y["min_d"]),
           "max_d": np.maximum(x["max_d"], y["max_d"])}           # NaN is above all, and below nothing
    for c in ("first_id", "first_d"):
        out[c] = np.where(low, y[c], x[c])
    for c in ("last_id", "last_d"):
        out[c] = np.where(high, y[c], x[c])
    for c in ("n_admissible", "n_finite"):
        out[c] = x[c] + y[c]
    return pa.table({f.name: pa.array(out[f.name], f.type) for f in _STATS_ARROW})


def merged_stats(rows: DataFrame) -> DataFrame:
    """One row of statistics per test row from those over parts of the train side."""
    return rows.groupBy("test_id").agg(
        F.sum("n").alias("n"), F.min("min_d").alias("min_d"), F.max("max_d").alias("max_d"),
        F.min_by("first_d", "first_id").alias("first_d"),
        F.max_by("last_d", "last_id").alias("last_d"),
        F.sum("n_admissible").alias("n_admissible"), F.sum("n_finite").alias("n_finite"))


def pair_stats_broadcast_test(test: DataFrame, train: DataFrame, dim: int,
                              max_distance: float | None = None,
                              partitions: int | None = None) -> DataFrame:
    """``pair_stats`` with the size-checked test side broadcast: train rows stay in place, a task keeps one running
    row of statistics per test row, and one partial-then-final aggregation merges the tasks."""
    side = collect_side(test, TEST_ID, TEST_F, dim)
    bc = send(test.sparkSession, side)
    bound = float("inf") if max_distance is None else float(max_distance)

    def run(batches):
        ts, found = bc.value, None
        for batch in batches:
            if ts["ids"].size and batch.num_rows:
                found = merge_stats(found, block_stats(ts["ids"], ts["x"], int_ids(batch.column(0)),
                                                       matrix(batch.column(1), dim), bound))
        if found is not None:
            yield from found.to_batches()

    rows = spread(train.select(TRAIN_ID, TRAIN_F), partitions).mapInArrow(run, STATS_SCHEMA)
    return merged_stats(rows)


_STATS_ARROW = pa.schema([("test_id", pa.int64()), ("n", pa.int64()), ("min_d", pa.float64()),
                          ("max_d", pa.float64()), ("first_id", pa.int64()),
                          ("first_d", pa.float64()), ("last_id", pa.int64()),
                          ("last_d", pa.float64()), ("n_admissible", pa.int64()),
                          ("n_finite", pa.int64())])
