"""Neighbour search among narrow vectors by boxes: a small NumPy helper of the kernels.

Rows are put in an order in which runs of ``LEAF`` rows lie close together (the widest dimension of a run is halved until
the runs are short), and of each run only its box is looked at first.  Queries are put in the same kind of order and
searched in groups.  The k-th least distance to a few leaves near the group bounds each query's k-th neighbour, and only
leaves whose box is within the largest of these bounds are computed; a group that meets too many of them is halved.

Bounds and distances are sums of squares in the same order of operations.  Rounding is monotone, so the computed bound of a
box never exceeds the computed distance of a row in it, and ``ROOM`` covers what the square root makes equal: no winner, and no tie for
the last place, is ever ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

TREE_DIM = 8                     # up to this width boxes separate rows
LEAF, FAN = 64, 64               # rows of a leaf, leaves of a node
GROUP, LEAST_GROUP = 64, 8       # queries searched together
GROUP_ROWS = 2048                # a group that meets more rows is halved
CHUNK_CELLS = 1 << 22            # most distances of a group that can be halved
HELD = 1 << 20                   # pairs kept before they are cut and handed on
ROOM = 1 + 2.0 ** -48
CUT_LEVELS = 12                  # a sample is halved so often where rows are dealt to tasks


def close_runs(x: np.ndarray, run: int) -> np.ndarray:
    """An order of finite rows in which every ``run`` rows, from the first on, lie close together."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    with np.errstate(over="ignore"):
        while todo:
            a, b = todo.pop()
            if b - a <= run:
                continue
            rows = order[a:b]
            v = x[rows]
            width = v.max(axis=0) - v.min(axis=0)
            j = int(np.argmax(width))
            if width[j] > 0:
                mid = run * (-(-(b - a) // run) // 2)
                order[a:b] = rows[np.argpartition(v[:, j], mid)]
                todo += [(a, a + mid), (a + mid, b)]
    return order


def median_cuts(sample: np.ndarray, levels: int = CUT_LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Per node of a binary tree (the root is 1, the halves of i are 2 i and 2 i + 1) the dimension and the value at which a finite
    sample is halved: at the median of the dimension in which its rows there lie widest."""
    axis, cut = np.zeros(1 << levels, np.int64), np.full(1 << levels, np.inf)
    todo = [(1, sample)]
    while todo:
        node, v = todo.pop()
        if node >= len(cut) or len(v) < 2:
            continue
        with np.errstate(over="ignore"):
            j = int(np.argmax(v.max(axis=0) - v.min(axis=0)))
        axis[node], cut[node] = j, np.partition(v[:, j], (len(v) - 1) // 2)[(len(v) - 1) // 2]
        above = v[:, j] > cut[node]
        todo += [(2 * node, v[~above]), (2 * node + 1, v[above])]
    return axis, cut


def cell_of(x: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell of every row, in an order in which cells that follow each other lie close together."""
    axis, cut = cuts
    node = np.ones(len(x), np.int64)
    for _ in range(len(cut).bit_length() - 1):
        node = 2 * node + (x[np.arange(len(x)), axis[node]] > cut[node])         # False for NaN
    return (node - len(cut)).astype(np.int32)


def least_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The finite rows that may be among the ``k`` nearest of any query: of equal vectors the ``k`` of least id."""
    rows = np.flatnonzero(np.isfinite(x).all(axis=1))
    if len(rows) <= k:
        return rows
    rows = rows[np.lexsort((ids[rows], *x[rows].T))]
    new = np.append(True, (x[rows[1:]] != x[rows[:-1]]).any(axis=1))
    first = np.flatnonzero(new)
    return np.sort(rows[np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) < k])


def gaps(lo, hi, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of the box ``lo`` to ``hi`` (a number, or a column, per dimension) to boxes ``low`` to ``high`` (one column each)."""
    total = 0.0
    with np.errstate(over="ignore"):
        for a, b, c, d in zip(lo, hi, low, high):
            gap = np.maximum(np.maximum(c - b, a - d), 0.0)
            total = total + gap * gap
    return total


def squares(q: np.ndarray, r_t: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``q`` to columns of ``r_t``, added in the order of ``distance_block``."""
    out = np.zeros((len(q), r_t.shape[1]))
    with np.errstate(over="ignore"):
        for j in range(q.shape[1]):
            diff = q[:, j:j + 1] - r_t[j:j + 1]
            diff *= diff
            out += diff
    return out


def reach_squared(d: np.ndarray | float) -> np.ndarray | float:
    """A square that no square of a distance of at most ``d`` exceeds."""
    with np.errstate(over="ignore"):
        return d * d * ROOM + 1e-300


def arrays(tree) -> tuple:
    """The fields of a tree.  Broadcasts carry these: unlike task functions they name a class by its module, which a worker need not find."""
    return tuple(vars(tree).values())


@dataclass(frozen=True)
class BoxTree:
    """``values[dimension, leaf, place]`` (NaN where a leaf has no row), the ``rows`` they came from and their ``ids``, and the boxes of
    leaves and of nodes of ``FAN`` leaves, one column each."""
    values: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    node_low: np.ndarray
    node_high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, k: int) -> BoxTree:
        """A tree for searches of at most ``k`` neighbours."""
        rows = least_copies(x, ids, k)
        rows = rows[close_runs(x[rows], LEAF)]
        leaves, n, dim = -(-len(rows) // LEAF), len(rows), x.shape[1]
        values = np.full((dim, leaves * LEAF), np.nan)
        values[:, :n] = x[rows].T
        values = values.reshape(dim, leaves, LEAF)
        pad = np.zeros(leaves * LEAF - n, np.int64)
        low, high = np.fmin.reduce(values, axis=2), np.fmax.reduce(values, axis=2)
        return cls(values, np.concatenate([rows, pad]), np.concatenate([ids[rows], pad]), low, high, *cls.nodes(low, high))

    @staticmethod
    def nodes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, low.shape[1], FAN)
        if not len(starts):
            return low, high
        return np.minimum.reduceat(low, starts, axis=1), np.maximum.reduceat(high, starts, axis=1)

    @classmethod
    def of_boxes(cls, low: np.ndarray, high: np.ndarray) -> BoxTree:
        """Boxes alone, for ``within``; close ones should stand together."""
        none = np.empty(0, np.int64)
        return cls(np.empty((len(low), 0, LEAF)), none, none, low, high, *cls.nodes(low, high))

    def _leaves(self, nodes: np.ndarray) -> np.ndarray:
        at = (nodes[:, None] * FAN + np.arange(FAN)).reshape(-1)
        return at[at < self.low.shape[1]]

    def within(self, lo, hi, reach: float) -> np.ndarray:
        """Leaves whose box is within the squared distance ``reach`` of the box from ``lo`` to ``hi``."""
        at = self._leaves(np.flatnonzero(gaps(lo, hi, self.node_low, self.node_high) <= reach))
        return at[gaps(lo, hi, self.low[:, at], self.high[:, at]) <= reach]

    def near(self, point: np.ndarray, count: int) -> np.ndarray:
        """``count`` leaves near a point, or all if there are not so many."""
        def least(d, n):
            return np.argpartition(d, n)[:n] if len(d) > n else np.arange(len(d))
        at = self._leaves(least(gaps(point, point, self.node_low, self.node_high), 4 + count // FAN))
        return at[least(gaps(point, point, self.low[:, at], self.high[:, at]), count)]

    def points(self, leaves: np.ndarray) -> np.ndarray:
        return self.values[:, leaves].reshape(len(self.values), -1)

    def search(self, q: np.ndarray, k: int, bound: float = np.inf, reach: np.ndarray | None = None
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(query, place, distance)`` of the ``k`` nearest rows below ``bound`` of finite queries in the order of
        ``close_runs``, piece by piece; a query is in one piece.  ``reach``: per query a squared distance that its
        winners do not exceed (``reach_squared``)."""
        limit = np.full(len(q), np.inf) if reach is None else reach.copy()
        if bound < 1e150:
            limit = np.minimum(limit, reach_squared(bound) if bound > 0 else -1.0)
        enough = 4 + -(-2 * k // LEAF)
        held, size = [], 0

        def cut():
            qi, at, d = (np.concatenate(v) for v in zip(*held))
            order = np.lexsort((self.ids[at], d, qi))
            qi = qi[order]
            first = np.flatnonzero(np.append(True, qi[1:] != qi[:-1])) if len(qi) else np.empty(0, np.int64)
            rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
            keep = order[rank < k]
            return qi[rank < k], at[keep], d[keep]

        for start in range(0, len(q) if self.low.shape[1] else 0, GROUP):
            todo = [(start, min(len(q), start + GROUP))]
            while todo:
                a, b = todo.pop()
                g, most = q[a:b], limit[a:b]
                lo, hi = g.min(axis=0), g.max(axis=0)
                leaves = self.within(lo, hi, most.max())
                if len(leaves) > 2 * enough:
                    s = squares(g, self.points(self.near(lo / 2 + hi / 2, enough)))
                    if s.shape[1] > k:
                        kth = np.partition(s, k - 1, axis=1)[:, k - 1]
                        most = np.fmin(most, kth * ROOM)             # NaN: fewer than k rows
                        leaves = self.within(lo, hi, most.max())
                        limit[a:b] = most
                if not len(leaves):
                    continue
                cells = len(leaves) * LEAF * (b - a)
                if (b - a > LEAST_GROUP and len(leaves) * LEAF > GROUP_ROWS) or (b - a > 1 and cells > CHUNK_CELLS):
                    mid = (a + b) // 2
                    todo += [(mid, b), (a, mid)]
                    continue
                s = squares(g, self.points(leaves))
                if s.shape[1] > k and (np.isinf(most).any() or len(leaves) <= 2 * enough):
                    most = np.fmin(most, np.partition(s, k - 1, axis=1)[:, k - 1] * ROOM)
                qi, at = np.nonzero(s <= most[:, None])              # False for NaN
                d = np.sqrt(s[qi, at])
                fine = d < bound
                qi, at, d = qi[fine], at[fine], d[fine]
                held.append((qi + a, leaves[at // LEAF] * LEAF + at % LEAF, d))
                size += len(qi)
                if size >= HELD:
                    yield cut()
                    held, size = [], 0
        if held:
            yield cut()

    def kth_reach(self, q: np.ndarray, k: int, bound: float = np.inf) -> np.ndarray:
        """Per finite query in order a squared distance within which ``k`` rows of the tree lie, infinite if there are not
        so many, and not above that of ``bound``."""
        out = np.full(len(q), np.inf)
        for qi, _, d in self.search(q, k):
            last = np.flatnonzero(np.append(qi[1:] != qi[:-1], True))
            full = last[np.diff(np.append(-1, last)) == k]
            out[qi[full]] = reach_squared(d[full])
        return np.minimum(out, reach_squared(bound) if bound > 0 else -1.0)
