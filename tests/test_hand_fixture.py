"""The hand fixture (dim = 3): neighbours and both votes for k in 1, 2, 3, 4, 6, every plan."""

from __future__ import annotations

import math

import pytest

from conftest import SHAPES, shape_id
from proxima import knn_classify, knn_neighbors

# expected neighbour ids, nearest first, ties to the lower id (k = 6 lists every train row)
ORDER = {0: [0, 1, 5, 2, 3, 4], 1: [2, 3, 4, 1, 0, 5], 2: [1, 0, 5, 2, 3, 4]}
# expected (nonzero_majority, label_sum) per test row and k
VOTES = {
    0: {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), 6: (1, 1)},
    1: {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1), 6: (1, 1)},
    2: {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), 6: (1, 1)},
}
DIST = {
    0: [0, 1, 5, 5, 7.071068, 1],
    1: [5.656854, 5, 1, 1, 1.414214, 6.403124],
    2: [2, 1, 3.605551, 4.123106, 5.830952, 3],
}


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_neighbours_every_k(hand, shape):
    tr, te = hand
    strategy, kernel, block = shape
    got = knn_neighbors(tr, te, 6, strategy=strategy, kernel=kernel, block_bytes=block).collect()
    by_test = {}
    for r in got:
        by_test.setdefault(r.test_id, []).append(r)
    for t, rows in by_test.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.train_id for r in rows] == ORDER[t]
        assert [r.rank for r in rows] == list(range(1, 7))
        for r in rows:
            assert math.isclose(r.distance, DIST[t][r.train_id], abs_tol=1e-6)
    assert sorted(by_test) == [0, 1, 2]


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_votes_every_k(hand, shape):
    tr, te = hand
    strategy, kernel, block = shape
    for k in (1, 2, 3, 4, 6):
        for vi, vote in enumerate(("nonzero_majority", "label_sum")):
            got = {r.test_id: r.prediction for r in knn_classify(
                tr, te, k, strategy=strategy, kernel=kernel, vote=vote, block_bytes=block).collect()}
            want = {t: VOTES[t][k][vi] for t in VOTES}
            assert got == want, (k, vote)


def test_smaller_k_is_prefix(hand):
    tr, te = hand
    for k in (1, 2, 3, 4):
        got = knn_neighbors(tr, te, k).collect()
        for t in ORDER:
            ids = [r.train_id for r in sorted((r for r in got if r.test_id == t), key=lambda r: r.rank)]
            assert ids == ORDER[t][:k]
