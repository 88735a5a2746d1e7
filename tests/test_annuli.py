"""Statistics by rings: the rows of the block plan, from far fewer pairs."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import frame
from proxima.operators import candidates as C
from proxima.operators import vectorized as V
from proxima.operators.annuli import pair_stats_annuli


def sides(spark, train, test, dim):
    tr = C.prepare_train(frame(spark, [(i, [float(v) for v in x], 0.0) for i, x in enumerate(train)]), dim=dim)
    te = C.prepare_test(frame(spark, [(1000 + i, [float(v) for v in x]) for i, x in enumerate(test)], labelled=False), dim=dim)
    return tr, te


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select("test_id", "n", "min_d", "max_d", "first_d", "last_d", "n_admissible", "n_finite").collect())


@pytest.mark.parametrize("bound", [None, 3.0, 0.0])
def test_same_statistics_from_few_pairs(spark, bound):
    rng = np.random.default_rng(7)
    train = rng.normal(size=(3000, 2)) + 20 * rng.integers(0, 9, (3000, 2))
    train[:800] = train[0]                                          # a hot vector
    test = rng.normal(size=(200, 2)) + 20 * rng.integers(0, 9, (200, 2))
    tr, te = sides(spark, train, test, 2)
    report = {}
    got = pair_stats_annuli(te, tr, 2, 3000, 1 << 14, 8, bound, fallback=True, report=report)
    assert rows(got) == rows(V.pair_stats(te, tr, 2, 1, 1, bound))
    assert report["all"] == 600_000 and 0 < report["pairs"] < 0.1 * report["all"]


def test_odd_rows_on_both_sides(spark):
    nan, inf = float("nan"), float("inf")
    train = [[0, 0], [1, 0], [nan, 1], [inf, 2], [3, 4], [1e200, 0], [2, 2]]
    test = [[0, 1], [nan, 0], [inf, 0], [1e200, 1], [5, 5]]
    tr, te = sides(spark, train, test, 2)
    for bound in (None, 2.0):
        assert rows(pair_stats_annuli(te, tr, 2, 7, 1 << 14, 4, bound)) == rows(V.pair_stats(te, tr, 2, 1, 1, bound))
    only_odd, _ = sides(spark, [[nan, 0], [inf, 0]], test, 2)
    assert rows(pair_stats_annuli(te, only_odd, 2, 2, 1 << 14, 4, 2.0)) == rows(V.pair_stats(te, only_odd, 2, 1, 1, 2.0))


def test_falls_back_where_rings_leave_most_pairs(spark):
    rng = np.random.default_rng(1)
    tr, te = sides(spark, rng.normal(size=(80, 24)), rng.normal(size=(20, 24)), 24)
    report = {}
    got = pair_stats_annuli(te, tr, 24, 80, 1 << 14, 4, 6.5, fallback=True, report=report)
    assert report == {} and rows(got) == rows(V.pair_stats(te, tr, 24, 1, 1, 6.5))


def test_empty_sides(spark):
    tr, te = sides(spark, [[0, 0]], [[1, 1]], 2)
    assert pair_stats_annuli(te.where("false"), tr, 2, 1, 1 << 14, 4).collect() == []
    assert pair_stats_annuli(te, tr.where("false"), 2, 0, 1 << 14, 4).collect() == []
