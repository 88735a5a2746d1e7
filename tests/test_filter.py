"""The filter-and-recheck kernel gives the rows of the plain kernel, bit by bit."""

from __future__ import annotations

import numpy as np
import pytest

from proxima.operators import vectorized as V


def data(kind, rng, n, m, d):
    r, q = rng.normal(size=(n, d)), rng.normal(size=(m, d))
    if kind == "ties":                     # few distinct distances, many ties at the k-th place
        r, q = rng.integers(0, 2, (n, d)).astype(float), rng.integers(0, 2, (m, d)).astype(float)
    elif kind == "copies":                 # distance zero, where the product cancels completely
        r = r[rng.integers(0, max(1, n // 20), n)]
        q[:] = r[rng.integers(0, n, m)]
    elif kind == "shifted":                # large norms, small distances
        r, q = r + 1e6, q + 1e6
    elif kind == "scales":
        r = r * 10.0 ** rng.integers(-8, 8, (n, 1))
    elif kind == "tiny":
        r, q = r * 1e-160, q * 1e-160
    elif kind == "huge":                   # norms overflow: the plain kernel takes over
        r, q = r * 1e155, q * 1e155
    elif kind == "nan":
        r[rng.integers(0, n)] = np.nan
        q[rng.integers(0, m), 0] = np.inf
    return q, r


@pytest.mark.parametrize("kind", ["normal", "ties", "copies", "shifted", "scales", "tiny", "huge", "nan"])
@pytest.mark.parametrize("seed", range(6))
def test_same_as_plain(monkeypatch, kind, seed):
    rng = np.random.default_rng(seed)
    n, m, d, k = int(rng.integers(1, 2500)), int(rng.integers(1, 40)), int(rng.integers(16, 70)), int(rng.integers(1, 9))
    q, r = data(kind, rng, n, m, d)
    ids = rng.permutation(n).astype(np.int64)
    bound = [np.inf, float(np.sqrt(d)), 1e-3][seed % 3]
    got = []
    with np.errstate(all="ignore"):
        for width in (16, 1000):
            monkeypatch.setattr(V, "FILTER_DIM", width)
            qi, ri, dd = V.block_topk(q, r, ids, k, bound)
            order, _ = V.rank_cut(qi, dd, ids[ri], k)
            stats = V.block_stats(np.arange(m), q, ids, r, bound)
            got.append((qi[order].tobytes(), ids[ri[order]].tobytes(), dd[order].tobytes(), repr(stats.to_pydict())))
    assert got[0] == got[1]


def test_few_pairs_are_computed_exactly(monkeypatch):
    """On spread vectors exact distances are asked for a small share of the pairs."""
    rng = np.random.default_rng(0)
    r = rng.normal(size=(4000, 64))
    asked = []
    whole = V.pair_distances
    monkeypatch.setattr(V, "pair_distances", lambda q, t, a, b: asked.append(len(a)) or whole(q, t, a, b))
    monkeypatch.setattr(V, "distance_block", lambda *a: pytest.fail("a whole chunk was computed"))
    V.block_topk(r[:500], r, np.arange(4000), 5, np.inf)
    assert 2500 <= sum(asked) < 0.02 * 500 * 4000
    asked.clear()
    V.block_stats(np.arange(500), r[:500], np.arange(4000), r, 9.0)
    assert sum(asked) < 0.02 * 500 * 4000


def test_error_bound_holds_with_a_margin():
    """The stated bound against exact rational arithmetic, where cancellation is worst."""
    from fractions import Fraction
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e3, 1e8):
        q = rng.normal(size=(6, 32)) + scale
        r = q[rng.integers(0, 6, 40)] + rng.normal(size=(40, 32)) * 1e-6
        qn, rn = V.filterable(q, r)
        s, err = V.near_squares(q, qn, np.ascontiguousarray(r.T), rn, np.empty((6, 40)))
        for i in range(6):
            for j in range(40):
                true = sum((Fraction(a) - Fraction(b)) ** 2 for a, b in zip(q[i].tolist(), r[j].tolist()))
                assert abs(Fraction(float(s[i, j])) - true) * 2 <= Fraction(float(err[i]))
