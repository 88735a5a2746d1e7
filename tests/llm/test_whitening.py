"""Whitening against exact integer arithmetic and numpy."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from proxima.llm import whitening as W

VECTORS = "vec_id bigint, embedding array<float>, n int, component string, x string"


def table(spark, vectors, ids=None):
    rows = [(n if ids is None else ids[n], None if v is None else [None if a is None else float(a) for a in v], 0, "c", "x") for n, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTORS).repartition(4)


def ints(v):
    return [int(np.floor(64 * float(np.float32(a)))) + 1_000_000 for a in v]


def checked(got, vectors, ids=None):
    """Every column of the result against its definition; returns the fit list."""
    use = [(n if ids is None else ids[n], ints(v)) for n, v in enumerate(vectors)
           if v is not None and len(v) == len(vectors[0]) and all(a is not None and np.isfinite(a) for a in v)]
    fit = np.array(sorted({tuple(x) for _, x in use}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    cov = np.array([[float(Fraction(int(n * (fit[:, i] * fit[:, j]).sum() - s[i] * s[j]), n * n)) for j in range(len(s))] for i in range(len(s))])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    k = len(e)
    assert len(got) == len(use) * k
    dev = {}
    for i, x in use:
        dev.setdefault((i, sum((n * a - b) ** 2 for a, b in zip(x, s))), []).append((np.array([float(Fraction(int(n * a - b), n)) for a, b in zip(x, s)]) @ u) / np.sqrt(e))
    sign = np.zeros(k)
    for r in got:
        c = r.component - 1
        want = np.array([z[c] for z in dev[(r.vec_id, r.deviation)]])
        assert r.n == n and np.isclose(r.explained, e[c] / np.trace(cov), rtol=1e-9) and r.identity_error < 1e-9
        assert np.isclose(abs(r.whitened), np.abs(want), atol=1e-7).any()
        if not sign[c] and abs(r.whitened) > 1e-3 and len(want) == 1:
            sign[c] = np.sign(r.whitened) * np.sign(want[0])
    for r in got:
        c = r.component - 1
        assert np.isclose(sign[c] * r.whitened, [z[c] for z in dev[(r.vec_id, r.deviation)]], atol=1e-7).any()
    return fit


def test_matches_the_definition(spark, monkeypatch):
    monkeypatch.setattr(W, "PACKED_ROWS", 50)
    rng = np.random.default_rng(8)
    vectors = [list(v) for v in rng.normal(size=(300, 20)) * np.linspace(0.5, 5, 20)]
    vectors += [vectors[3]] * 120 + [None, [], [1.0] * 19 + [None], [1.0] * 19 + [float("nan")], [1.0] * 19 + [float("-inf")], [2.0] * 7]
    ids = list(range(len(vectors)))
    ids[10], ids[11], ids[305] = None, 5, 12                       # no id, repeated ids
    got = W.whiten(table(spark, vectors, ids)).collect()
    checked(got, vectors, ids)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(1)
    vectors = [list(v) for v in rng.normal(size=(40, 3))]
    got = W.whiten(table(spark, vectors)).collect()
    checked(got, vectors)
    assert {r.component for r in got} == {1, 2, 3}


def test_components_without_variance(spark):
    vectors = [[1.0, 5.0, float(i)] for i in range(9)]
    got = W.whiten(table(spark, vectors)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and len(got) == 27
    assert all(r.explained == (1.0 if r.component == 1 else 0.0) and r.identity_error < 1e-12 for r in got)
    one = W.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.identity_error == 0 for r in one)


def test_large_entries_stay_exact(spark):
    vectors = [[3e38, 1.0], [-3e38, 2.0], [1e6, 3.0], [0.5, 4.0]]
    got = {(r.vec_id, r.component): r for r in W.whiten(table(spark, vectors)).collect()}
    top = 1 << 40
    x = [top, -top, 64_000_000, 32]
    s = sum(x)
    want = [(4 * a - s) ** 2 + (4 * 64 * b - 64 * 10) ** 2 for a, b in zip(x, (1, 2, 3, 4))]
    assert [got[i, 1].deviation for i in range(4)] == [w if w < 1 << 63 else None for w in want]


def test_planes_count_products():
    rng = np.random.default_rng(3)
    y = rng.integers(0, [1, 2, 9, 1 << 20], size=(777, 4))
    bits = [int(v).bit_length() for v in y.max(axis=0)]
    counts = np.zeros((sum(bits), sum(bits)), np.int64)
    for s in range(0, 777, 100):
        W.add_counts(counts, W.planes(y[s: s + 100], bits))
    want = y.T @ y
    assert W.weighted(counts, bits) == [int(want[i, j]) for i in range(4) for j in range(i, 4)]


@pytest.mark.parametrize("vectors", [[], [None, [], [float("nan")]]])
def test_nothing_to_fit(spark, vectors):
    assert W.whiten(spark.createDataFrame([(0, v, 0, "", "") for v in vectors], VECTORS)).collect() == []
