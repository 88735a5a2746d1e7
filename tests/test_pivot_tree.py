"""The tree of pivots and the entries of equal vectors."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import frame
from proxima.operators import pivot as P
from proxima.operators import vectorized as V
from proxima.operators.candidates import prepare_train
from proxima.operators.entries import entries, entry_counts
from proxima.plans import classify as K


def brute(train, test, k):
    out = {}
    for t, q in test:
        d = []
        for i, x, label in train:
            s = 0.0
            for a, b in zip(q, x):
                s += (a - b) * (a - b)
            d.append((float(np.sqrt(s)), i, label))
        out[t] = [(i, v, label) for v, i, label in sorted(d)[:k]]
    return out


def rows_of(df):
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r.test_id, r["rank"])):
        by.setdefault(r.test_id, []).append((r.train_id, r.distance, r.label))
    return by


def points(rng, n, d=2, clusters=7):
    return rng.normal(size=(n, d)) + 15 * rng.integers(0, clusters, (n, 1))


def test_many_pivots_flat_memory(monkeypatch):
    """With more than 10,000 pivots every row still meets about 2 sqrt(P) of them, in bounded chunks."""
    rng = np.random.default_rng(1)
    train, test = points(rng, 30_000), points(rng, 400)
    sizes = []
    whole = P.distance_block
    monkeypatch.setattr(P, "distance_block", lambda q, t, out, tmp: sizes.append(out.size) or whole(q, t, out, tmp))
    monkeypatch.setattr(P, "CHUNK_CELLS", 1 << 16)
    tree = P.PivotTree.of(train[:12_000])
    assert len(tree.pivots) == 12_000 and len(tree.centres) == 109 and max(sizes) <= 1 << 16
    sizes.clear()
    part, d = tree.assign(train)
    assert max(sizes) <= 1 << 16 and sum(sizes) < 6 * 110 * len(train)          # far below rows x P
    assert np.allclose(d, np.linalg.norm(train - tree.pivots[part], axis=1))
    bound = tree.bounds(part, d, 5)
    for p in rng.integers(0, 12_000, 50):
        assert np.sort(np.linalg.norm(train - tree.pivots[p], axis=1))[4] <= bound[p] + 1e-9
    # every train row that is a neighbour of a test row reaches that row's cell
    part, d = tree.assign(test)
    near, far = np.full((P.RINGS, 12_000), np.nan), np.full((P.RINGS, 12_000), np.nan)
    for p, v in zip(part, d):
        near[0, p], far[0, p] = np.fmin(near[0, p], v), np.fmax(far[0, p], v)
    sizes.clear()
    lo, hi = P.reach_of(near, far, bound, np.inf)
    sent = set()
    for row, cell in tree.cells(train, lo, hi):
        assert len(row) == len(cell)
        sent.update(zip(row.tolist(), cell.tolist()))
    assert max(sizes) <= 1 << 16 and sum(sizes) < 0.2 * len(train) * 12_000
    for q, p in zip(test, part):
        for r in np.argsort(np.linalg.norm(train - q, axis=1))[:5]:
            assert (int(r), int(p) * P.RINGS) in sent
    assert len(sent) < 0.2 * len(train) * len(np.unique(part))


def test_one_hot_vector_and_rows_that_are_not_finite():
    x = np.vstack([np.zeros((500, 2)), np.ones((3, 2)), [[np.nan, 0]], [[np.inf, 0]]])
    tree = P.PivotTree.of(x[:503])
    assert len(tree.pivots) == 2                                # copies are one pivot
    part, d = tree.assign(x)
    assert (part[-2:] == -1).all() and (d[:503] == 0).all()
    assert (tree.bounds(part[:503], d[:503], 5) <= np.sqrt(2)).all()
    assert np.isinf(tree.bounds(part[:3], d[:3], 5)).all()      # fewer rows than k


def test_sample_widens_until_it_has_enough(spark):
    rows = [(i, [float(i), float("nan") if i % 3 else 0.0], 0.0) for i in range(3000)]
    tr = prepare_train(frame(spark, rows), dim=2)
    got = P.hashed_sample(tr, "train_id", "train_features", 2, 100, 3000)
    assert len(got) == 100 and np.isfinite(got).all()
    assert len(P.hashed_sample(tr, "train_id", "train_features", 2, 5000, 3000)) == 1000


def repeated(rng):
    """A third of the train rows share one vector, others repeat in pairs; distances tie across vectors."""
    pool = [[float(a), float(b)] for a in range(-3, 4) for b in range(-3, 4)]
    rows = [[0.0, 0.0]] * 100 + [pool[i] for i in rng.integers(0, len(pool), 200)]
    ids = rng.permutation(300)
    return [(int(i), x, float(i % 3)) for i, x in zip(ids, rows)]


@pytest.mark.parametrize("strategy", ["broadcast_train", "broadcast_test", "block", "pivot"])
def test_entries_give_the_same_rows(spark, strategy):
    rng = np.random.default_rng(2)
    train = repeated(rng)
    test = [(i, [float(v) for v in rng.integers(-4, 5, 2) / 2]) for i in range(40)] + [(90 + i, [0.0, 0.0]) for i in range(30)]
    got = K.knn_neighbors(frame(spark, train), frame(spark, test, labelled=False), 7, strategy=strategy,
                          block_bytes=512 if strategy in ("block", "pivot") else None, collapse=True)
    assert rows_of(got) == brute(train, test, 7)


def test_entries_hold_the_least_ids(spark):
    train = repeated(np.random.default_rng(4)) + [(1000, [float("nan"), 1.0], 1.0), (1001, [float("nan"), 1.0], None)]
    got = entries(prepare_train(frame(spark, train), dim=2), 4)
    by = {}
    for i, x, label in sorted(train, key=lambda t: t[0]):
        by.setdefault(repr(x), []).append((i, label))
    want = {k: v[:4] for k, v in by.items()}
    assert {repr(r.train_features): [(m.train_id, m.label) for m in r["rows"]] for r in got.collect()} == want
    assert entry_counts(got) == (len(want), sum(map(len, want.values())))


def test_estimate_decides(spark, monkeypatch):
    """Entries are used where at least half of the rows repeat a vector, and only where vectors are narrow."""
    rng = np.random.default_rng(3)
    same = frame(spark, [(i, [float(i % 5), 0.0], 1.0) for i in range(200)])
    all_new = frame(spark, [(i, [float(i), 0.0], 1.0) for i in range(200)])
    wide = frame(spark, [(i, [0.0] * 20, 1.0) for i in range(200)])
    te = frame(spark, [(i, [float(v) for v in rng.normal(size=2)]) for i in range(5)], labelled=False)
    for tr, dim, used in ((same, 2, True), (all_new, 2, False), (wide, 20, False)):
        t = prepare_train(tr, dim=dim)
        from proxima.operators.candidates import prepare_test
        q = prepare_test(te if dim == 2 else frame(spark, [(0, [0.0] * 20)], labelled=False), dim=dim)
        out, plan = K.planned(t, q, dim, 3)
        assert ("rows" in out.columns) == used and plan.train_rows == (5 if used else 200)


def test_copies_of_queries_are_searched_once(monkeypatch):
    seen = []
    whole = V.block_topk
    monkeypatch.setattr(V, "block_topk", lambda q, *a: seen.append(len(q)) or whole(q, *a))
    tr = {"x": np.array([[0.0], [1.0], [3.0]]), "ids": np.array([5, 6, 7]), "labels": np.zeros(3), "valid": np.ones(3, bool)}
    q = np.array([[0.1], [2.9], [0.1], [0.1]])
    qi, ids, *_ = V.winners(q, tr, 2, np.inf)
    assert seen == [2] and qi.tolist() == [0, 0, 1, 1, 2, 2, 3, 3] and ids.tolist() == [5, 6, 7, 6, 5, 6, 5, 6]


def test_vouched_ids_are_only_counted(spark):
    twice = prepare_train(frame(spark, [(1, [0.0], 0.0), (1, [1.0], 0.0)]), dim=1)
    te = frame(spark, [(0, [0.0])], labelled=False).selectExpr("row_id as test_id", "features as test_features")
    assert K.count_sides(twice, te, unique_ids=True).train == 2
    with pytest.raises(ValueError):
        K.count_sides(twice, te)
