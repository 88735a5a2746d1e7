"""Every plan shape agrees with a NumPy brute force on random data full of duplicate rows."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import SHAPES, frame, shape_id
from proxima import knn_classify, knn_neighbors


def brute_force(train, test, k):
    """{test_id: [(train_id, distance, label)]} by (distance, train_id), exact left-to-right sums."""
    out = {}
    for tid, tf in test:
        cands = []
        for rid, rf, lab in train:
            s = 0.0
            for a, b in zip(tf, rf):
                s += (a - b) * (a - b)
            cands.append((float(np.sqrt(s)), rid, lab))
        cands.sort()
        out[tid] = [(rid, d, lab) for d, rid, lab in cands[:k]]
    return out


def dataset(seed, n_train, n_test, dim):
    rng = np.random.default_rng(seed)
    pool = rng.integers(-3, 4, size=(max(3, n_train // 3), dim)).astype(float)
    train = []
    ids = rng.permutation(n_train * 3)[:n_train]
    for i in range(n_train):
        v = pool[rng.integers(len(pool))] if rng.random() < 0.6 else rng.normal(size=dim).round(2)
        train.append((int(ids[i]), [float(x) for x in v], float(rng.integers(0, 2))))
    test = [(int(i), [float(x) for x in rng.integers(-3, 4, size=dim)]) for i in range(n_test)]
    return train, test


CASES = [(1, 40, 7, 3, 5), (2, 25, 5, 1, 4), (3, 60, 9, 5, 8)]


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"seed{c[0]}")
@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_neighbours_match_brute_force(spark, case, shape):
    seed, n_train, n_test, dim, k = case
    strategy, kernel, block = shape
    train, test = dataset(seed, n_train, n_test, dim)
    want = brute_force(train, test, k)
    tr = frame(spark, train).repartition(3)
    te = frame(spark, test, labelled=False)
    got = knn_neighbors(tr, te, k, strategy=strategy, kernel=kernel, block_bytes=block).collect()
    by = {}
    for r in got:
        by.setdefault(r.test_id, []).append(r)
    assert sorted(by) == sorted(want)
    for t, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [(r.train_id, r.distance, r.label) for r in rows] == want[t]


@pytest.mark.parametrize("case", CASES[:2], ids=lambda c: f"seed{c[0]}")
def test_predictions_agree_across_shapes(spark, case):
    seed, n_train, n_test, dim, k = case
    train, test = dataset(seed, n_train, n_test, dim)
    tr, te = frame(spark, train), frame(spark, test, labelled=False)
    for vote in ("nonzero_majority", "label_sum"):
        results = set()
        for strategy, kernel, block in SHAPES:
            rows = knn_classify(tr, te, k, strategy=strategy, kernel=kernel, vote=vote,
                                block_bytes=block).collect()
            results.add(tuple(sorted((r.test_id, r.prediction) for r in rows)))
        assert len(results) == 1, vote


@pytest.mark.parametrize("blocks", [None, "test", "annuli", (1, 1), (2, 3)])
def test_pair_stats_match_brute_force(spark, blocks):
    from proxima.operators import candidates as C
    from proxima.operators import vectorized as V

    train, test = dataset(5, 30, 6, 3)
    train[3] = (train[3][0], [float("nan")] + train[3][1][1:], train[3][2])
    tr = C.prepare_train(frame(spark, train), dim=3)
    te = C.prepare_test(frame(spark, test, labelled=False), dim=3)
    if blocks == "annuli":
        from proxima.operators.annuli import pair_stats_annuli
        stats = pair_stats_annuli(te, tr, 3, 30, 512, 8, 2.5)
    else:
        stats = (V.pair_stats_broadcast_train(te, tr, 3, 2.5) if blocks is None else V.pair_stats_broadcast_test(te, tr, 3, 2.5, 4)
                 if blocks == "test" else V.pair_stats(te, tr, 3, *blocks, max_distance=2.5))
    got = {r.test_id: r for r in stats.collect()}
    assert sorted(got) == sorted(t for t, _ in test)
    by_id = sorted(train)
    for t, tf in test:
        d = [float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(tf, rf)))) for _, rf, _ in by_id]
        g = got[t]
        assert (g.n, g.n_admissible, g.n_finite) == (30, sum(x < 2.5 for x in d), 29)
        assert np.isclose(g.min_d, np.nanmin(d)) and np.isnan(g.max_d)  # NaN orders above every number
        for mine, want in ((g.first_d, d[0]), (g.last_d, d[-1])):
            assert np.isclose(mine, want) or (np.isnan(mine) and np.isnan(want))


@pytest.mark.parametrize("kernel", ["numpy", "sql"])
def test_any_k(spark, kernel):
    tr = frame(spark, [(0, [0.0], 1.0)])
    te = frame(spark, [(0, [0.0])], labelled=False)
    assert len(knn_neighbors(tr, te, 1001, kernel=kernel).collect()) == 1


def test_far_and_infinite_rows_do_not_widen_the_reach(spark):
    """One far test row widens its own ring only, an infinite one meets nobody."""
    from proxima.operators import pivot as PV
    rng = np.random.default_rng(3)
    train = [(i, [float(x) for x in rng.normal(size=2) + 20 * (i % 8)], 1.0) for i in range(400)]
    test = [(i, [float(x) for x in rng.normal(size=2) + 20 * (i % 8)]) for i in range(200)]
    tree = PV.PivotTree.of(np.array([train[i][1] for i in range(40)]))
    near = np.array([t for _, t in test])
    xs = np.array([t for _, t, _ in train])

    def share(points):
        part, d = tree.assign(points)
        cell = part[part >= 0] * PV.RINGS + [sum(v > q for q in np.quantile(d[part == p], PV.RING_QUANTILES)) for p, v in zip(part, d) if p >= 0]
        count = np.bincount(cell, minlength=len(tree.pivots) * PV.RINGS)
        ends = np.full((2, len(count)), np.nan)
        for c in np.unique(cell):
            ends[:, c] = d[part >= 0][cell == c].min(), d[part >= 0][cell == c].max()
        reach = PV.reach_of(*(e.reshape(-1, PV.RINGS).T for e in ends), tree.bounds(*tree.assign(xs), 3), float("inf"))
        return PV.sampled_share(tree, xs, *reach, count)
    base = share(near)
    far = np.vstack([near, [[1e6, 1e6]], [[np.inf, 0.0]]])
    assert base < 0.3 and share(far) < base + 0.02
    test += [(1000, [1e6, 1e6]), (1001, [float("inf"), 0.0])]
    got = knn_neighbors(frame(spark, train), frame(spark, test, labelled=False), 3, strategy="pivot",
                        block_bytes=4096).collect()
    want = brute_force(train, [t for t in test if t[0] != 1001], 3)
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.test_id, []).append((r.train_id, r.distance, r.label))
    assert by == want


def test_pivot_falls_back_when_nothing_is_pruned(spark, monkeypatch):
    """High-dimensional uniform data: the pivot plan hands over to the block join, same rows."""
    from proxima.operators import pivot as PV
    rng = np.random.default_rng(11)
    train = [(i, [float(x) for x in rng.normal(size=16)], float(i % 2)) for i in range(60)]
    test = [(100 + i, [float(x) for x in rng.normal(size=16)]) for i in range(10)]
    tr, te = frame(spark, train), frame(spark, test, labelled=False)
    used = []
    for share in (0.0, 10.0):  # always and never fall back
        monkeypatch.setattr(PV, "FALLBACK_SHARE", share)
        rows = knn_neighbors(tr, te, 3, strategy="pivot", block_bytes=256).collect()
        used.append(sorted((r.test_id, r.rank, r.train_id, r.distance) for r in rows))
    assert used[0] == used[1]
    want = brute_force(train, test, 3)
    assert used[0] == sorted((t, i + 1, rid, d) for t, lst in want.items()
                             for i, (rid, d, _) in enumerate(lst))


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_max_distance_matches_brute_force(spark, shape):
    strategy, kernel, block = shape
    train, test = dataset(4, 40, 7, 2)
    bound = 2.0
    want = {t: [c for c in lst if c[1] < bound] for t, lst in brute_force(train, test, 4).items()}
    got = knn_neighbors(frame(spark, train), frame(spark, test, labelled=False), 4,
                        strategy=strategy, kernel=kernel, block_bytes=block,
                        max_distance=bound).collect()
    by = {}
    for r in got:
        by.setdefault(r.test_id, []).append(r)
    assert {t for t, lst in want.items() if lst} == set(by)
    for t, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [(r.train_id, r.distance, r.label) for r in rows] == want[t]
