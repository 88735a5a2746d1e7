"""Search by boxes for narrow vectors: the rows of the plain kernel, from a number of pairs that grows with the rows."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import frame
from proxima.operators import boxes as B
from proxima.operators import vectorized as V
from proxima.operators.candidates import prepare_test, prepare_train
from proxima.plans import classify as K


def canon(found, ids, k):
    qi, ri, d = found
    order, _ = V.rank_cut(qi, d, ids[ri], k)
    return qi[order].tobytes(), ids[ri[order]].tobytes(), d[order].tobytes()


def data(kind, rng, n, m, d):
    r, q = rng.normal(size=(n, d)), rng.normal(size=(m, d))
    if kind == "ties":
        r, q = rng.integers(0, 4, (n, d)).astype(float), rng.integers(0, 4, (m, d)).astype(float)
    elif kind == "copies":
        r = r[rng.integers(0, n // 20, n)]
        q[:] = r[rng.integers(0, n, m)]
    elif kind == "far":
        q += 1e6
    elif kind == "huge":
        r, q = r * 1e154, q * 1e154
    elif kind == "tiny":
        r, q = r * 1e-160, q * 1e-160
    elif kind == "not finite":
        r[rng.integers(0, n, 50)], r[: n // 3], r[5, 0], q[3, 0] = np.nan, 0, np.inf, np.inf
    return q, r


@pytest.mark.parametrize("kind", ["normal", "ties", "copies", "far", "huge", "tiny", "not finite"])
@pytest.mark.parametrize("seed", range(4))
def test_same_as_plain(monkeypatch, kind, seed):
    rng = np.random.default_rng(seed)
    n, m, d, k = int(rng.integers(1024, 4000)), int(rng.integers(300, 900)), int(rng.integers(1, 9)), [1, 5, 70, 8][seed]
    q, r = data(kind, rng, n, m, d)
    ids, bound = rng.permutation(n).astype(np.int64), [np.inf, 1.0, 99.0, 0.0][seed]
    with np.errstate(all="ignore"):
        got = canon(V.tree_topk(q, B.BoxTree.of(r, ids, k), k, bound), ids, k)
        monkeypatch.setattr(V, "TREE_DIM", 0)
        assert got == canon(V.block_topk(q, r, ids, k, bound), ids, k)


def program_rows(rng, n, m):
    """Train rows in a strip and test rows far along it, as in the programs."""
    def side(keys):
        return np.stack([keys, rng.integers(0, 25, len(keys)), rng.uniform(-1e3, 1e4, len(keys))], axis=1).astype(float)
    return side(np.arange(n)), side(np.sort(rng.choice(15 * n, m, replace=False)))


def test_pairs_grow_with_the_rows(monkeypatch):
    """Four times the train rows: no more than a little more for each query (the plain kernel computes all pairs)."""
    cells, whole = [], B.squares
    monkeypatch.setattr(B, "squares", lambda q, t: cells.append(len(q) * t.shape[1]) or whole(q, t))
    monkeypatch.setattr(V, "distance_block", lambda *a: pytest.fail("a whole chunk was computed"))
    each = []
    for n in (20_000, 80_000):
        train, test = program_rows(np.random.default_rng(1), n, n)
        cells.clear()
        V.block_topk(test, train, np.arange(n), 4, np.inf)
        each.append(sum(cells) / n)
    assert each[1] < 1.3 * each[0] and each[1] < 0.1 * 80_000


def test_unsorted_ids_and_wide_vectors_without_copies(monkeypatch):
    """Sorted wide vectors are searched where they lie: no copy of the train side by dimension."""
    rng = np.random.default_rng(2)
    r = rng.normal(size=(3000, 64))
    monkeypatch.setattr(V.np, "ascontiguousarray", lambda *a: pytest.fail("the train side was copied"))
    ids = np.arange(3000)
    qi, ri, _ = V.block_topk(r[:50], r, ids, 1, np.inf)
    assert ri.tolist() == list(range(50))
    back = ids[::-1].copy()
    qi, ri, _ = V.block_topk(r[:50], r, back, 1, np.inf)
    assert ri.tolist() == list(range(50))


@pytest.fixture(scope="module")
def sides(spark):
    train, test = program_rows(np.random.default_rng(3), 3000, 2000)
    train[100:1100] = train[0]                                    # a third of copies
    ids = np.random.default_rng(4).permutation(3000)
    tr = [(int(i), x, float(i % 3)) for i, x in zip(ids, train.tolist())] + [(5000, [float("nan"), 0.0, 0.0], 1.0)]
    te = [(i, x) for i, x in enumerate(test.tolist())] + [(9000 + i, train[0].tolist()) for i in range(5)] + [(9999, [float("inf")] * 3)]
    r = {"x": np.array([x for _, x, _ in tr]), "ids": np.array([i for i, _, _ in tr])}
    q = np.array([x for _, x in te])
    old, V.TREE_DIM = V.TREE_DIM, 0
    qi, ri, d = V.block_topk(q, r["x"], r["ids"], 5, np.inf)
    V.TREE_DIM = old
    want = sorted((te[a][0], float(v), int(r["ids"][b])) for a, b, v in zip(qi, ri, d))
    return frame(spark, tr), frame(spark, te, labelled=False), want


@pytest.mark.parametrize("strategy,limit", [("broadcast_train", None), ("broadcast_test", None), ("broadcast_test", 40_000), ("pivot", None)])
@pytest.mark.parametrize("collapse", [False, True])
def test_every_shape(spark, sides, strategy, limit, collapse):
    """Also a test side over the broadcast limit, which goes in slices."""
    train, test, want = sides
    got = K.knn_neighbors(train, test, 5, strategy=strategy, broadcast_limit=limit, collapse=collapse)
    assert sorted((r.test_id, r.distance, r.train_id) for r in got.collect()) == want


def test_far_rows_travel_to_few_parts(spark, tmp_path, monkeypatch):
    """The pivot join of the programs: test rows far from all train rows meet a few parts, not all train rows."""
    from proxima.operators import pivot as P
    rng = np.random.default_rng(5)
    train, test = program_rows(rng, 3000, 1500)
    test[:, 0] += 45_000
    seen, whole = [], P.by_cells
    monkeypatch.setattr(P, "by_cells", lambda t, r, tests, trains, *a, **kw: seen.append(int((tests * trains).sum())) or whole(t, r, tests, trains, *a, **kw))
    tr = prepare_train(frame(spark, [(i, x, 0.0) for i, x in enumerate(train.tolist())]), dim=3)
    te = prepare_test(frame(spark, list(enumerate(test.tolist())), labelled=False), dim=3)
    K.neighbours_for(tr, te, 4, K.choose_plan(tr, te, 3, "pivot", k=4)).count()
    assert seen and seen[0] < 0.2 * 3000 * 1500


def test_wide_blocks_are_searched_piece_by_piece(monkeypatch):
    """Sorting out equal queries copies them: a block's test rows go in pieces, with the same rows in the end."""
    import pyarrow as pa
    rng = np.random.default_rng(6)
    x, ids = rng.normal(size=(300, 20)), rng.permutation(300)
    left = pa.table({"test_id": np.arange(300), "test_features": pa.array(x.tolist())})
    right = pa.table({"train_id": ids, "train_features": pa.array(x.tolist()), "label": np.zeros(300)})
    want = V.neighbours_table(np.arange(300), *V.winners(x, V.train_block(right.column(0), right.column(1), right.column(2), 20), 3, np.inf))
    monkeypatch.setattr(V, "QUERY_ROWS", 64)
    sizes, whole = [], V.winners
    monkeypatch.setattr(V, "winners", lambda q, *a: sizes.append(len(q)) or whole(q, *a))
    assert V.block_kernel(3, 20, np.inf)(left, right).to_pydict() == want.to_pydict()
    assert max(sizes) == 64 and sum(sizes) == 300


def test_cells_follow_each_other_closely():
    """Copies, rows that are not finite and an empty sample all have a cell."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(4000, 3)), np.zeros((500, 3)), [[np.nan, 0, 0], [np.inf, -np.inf, 1]]])
    cell = B.cell_of(x, B.median_cuts(x[:4500], 6))
    assert 0 <= cell.min() and cell.max() < 64 and len(np.unique(cell)) > 50
    assert len(np.unique(cell[4000:4500])) == 1
    assert not B.cell_of(x, B.median_cuts(x[:0])).any()


@pytest.mark.parametrize("vote", [None, "nonzero_majority"])
def test_many_test_rows_are_searched_near_each_other(spark, monkeypatch, vote):
    """With train broadcast: a group of test rows meets train rows near it, not a share of them all, however many there are."""
    rng = np.random.default_rng(8)
    train, test = rng.random((2000, 2)), rng.random((6000, 2))
    test[:40] = test[0]
    test[50] = np.nan
    monkeypatch.setattr(V, "HELD_QUERIES", 256)
    tr = prepare_train(frame(spark, [(i, x, float(i % 2)) for i, x in enumerate(train.tolist())]), dim=2)
    te = prepare_test(frame(spark, list(enumerate(test.tolist())), labelled=False), dim=2)
    plan = K.choose_plan(tr, te, 2, "broadcast_train", k=3)
    got = (K.neighbours_for(tr, te, 3, plan) if vote is None else K.classify_for(tr, te, 3, plan, vote)).collect()
    qi, ri, d = V.block_topk(test, train, np.arange(2000), 3, np.inf)
    if vote is None:
        assert sorted((r.test_id, r.train_id, r.distance) for r in got) == sorted(zip(qi.tolist(), ri.tolist(), d.tolist()))
    else:
        ones = np.bincount(qi, weights=ri % 2, minlength=6000)
        want = [None if i == 50 else int(ones[i] >= 2) for i in range(6000)]
        assert [r.prediction for r in sorted(got)] == want
    at = test[list(dict.fromkeys(r.test_id for r in got if r.test_id != 50))]
    area = [np.prod(np.ptp(at[s: s + 128], axis=0)) for s in range(0, len(at), 128)]
    assert np.mean(area) < 0.25
