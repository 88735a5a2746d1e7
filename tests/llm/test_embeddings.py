"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from llm_fixtures import close_components
from proxima.llm import embeddings as E

VECTORS = "vec_id bigint, embedding array<float>, label int, core string"


def vectors():
    rng = np.random.default_rng(4)
    rows = []

    def add(v, i=None):
        rows.append((len(rows) * 2 if i is None else i, None if v is None else [None if x is None else float(x) for x in v], 0, "c"))
    for spread in (0.02, 0.05, 0.08, 0.2):                          # from within a core to beyond the threshold
        centre = rng.normal(size=16)
        for _ in range(40):
            add(centre + spread * np.linalg.norm(centre) * rng.normal(size=16) / 4)
    for v in rng.normal(size=(120, 16)):
        add(v)
    copy = rng.normal(size=16).astype(np.float32)
    for k in range(25):
        add(copy * (1 if k % 2 else 2))                             # equal and proportional
    for bad in (None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")]):
        add(bad)
    add([1.0, 0.0])                                                 # another length
    add([1.0, 0.01])
    add([3e38] * 16)
    add([1e-38] * 16)
    add(copy, i=0)                                                  # repeated ids
    add(rng.normal(size=16), i=2)
    add(copy, i=None)
    rows.append((None, [float(x) for x in copy], 0, "c"))
    return rows


def brute(rows, threshold=0.95):
    ok = []
    for n, (i, v, *_) in enumerate(rows):
        if v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v):
            a = np.asarray(v, np.float32).astype(np.float64)
            ok.append((n, a / np.abs(a).max()))
    links = np.zeros(len(rows), int)
    edges = []
    for p, (n, a) in enumerate(ok):
        for m, b in ok[p + 1:]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[n] += 1
                links[m] += 1
                edges.append((n, m))
    comp = close_components(range(len(rows)), edges)
    return links, comp


@pytest.mark.parametrize("piece", [2048, 8])
def test_links_match_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(E, "BUCKET_BLOCK", piece)
    monkeypatch.setattr(E, "SMALL_BUCKET", 64 if piece > 100 else 3)
    monkeypatch.setattr(E, "SHARD_ROWS", piece)
    monkeypatch.setattr(E, "MEMBERS", max(4, piece // 4))
    rows = vectors()
    got = E.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    links, comp = brute(rows)
    ids = [r[0] for r in rows]
    members = {}
    for n, c in comp.items():
        if ids[n] is not None:
            members.setdefault(c, []).append(ids[n])
    want = sorted((-1 if ids[n] is None else ids[n], int(links[n])) for n in range(len(rows)))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links) for r in got) == want
    repeated = {i for i in ids if ids.count(i) > 1}
    for r in got:
        if r.vec_id is not None and r.vec_id not in repeated:
            n = ids.index(r.vec_id)
            assert r.component_id == min(members[comp[n]]) and r.kept == (r.vec_id == r.component_id)


def test_empty_table(spark):
    assert E.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("bits", [4, 9, 13, 17, 25, 33])
@pytest.mark.parametrize("width", [64, 256, 768])
def test_pairs_at_the_threshold_meet(bits, width):
    rng = np.random.default_rng(bits)
    a = rng.normal(size=(500, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(500, width))
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(500, bool)
    for t in range(E.TABLES):
        x, y = E.codes(a, bits, t), E.codes(b, bits, t)
        met |= (x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)
    assert met.mean() > 0.99


def test_sketch_error_bounds_the_cosine():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = E.unsketch([r.tobytes() for r in E.sketch(x)])
    assert np.abs(x @ x.T - y @ y.T).max() <= E.sketch_error(24)
