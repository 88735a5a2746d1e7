"""MinHash near-dedup and components against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from llm_fixtures import close_components, edge, edge_rows, empty  # noqa: F401
from proxima.llm import minhash
from proxima.llm.components import connected_components


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_all_pairs(spark, edge, size):
    rows = [(i, shingles(t, size)) for i, t, *_ in edge_rows()]
    sets = [(i, s) for i, s in rows if i is not None and s]
    links = [(i, j) for n, (i, s) in enumerate(sets) for j, t in sets[n + 1:]
             if 100 * len(s & t) >= 80 * len(s | t)]
    want = close_components({i for i, _ in rows if i is not None}, links)
    got = minhash.near_duplicates(edge, size, 80).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles) for r in got) == sorted(
        (-1 if i is None else i, len(s)) for i, s in rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])


def test_empty_table(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = minhash.signature(u[:2400]), minhash.signature(u[300:])
    assert abs(np.mean(a == b) - 2100 / 3000) < 0.1
    # a long set in slices has the coordinates of the whole
    assert (minhash.signature(u) == np.minimum(minhash.signature(u[:2048]), minhash.signature(u[2048:]))).all()


def test_common_bound_drops_no_link():
    """The bound of round 2 is never below the true intersection."""
    rng = np.random.default_rng(1)
    centre = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = []
    for _ in range(30):
        keep = centre[rng.random(len(centre)) < rng.uniform(0.7, 1)]
        sets.append(np.unique(np.concatenate([keep, rng.choice(1000, 30).astype(np.uint64)])))
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 30), pa.array(range(1, 31)), pa.array([centre.tobytes()] * 30, pa.binary()),
         pa.array([s.tobytes() for s in sets], pa.binary())], names=["a", "b", "x", "y"])
    facts = next(iter(minhash._against_centre(80)([batch]))).to_pylist()
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            bits = sum(int(np.uint64(p & 0xFFFFFFFFFFFFFFFF) & np.uint64(q & 0xFFFFFFFFFFFFFFFF)).bit_count()
                       for p, q in zip(facts[i]["extra"], facts[j]["extra"]))
            most = min(facts[i]["common"], facts[j]["common"]) + bits + min(facts[i]["spare"], facts[j]["spare"])
            assert len(np.intersect1d(s, t)) <= most


@pytest.mark.parametrize("n", [60])
def test_components_of_paths_stars_and_loops(spark, n):
    rng = np.random.default_rng(2)
    path = [(i, i + 1) for i in range(0, n)]
    star = [(1000, 1000 + i) for i in range(1, n)]
    odd = [(5000, 5000), (None, 3), (7, 7)] + [tuple(map(int, rng.integers(2000, 2050, 2))) for _ in range(30)]
    links = path + star + odd
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == close_components({x for l in real for x in l}, real)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_rows_of_a_repeated_id_hang_together(spark):
    a, b, d = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey")
    rows = [(3, a), (5, a), (5, b), (5, ""), (8, b), (9, d), (9, ""), (10, d)]
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id bigint, text string"), 2, 80).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((i, 9 if i > 8 else 3, i in (3, 9)) for i, _ in rows)


def test_stage_keeps_the_same_row_of_a_repeated_id(spark):
    import corpus_pipeline as P
    rows = [(5, t, "en") for t in ("pears and plums and figs", "apples and nuts and figs", "", "zebras run on and on")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, lang string").repartition(3)
        assert [tuple(r) for r in P.near_duplicate(spark, docs, "/nowhere").collect()] == [rows[1]]
