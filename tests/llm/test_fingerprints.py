"""Syncmer fingerprints: definition, likeness and the pairs of neighbouring documents."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from llm_fixtures import edge, edge_rows, empty  # noqa: F401
from proxima.llm import fingerprints as P


def plain_anchors(text, k=P.K, s=P.S):
    out = []
    for i in range(len(text) - k + 1):
        inner = [int(P._runs(P.mix(P.code_points(text[j: j + s]).astype(np.uint64) + np.uint64(1)), s)[0]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers_and_know_no_context():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdé \U0001f600") for _ in range(300))
    h, at = P.anchors(text)
    assert at.tolist() == plain_anchors(text)
    more, places = P.anchors("zz" * 40 + text)
    assert set(zip(h.tolist(), (at + 80).tolist())) <= set(zip(more.tolist(), places.tolist()))


def test_segments_change_nothing(monkeypatch):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(3000))
    whole = P.fingerprint(text)
    monkeypatch.setattr(P, "SEGMENT", 100)
    assert P.fingerprint(text) == whole


@pytest.mark.parametrize("n", [0, 1, 3, 20, 63, 64, 90, 5000])
def test_edited_sketch_is_that_of_the_edited_text(n):
    rng = random.Random(n)
    text, other = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for _ in range(2))
    cut = n // 3
    edited = text[: n - cut] + other[:cut]
    assert P.edited_sketch(text, *P.anchors(text), edited, n - cut) == P.fingerprint(edited)
    if n >= 20:
        own = P.fingerprint(text)
        assert P.likeness(own, own) == 1.0
        assert P.likeness(own, P.fingerprint(edited)) > 0.3
        assert P.likeness(own, P.fingerprint("".join(rng.choice("abcdefgh ") for _ in range(n)))) < 0.3
    assert P.likeness("", "") == 1.0 and P.likeness("", P.fingerprint("x")) == 0.0


def test_pairs_match_brute_force(edge):
    # equal ids: ordered by the text's digest, as the operator states only that they stand together
    rows = [(i, t or "") for i, t, *_ in edge_rows()]
    got = P.edited_pairs(edge).collect()
    assert len(got) == len(rows)
    singles = sorted((r for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1), reverse=True)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    single_ids = {i for i, _ in singles}
    text = dict(singles)
    checked = 0
    for a, b in zip(ids, ids[1:]):
        if a in single_ids and b in single_ids:
            t, nxt, r = text[a], text[b], by[a]
            cut = len(t) // 3
            edited = t[: len(t) - cut] + nxt[:cut]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (P.fingerprint(t), P.fingerprint(edited))
            assert r.near_edited == P.likeness(r.fingerprint, r.edited_fingerprint)
            assert r.near_next == P.likeness(r.fingerprint, P.fingerprint(nxt))
            checked += 1
    assert checked > 20


def test_last_document_is_followed_by_the_first(spark, empty):
    docs = spark.createDataFrame([(i, f"text number {i} " * 20) for i in (1, 5, 9)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in P.edited_pairs(docs).collect()}
    t, first = "text number 1 " * 20, "text number 9 " * 20
    cut = len(t) // 3
    assert got[1].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + first[:cut]).encode()).hexdigest()
    one = P.edited_pairs(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert P.edited_pairs(empty).collect() == []
    assert P.fingerprints(empty).collect() == []


def test_range_search(spark):
    bounds = [3, 7, 7 + 1, 20, 21, 40, 41, 90]
    df = spark.createDataFrame([(i,) for i in range(-2, 100)], "id bigint")
    for b in (bounds, bounds[:1], []):
        for r in df.select("id", P._range_of(b).alias("n")).collect():
            assert r.n == sum(x < r.id for x in b)


@pytest.mark.parametrize("n", [20_000, 100_000, 400_000])
def test_shared_passage_of_long_texts(n):
    rng = random.Random(n)

    def letters(k):
        return "".join(rng.choices("abcdefghijklmnop ", k=k))
    passage = letters(2000)
    a, b = (letters(at) + passage + letters(n - at - 2000) for at in (n // 5, n // 2))
    assert 0.6 * 2000 / n < P.likeness(P.fingerprint(a), P.fingerprint(b)) < 1.5 * 2000 / n
    assert P.likeness(P.fingerprint(letters(n)), P.fingerprint(b)) < 0.2 * 2000 / n
    # as many anchors for a letter, whatever the length
    assert len(P.fingerprint(a)) / 16 > 0.8 * n * 2 / 9 / 8


@pytest.mark.parametrize("short, long", [(62, 66), (63, 64), (50, 70), (60, 120), (40, 100), (63, 250)])
def test_likeness_on_both_sides_of_the_anchor_sizes(short, long):
    rng = random.Random(short)
    for _ in range(5):
        text, other = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(long)) for _ in range(2))
        near = P.likeness(P.fingerprint(text[:short]), P.fingerprint(text))
        assert 0.5 * short / long < near <= 1.0 and near == P.likeness(P.fingerprint(text), P.fingerprint(text[:short]))
        assert P.likeness(P.fingerprint(other[:short]), P.fingerprint(text)) < 0.3 * short / long


def test_edited_text_crosses_the_anchor_sizes(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(70))
    rows = P.edited_pairs(spark.createDataFrame([(2, text), (1, "x y z")], "doc_id bigint, text string")).collect()
    got = {r.doc_id: r for r in rows}[2]
    assert got.edited_fingerprint == P.fingerprint(text[:47] + "x y z") and got.near_edited > 0.4
