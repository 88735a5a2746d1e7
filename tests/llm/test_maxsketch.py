"""Ranked search against a plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import edge, empty  # noqa: F401
from proxima.llm import maxsketch as M

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string, rank string, score string"


def found(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    texts = [(i, found(t)) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n, total = len(texts), sum(len(t) for _, t in texts)
    df = Counter(x for _, t in texts for x in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in texts]
    out = []
    for item, text in items:
        scored = []
        for i, size, tf in counts:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m))
                    for x in set(found(text)) if x in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for r, (s, null, i) in enumerate(sorted(scored)[:k]):
            out.append((item, r + 1, None if null else i, -s))
    return sorted(out, key=str)


def items_of(rows):
    rng = random.Random(3)
    texts = [t for _, t, *_ in rows if t]
    out = [(i, " ".join(found(rng.choice(texts))[:rng.randrange(1, 90)])) for i in range(40)]
    out += [(100, None), (101, ""), (102, "?! --"), (103, "nosuchterm"), (104, "漢字 X"), (105, "X x x"), (105, "X x x"), (None, "one two"), (106, "don't ünïcödé")]
    return out


@pytest.mark.parametrize("k", [50, 3])
@pytest.mark.parametrize("small", [False, True])
def test_ranks_match_brute_force(spark, edge, monkeypatch, k, small):
    if small:                       # several batches of queries, several blocks, short steps
        monkeypatch.setattr(M, "QUERY_BYTES", 2000)
        monkeypatch.setattr(M, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(M, "CELLS", 100)
        monkeypatch.setattr(M, "STEP", 2)
    docs = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    items = items_of(docs)
    table = spark.createDataFrame([(i, t, "a", "b") for i, t in items], ITEMS)
    got = M.ranked_search(edge, table, k).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items, k)


def test_bounds_never_fall_below_scores_and_prune():
    """Documents of a skewed vocabulary: bounds hold, and far fewer pairs are scored than there are."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = [" ".join(rng.choice(vocabulary, rng.integers(5, 300), p=_zipf(3000))) for _ in range(1500)]
    queries = [(i, " ".join(docs[i * 7].split()[:30])) for i in range(60)]
    q = M.Queries.of(queries)
    data = [np.frombuffer(t.encode(), np.uint8) for t in docs]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    data = np.concatenate(data)
    c = M.Counted.of(data, off)
    n, total = int((c.n > 0).sum()), int(c.n.sum())
    known = q.vocabulary
    df = np.array([(c.hash == h).sum() for h in known])
    q = q.weighted(n, df)
    impact = M.impacts(c, n, total)
    bound = M.Sketches.of(c, impact).bounds(q)
    text, query = np.nonzero(np.ones(bound.shape, bool))
    exact = M.exact_scores(c, impact, text, query, q).reshape(bound.shape)
    assert (bound >= exact).all()
    best = M.Best(len(queries), 10)
    for s in range(0, len(docs), 100):
        cut = off[s: s + 101]
        ids = np.arange(s, min(s + 100, len(docs)))
        best.take_block(data[cut[0]: cut[-1]], cut - cut[0], ids, np.zeros(len(ids), bool), q, n, total)
    assert best.scored < 0.4 * bound.size
    for i in range(len(queries)):
        want = sorted((-exact[d, i], d) for d in range(len(docs)) if exact[d, i] > 0)[:10]
        at = best.query == i
        assert sorted(zip((-best.score[at]).tolist(), best.doc[at].tolist())) == want


def _zipf(n):
    p = 1 / np.arange(1, n + 1)
    return p / p.sum()


def test_ties_go_to_the_lower_id(spark):
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(500, 0, -1)] + [(1000, "gamma")], "doc_id bigint, text string").repartition(7)
    got = M.ranked_search(docs, spark.createDataFrame([(1, "beta")], "item_id bigint, text string"), 5).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 6)]


def test_empty_tables(spark, empty, edge):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert M.ranked_search(empty, items).collect() == []
    assert M.ranked_search(edge, items.where("false")).collect() == []
