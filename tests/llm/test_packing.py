"""Packing: bounds against every choice, batches against the rules."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark import SparkContext

from llm_fixtures import edge, edge_rows, empty  # noqa: F401
import corpus_pipeline as P
from proxima.llm.common import small_table
from proxima.llm.packing import BUDGET, optimal_bounds, pack, pack_report
from proxima.llm.queries import tokenizer_path


@pytest.mark.parametrize("seed", range(60))
def test_bounds_have_the_least_padding(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(40), rng.randint(1, 9)))
    counts = [rng.randint(1, 9) for _ in lengths]
    k = rng.randint(1, 5)

    def padding(bounds):
        return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
    least = min(padding((*s, lengths[-1])) for m in range(k) for s in itertools.combinations(lengths[:-1], m))
    got = optimal_bounds(lengths, counts, k)
    assert len(got) <= k and padding(got) == least


def test_no_lengths():
    assert optimal_bounds([], [], 4) == []


def test_batches_keep_the_budget(edge):
    budget, buckets = 500, 4
    got = pack(edge, budget, buckets, keep=["doc_id", "text"]).collect()
    want = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in edge_rows()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
        batches[r.batch].append(r)
    for rows in batches.values():
        assert len({(r.bucket, r.bucket_len) for r in rows if r.n_tokens <= budget}) <= 1
        assert sum(r.bucket_len for r in rows) <= budget or len(rows) == 1
    fits = sorted({n for _, n in want if n <= budget})
    hist = [sum(m == n for _, m in want) for n in fits]
    assert sorted({r.bucket_len for r in got if r.n_tokens <= budget}) == optimal_bounds(fits, hist, buckets)
    # in order of length and id, full batches: as few as can be
    for b in {r.bucket for r in got if r.n_tokens <= budget}:
        mine = [r for r in got if r.bucket == b and r.n_tokens <= budget]
        per = max(1, budget // max(1, mine[0].bucket_len))
        assert len({r.batch for r in mine}) == -(-len(mine) // per)
        order = sorted(mine, key=lambda r: (int(r.batch.split("-")[1]), r.n_tokens))
        assert [r.n_tokens for r in order] == sorted(r.n_tokens for r in mine)


def test_other_columns_are_kept(edge, empty):
    out = pack(edge)
    assert set(edge.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert pack_report(empty).collect() == []


def test_query_and_stage_pack_by_tokens(spark, edge):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(tokenizer_path())

    def tokens(t):
        return len(tk.encode(t or "", add_special_tokens=False).ids)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, tokens(t)) for i, t, *_ in edge_rows()), key=key)
    for out in (pack_report(edge), P.packing(spark, edge, "/nowhere")):
        assert out.columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "padding"]
        assert sorted(((r.doc_id, r.n_tokens) for r in out.collect()), key=key) == want
    # one word of more tokens than the budget shares its batch with nobody
    wide = "漢字仮名" * 2500
    got = pack_report(spark.createDataFrame([(1, wide), (2, "a b"), (3, "c d")], "doc_id bigint, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == tokens(wide) > BUDGET and by[1].batch not in (by[2].batch, by[3].batch)


def test_no_window_over_one_length(spark, capsys):
    rows = [(None if i % 3 == 0 else (i * 0x9E3779B97F4A7C15) % (1 << 62), "") for i in range(3000)] + [(7, "a b")]
    out = pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), budget=100, buckets=2, keep=["doc_id"])
    out.explain()
    assert "Window" not in capsys.readouterr().out
    got = out.collect()
    empties = [r for r in got if r.n_tokens == 0]
    assert len(empties) == 3000
    order = sorted(empties, key=lambda r: int(r.batch.split("-")[1]))
    per = defaultdict(list)
    for r in order:
        per[r.batch].append(r.doc_id)
    flat = [min((x is None, x or 0) for x in ids) for ids in per.values()]
    assert all(len(ids) == 100 for ids in per.values()) and flat == sorted(flat)


def test_small_tables_pass_through_no_python_rdd(spark, edge, monkeypatch):
    """Rows given as tuples go through ``parallelize`` and, on the executors, through a second Python daemon."""
    def refused(*_args, **_kwargs):
        raise AssertionError("rows of the driver pass through a Python RDD")
    want = sorted(map(str, pack_report(edge).collect()))
    none = spark.range(0).selectExpr("id as doc_id", "cast(null as string) as text")
    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert sorted(map(str, pack_report(edge).collect())) == want and want
    assert pack_report(none).collect() == []


def test_small_table(spark):
    out = small_table(spark, [(1, None), (1 << 40, 7)], a=pa.int64(), b=pa.int32())
    assert out.dtypes == [("a", "bigint"), ("b", "int")]
    assert sorted(map(tuple, out.collect())) == [(1, None), (1 << 40, 7)]
    assert small_table(spark, [], a=pa.int64(), b=pa.int32()).dtypes == out.dtypes
