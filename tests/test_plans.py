"""Physical plan shapes: where the exchanges are, and where the top-k cut happens."""

from __future__ import annotations

import contextlib
import io
import sys

from dataclasses import replace

import pytest

from conftest import frame
from proxima.operators import candidates as C
from proxima.plans.classify import choose_plan, classify_for, neighbours_for


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture()
def sides(spark):
    tr = frame(spark, [(i, [float(i), float(i % 7)], float(i % 2)) for i in range(200)])
    te = frame(spark, [(i, [float(i) / 3, 1.0]) for i in range(50)], labelled=False)
    return C.prepare_train(tr, dim=2), C.prepare_test(te, dim=2)


def test_sql_kernel_leaves_the_cut_to_the_window(sides):
    tr, te = sides
    for strategy in ("broadcast_train", "broadcast_test", "block"):
        plan = choose_plan(tr, te, 2, strategy, "sql", block_bytes=256)
        text = plan_text(neighbours_for(tr, te, 5, plan))
        assert "Window" in text
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_block_grid_has_many_groups(sides, spark):
    tr, te = sides
    plan = choose_plan(tr, te, 2, "block", block_bytes=256)
    assert plan.test_blocks * plan.train_blocks >= 4 * spark.sparkContext.defaultParallelism
    assert plan.block_partitions >= plan.partitions or plan.block_partitions == plan.test_blocks * plan.train_blocks


def test_no_query_forms_pairs(spark, monkeypatch):
    """Neither the plan of any registered query nor that of a table it writes on the way joins all with all."""
    from proxima.plans.queries import QUERIES
    from proxima.session import written
    seen = []

    def watched(df, name):
        seen.append((name, plan_text(df)))
        return written(df, name)
    for module in [m for n, m in sys.modules.items() if n.startswith("proxima.") and n != "proxima.session" and not n.startswith("proxima.llm")]:
        if getattr(module, "written", None) is written:
            monkeypatch.setattr(module, "written", watched)
    for name, query in QUERIES.items():
        seen.append((name, plan_text(query(spark, "/root/testdata/sf0.001"))))
    assert {n for n, _ in seen} >= set(QUERIES) | {"lines", "entries", "pivot-test", "pivot-train", "annuli-needs", "document-vectors"}
    for name, text in seen:
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text, name


def test_stage_counts_and_stats_need_no_exchange_of_the_test_side(spark):
    from proxima.plans.queries import QUERIES
    text = plan_text(QUERIES["stage_counts"](spark, "/root/testdata/sf0.001"))
    assert text.count("MapInArrow") == 1 and "CoGroups" not in text


def test_numpy_broadcast_train_classify_is_map_only(sides, spark):
    tr, te = sides
    plan = choose_plan(tr, te, 2, "broadcast_train", "numpy")
    assert plan.spread_test  # a small test side is spread over every core ...
    text = plan_text(classify_for(tr, te, 5, plan, "nonzero_majority"))
    assert "MapInArrow" in text and text.count("Exchange") == 1
    # ... a large one is read in place: no exchange at all
    text = plan_text(classify_for(tr, te, 5, replace(plan, spread_test=False), "nonzero_majority"))
    assert "MapInArrow" in text and "Exchange" not in text


def test_auto_respects_broadcast_limit(sides):
    tr, te = sides
    assert choose_plan(tr, te, 2).strategy == "broadcast_train"
    assert choose_plan(tr, te, 2, broadcast_limit=50 * 48).strategy == "broadcast_test"
    p = choose_plan(tr, te, 2, broadcast_limit=100, block_bytes=1024)
    assert p.strategy == "pivot"  # neither side fits: pruned pivot join on the NumPy kernel
    assert choose_plan(tr, te, 2, broadcast_limit=0).strategy == "pivot"  # 0 turns broadcasts off
    with pytest.raises(ValueError):
        choose_plan(tr, te, 2, "broadcast_train", broadcast_limit=100)


def test_auto_avoids_test_broadcast_whose_partial_output_outgrows_train(sides):
    tr, te = sides  # 200 train rows, 50 test rows of 2 values (48 bytes each)
    limit = 50 * 48
    assert choose_plan(tr, te, 2, broadcast_limit=limit, k=3).strategy == "broadcast_test"
    # 8 train tasks x 50 test rows x 3 > 200 train rows: the pruned join moves less
    assert choose_plan(tr, te, 2, broadcast_limit=limit, block_bytes=1200, k=3).strategy == "pivot"


def test_no_scan_reads_unused_columns(spark):
    from proxima.plans.queries import QUERIES
    text = plan_text(QUERIES["feature_label_split"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in text


def test_spread_follows_estimated_input_splits(sides, spark):
    """A side is spread only when its bytes would arrive in fewer splits than two per core."""
    tr, te = sides  # 9600 and 2400 bytes of rows
    cores = spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        plan = choose_plan(tr, te, 2)
        assert plan.spread_test and plan.spread_train  # one split each: spread
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(9600 // (2 * cores)))
        plan = choose_plan(tr, te, 2)
        assert not plan.spread_train and plan.spread_test  # train now brings 2 splits per core
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
