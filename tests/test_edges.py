"""Edge cases E2..E15 of the behavioural spec, plus ordinals (SRC-3) and sinks (SNK-3)."""

from __future__ import annotations

import random

import pytest

from conftest import SHAPES, frame, shape_id, write_lines
from proxima import knn_classify, knn_neighbors
from proxima.operators.vote import vote as vote_op
from proxima.sources.sinks import write_predictions
from proxima.sources.text import read_vectors


def neighbours_with_labels(spark, labels):
    """Neighbour rows of one test row (id 0) with the given labels, nearest first."""
    rows = [(0, r + 1, 100 + r, float(r), float(lab)) for r, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "test_id bigint, rank int, train_id bigint, distance double, label double")


def one_vote(spark, labels, rule):
    return vote_op(neighbours_with_labels(spark, labels), rule).collect()[0].prediction


def test_e2_vote_tie(spark):
    assert one_vote(spark, [0, 0, 1, 1], "nonzero_majority") == 1
    assert one_vote(spark, [0, 0, 1, 1], "label_sum") == 0


def test_e3_other_labels(spark):
    assert one_vote(spark, [2, 0, 0], "nonzero_majority") == 0
    assert one_vote(spark, [2, 0, 0], "label_sum") == 1
    assert one_vote(spark, [-1, 1, 1], "nonzero_majority") == 1
    assert one_vote(spark, [-1, 1, 1], "label_sum") == 0


def test_e3_label_sum_needs_whole_labels(spark):
    with pytest.raises(Exception):
        one_vote(spark, [0.5, 1, 1], "label_sum")


def test_e4_declared_rows(spark, tmp_path):
    path = write_lines(tmp_path / "train.txt", ["0 0 0", "0 1 0", "3 4 1", "4 3 1", "5 5 1", "0 -1 1"])
    with pytest.raises(ValueError):
        read_vectors(spark, path, expected_rows=7)
    assert read_vectors(spark, path, expected_rows=6).count() == 6


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_e5_fewer_rows_than_k(spark, shape):
    strategy, kernel, block = shape
    tr = frame(spark, [(0, [0.0, 0.0], 1.0), (1, [1.0, 1.0], 0.0)])
    te = frame(spark, [(0, [0.5, 0.0])], labelled=False)
    kw = dict(strategy=strategy, kernel=kernel, block_bytes=block)
    assert knn_classify(tr, te, 5, vote="nonzero_majority", **kw).collect()[0].prediction == 1
    assert knn_classify(tr, te, 5, vote="label_sum", **kw).collect()[0].prediction == 0
    assert len(knn_neighbors(tr, te, 5, **kw).collect()) == 2


@pytest.mark.parametrize("kernel", ["numpy", "sql"])
def test_e6_far_neighbour_and_max_distance(spark, kernel):
    tr = frame(spark, [(0, [2_000_000.0, 0.0], 1.0)])
    te = frame(spark, [(0, [0.0, 0.0])], labelled=False)
    assert knn_classify(tr, te, 1, kernel=kernel).collect()[0].prediction == 1
    got = knn_classify(tr, te, 1, kernel=kernel, max_distance=999999).collect()
    assert len(got) == 1 and got[0].prediction is None


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_e7_nan_never_a_neighbour(spark, shape):
    strategy, kernel, block = shape
    tr = frame(spark, [(0, [float("nan"), 0.0], 1.0), (1, [5.0, 5.0], 0.0)])
    te = frame(spark, [(0, [0.0, 0.0])], labelled=False)
    got = knn_neighbors(tr, te, 2, strategy=strategy, kernel=kernel, block_bytes=block).collect()
    assert [r.train_id for r in got] == [1]


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_e8_no_admissible_neighbour(spark, shape):
    strategy, kernel, block = shape
    tr = frame(spark, [(0, [float("nan"), 0.0], 1.0), (1, [1.0, float("nan")], 1.0)])
    te = frame(spark, [(0, [0.0, 0.0]), (1, [1.0, 1.0])], labelled=False)
    got = knn_classify(tr, te, 1, strategy=strategy, kernel=kernel, block_bytes=block).collect()
    assert sorted(r.test_id for r in got) == [0, 1]
    assert all(r.prediction is None for r in got)


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_e9_identical_rows_any_partitioning(spark, shape):
    strategy, kernel, block = shape
    rows = [(i, [1.0, 2.0, 3.0], float(i % 2)) for i in range(20)]
    random.Random(7).shuffle(rows)
    te = frame(spark, [(0, [0.0, 0.0, 0.0]), (1, [1.0, 2.0, 3.0])], labelled=False)
    for parts in (1, 2, 8):
        tr = frame(spark, rows).repartition(parts)
        got = knn_neighbors(tr, te, 4, strategy=strategy, kernel=kernel, block_bytes=block).collect()
        for t in (0, 1):
            ids = [r.train_id for r in sorted((r for r in got if r.test_id == t), key=lambda r: r.rank)]
            assert ids == [0, 1, 2, 3], (parts, t, ids)


@pytest.mark.parametrize("kernel", ["numpy", "sql"])
def test_e10_width_mismatch_raises(spark, kernel):
    tr = frame(spark, [(0, [0.0, 0.0, 0.0], 1.0), (1, [1.0, 1.0, 1.0], 0.0)])
    te = frame(spark, [(0, [0.0, 0.0])], labelled=False)
    with pytest.raises(Exception):
        knn_classify(tr, te, 1, kernel=kernel).collect()


def test_e11_double_and_leading_space(spark, tmp_path):
    path = write_lines(tmp_path / "v.txt", ["7  8 0", " 5 6 1"])
    with pytest.raises(Exception):
        read_vectors(spark, path, mode="strict").collect()
    got = read_vectors(spark, path, mode="lenient").orderBy("row_id").collect()
    assert [list(r.features) + [r.label] for r in got] == [[7, 8, 0], [5, 6, 1]]


def test_e12_trailing_space(spark, tmp_path):
    path = write_lines(tmp_path / "v.txt", ["3 4 0 "])
    for mode in ("strict", "lenient"):
        r = read_vectors(spark, path, mode=mode).collect()[0]
        assert list(r.features) + [r.label] == [3, 4, 0]


def test_e13_empty_line_modes(spark, tmp_path):
    path = write_lines(tmp_path / "v.txt", ["1 2 0", "", "3 4 1"])
    with pytest.raises(Exception):
        read_vectors(spark, path).collect()
    kept = read_vectors(spark, path, on_error="DROPMALFORMED").orderBy("row_id").collect()
    assert [r.row_id for r in kept] == [0, 2]
    perm = read_vectors(spark, path, on_error="PERMISSIVE").orderBy("row_id").collect()
    assert perm[1].features is None and perm[1].label is None and perm[1]._corrupt_record == ""
    assert perm[0]._corrupt_record is None


def test_e14_ragged_rows_never_padded(spark, tmp_path):
    path = write_lines(tmp_path / "v.txt", ["1 2 0", "3 4", "5 6 7 1"])
    with pytest.raises(Exception):
        read_vectors(spark, path, mode="lenient").collect()
    kept = read_vectors(spark, path, mode="lenient", on_error="DROPMALFORMED").collect()
    assert [list(r.features) for r in kept] == [[1, 2]]
    kept = read_vectors(spark, path, mode="strict", dim=3, on_error="DROPMALFORMED").collect()
    assert [list(r.features) for r in kept] == [[1, 2]]


def test_e15_k_must_be_positive(spark):
    tr = frame(spark, [(0, [0.0], 1.0)])
    te = frame(spark, [(0, [0.0])], labelled=False)
    for k in (0, -1):
        with pytest.raises(ValueError):
            knn_classify(tr, te, k)
        with pytest.raises(ValueError):
            knn_neighbors(tr, te, k)


def test_unknown_vote_and_strategy(spark):
    tr = frame(spark, [(0, [0.0], 1.0)])
    te = frame(spark, [(0, [0.0])], labelled=False)
    with pytest.raises(ValueError):
        knn_classify(tr, te, 1, vote="mean")
    with pytest.raises(ValueError):
        knn_classify(tr, te, 1, strategy="nearest")


def test_src3_ordinals_follow_file_then_line(spark, tmp_path):
    d = tmp_path / "two"
    d.mkdir()
    write_lines(d / "a.txt", [f"{i} {i % 2}" for i in range(3000)])
    write_lines(d / "b.txt", [f"{3000 + i} {i % 2}" for i in range(1500)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        v = read_vectors(spark, str(d))
        assert v.rdd.getNumPartitions() > 2
        got = v.select("row_id", v.features[0].alias("x")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4500
    assert all(r.row_id == int(r.x) for r in got)


@pytest.mark.parametrize("conf", [{"spark.sql.files.maxPartitionBytes": ("9000", "6000")},
                                  {"spark.sql.files.openCostInBytes": ("0", "0"),
                                   "spark.sql.leafNodeDefaultParallelism": ("4", "7")}], ids=["bytes", "parallelism"])
def test_src3_split_plan_may_change_before_the_action(spark, tmp_path, conf):
    d = tmp_path / "two"
    d.mkdir()
    write_lines(d / "a.txt", [f"{i} {i % 2}" for i in range(4000)])
    write_lines(d / "b.txt", [f"{4000 + i} {i % 2}" for i in range(2000)])
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, (at_build, _) in conf.items():
            spark.conf.set(k, at_build)
        v = read_vectors(spark, str(d))
        for k, (_, at_action) in conf.items():
            spark.conf.set(k, at_action)
        got = v.select("row_id", v.features[0].alias("x")).collect()
    finally:
        for k, value in old.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    assert len(got) == 6000 and all(r.row_id == int(r.x) for r in got)


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_ids_null_large_and_repeated(spark, shape):
    strategy, kernel, block = shape
    kw = dict(strategy=strategy, kernel=kernel, block_bytes=block)
    big = 2**53 + 1
    tr = frame(spark, [(big, [0.0, 0.0], 1.0), (3, [9.0, 9.0], 0.0)])
    te = frame(spark, [(big + 2, [0.0, 0.0])], labelled=False)
    assert [(r.test_id, r.train_id) for r in knn_neighbors(tr, te, 1, **kw).collect()] == [(big + 2, big)]
    null_te = spark.createDataFrame([(None, [0.0, 0.0]), (big, [1.0, 1.0])], "row_id bigint, features array<double>")
    with pytest.raises(Exception, match="NULL row_id"):
        knn_neighbors(tr, null_te, 1, **kw).collect()
    twice = frame(spark, [(5, [0.0, 0.0]), (5, [1.0, 1.0])], labelled=False)
    with pytest.raises(ValueError, match="unique"):
        knn_classify(tr, twice, 1, **kw)


def test_null_vector_names_its_row(spark):
    tr = frame(spark, [(0, [0.0, 0.0], 1.0)])
    te = spark.createDataFrame([(7, None)], "row_id bigint, features array<double>")
    with pytest.raises(Exception, match="test vector of row 7 has no values"):
        knn_classify(tr, te, 1, dim=2).collect()


@pytest.mark.parametrize("dim", [128, 129])
def test_distance_forms_agree_around_the_unroll_limit(spark, dim):
    from proxima.functions.vectors import euclidean
    row = spark.createDataFrame([([i * 0.1 for i in range(dim)], [i * 0.3 + 1 for i in range(dim)])],
                                "a array<double>, b array<double>")
    r = row.select(euclidean("a", "b", dim).alias("x"), euclidean("a", "b").alias("y")).collect()[0]
    assert r.x == r.y


def test_released_frees_scratch_and_broadcasts(spark, tmp_path):
    import os
    from proxima.session import released, scratch_root
    path = write_lines(tmp_path / "v.txt", ["1 2 0", "3 4 1"])
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with released():
        assert read_vectors(spark, path).count() == 2
        assert set(os.listdir(root)) != before
    assert set(os.listdir(root)) == before


def test_snk_layouts_and_no_clobber(spark, tmp_path):
    pred = spark.createDataFrame([(0, 1), (1, 0), (2, None)], "test_id bigint, prediction int")
    p1 = write_predictions(pred, str(tmp_path / "pairs"), "pairs")
    assert sorted(r.value for r in spark.read.text(p1).collect()) == ["(0,1)", "(1,0)", "(null,2)"]
    p2 = write_predictions(pred, str(tmp_path / "rows"), "rows", params={"k": 5, "dim": 3})
    back = spark.read.text(p2).collect()
    assert sorted(r.value for r in back) == ["0 1", "1 0", "2 null"]
    assert {(r.k, r.dim) for r in back} == {(5, 3)}
    with pytest.raises(Exception):
        write_predictions(pred, p1, "pairs")
    p3 = write_predictions(pred, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(p3).count() == 3


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_empty_sides(spark, shape):
    strategy, kernel, block = shape
    kw = dict(strategy=strategy, kernel=kernel, block_bytes=block, dim=2)
    empty_tr = spark.createDataFrame([], "row_id bigint, features array<double>, label double")
    empty_te = spark.createDataFrame([], "row_id bigint, features array<double>")
    tr = frame(spark, [(0, [0.0, 0.0], 1.0), (1, [1.0, 1.0], 0.0)])
    te = frame(spark, [(5, [0.0, 1.0])], labelled=False)
    got = knn_classify(empty_tr, te, 3, **kw).collect()
    assert [(r.test_id, r.prediction) for r in got] == [(5, None)]
    assert knn_neighbors(empty_tr, te, 3, **kw).collect() == []
    assert knn_classify(tr, empty_te, 3, **kw).collect() == []
    assert knn_neighbors(tr, empty_te, 3, **kw).collect() == []


@pytest.mark.parametrize("shape", SHAPES, ids=shape_id)
def test_null_label_does_not_vote(spark, shape):
    """A neighbour without a label is reported with a NULL label and left out of the vote."""
    strategy, kernel, block = shape
    tr = spark.createDataFrame([(0, [0.0, 0.0], None), (1, [1.0, 0.0], 0.0), (2, [0.0, 2.0], 1.0),
                                (3, [9.0, 9.0], 1.0)],
                               "row_id bigint, features array<double>, label double")
    te = frame(spark, [(0, [0.0, 0.0])], labelled=False)
    kw = dict(strategy=strategy, kernel=kernel, block_bytes=block)
    neigh = sorted(knn_neighbors(tr, te, 2, **kw).collect(), key=lambda r: r.rank)
    assert [(r.train_id, r.label) for r in neigh] == [(0, None), (1, 0.0)]
    # votes over the labelled neighbour only: one 0 -> nonzero 0, label_sum 0
    assert knn_classify(tr, te, 2, vote="nonzero_majority", **kw).collect()[0].prediction == 0
    # k = 3: labels None, 0, 1 -> one each: nonzero tie -> 1
    assert knn_classify(tr, te, 3, vote="nonzero_majority", **kw).collect()[0].prediction == 1
