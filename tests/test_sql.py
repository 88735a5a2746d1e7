"""Nearest neighbours as a table function."""

from __future__ import annotations

import pytest

from conftest import frame
from proxima import knn_neighbors
from proxima.plans.sql import register_nearest


def test_same_rows_as_the_api(spark):
    train = frame(spark, [(i, [float(i % 7), float(i % 3)], float(i % 2)) for i in range(60)])
    test = frame(spark, [(i, [i / 3, i / 5]) for i in range(25)], labelled=False)
    register_nearest(spark, "nearest_test", train, 4, max_distance=3.5)
    test.createOrReplaceTempView("points")
    want = sorted(map(tuple, knn_neighbors(train, test, 4, max_distance=3.5).collect()))
    for call in ("TABLE(SELECT row_id, features FROM points)", "TABLE(SELECT row_id, features FROM points) PARTITION BY row_id",
                 "TABLE(SELECT row_id, features FROM points) WITH SINGLE PARTITION"):
        assert sorted(map(tuple, spark.sql(f"SELECT * FROM nearest_test({call})").collect())) == want
    joined = spark.sql("SELECT p.row_id, n.train_id FROM points p JOIN nearest_test(TABLE(SELECT row_id, features FROM points)) n "
                       "ON p.row_id = n.test_id WHERE n.rank = 1")
    assert joined.count() == len({w[0] for w in want})


def test_bad_arguments_raise(spark):
    train = frame(spark, [(i, [float(i), 0.0], 0.0) for i in range(9)])
    register_nearest(spark, "nearest_bad", train, 1)
    for rows in ("SELECT 1L AS a, ARRAY(1D) AS b", "SELECT 1L AS a, CAST(NULL AS ARRAY<DOUBLE>) AS b", "SELECT CAST(NULL AS BIGINT) AS a, ARRAY(1D, 2D) AS b"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM nearest_bad(TABLE({rows}))").collect()
    with pytest.raises(ValueError):
        register_nearest(spark, "nearest_big", train, 1, broadcast_limit=10)
    with pytest.raises(ValueError):
        register_nearest(spark, "nearest_zero", train, 0)
