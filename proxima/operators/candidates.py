"""Frames of the kNN operators and how their rows are dealt to tasks.

Frames flowing between operators use fixed column names:

* train      ``train_id BIGINT, train_features ARRAY<DOUBLE>, label DOUBLE``
* entries    the same with ``rows ARRAY<STRUCT<train_id, label>>`` for ``label``: the train rows of one vector
* test       ``test_id BIGINT, test_features ARRAY<DOUBLE>``
* candidates ``test_id, train_id, distance DOUBLE, label``: at most k winners per test row and task

Row ids are never NULL (a NULL id raises) and unique on each side (``plans/classify.py`` checks it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.functions.vectors import checked_dim

TEST_ID, TRAIN_ID = "test_id", "train_id"
TEST_F, TRAIN_F = "test_features", "train_features"
ROWS = "rows"


def tail_of(train: DataFrame) -> str:
    """The last train column: ``label``, or ``rows`` of entries."""
    return ROWS if ROWS in train.columns else "label"


def checked_id(row_id: str, what: str) -> Column:
    """The row id as BIGINT; a NULL one raises when the row is read."""
    c = F.col(row_id).cast("bigint")
    return F.coalesce(c, F.raise_error(F.lit(f"{what} row with a NULL {row_id}")).cast("bigint"))


def prepare_train(df: DataFrame, features: str = "features", label: str = "label",
                  row_id: str = "row_id", dim: int | None = None) -> DataFrame:
    """Rename a labelled frame to the train contract; with ``dim``, check every row's width."""
    f = F.col(features).cast("array<double>")
    if dim is not None:
        f = checked_dim(f, dim, "train vector", row_id)
    return df.select(checked_id(row_id, "train").alias(TRAIN_ID), f.alias(TRAIN_F),
                     F.col(label).cast("double").alias("label"))


def prepare_test(df: DataFrame, features: str = "features", row_id: str = "row_id",
                 dim: int | None = None) -> DataFrame:
    """Rename an unlabelled frame to the test contract; with ``dim``, check every row's width."""
    f = F.col(features).cast("array<double>")
    if dim is not None:
        f = checked_dim(f, dim, "test vector", row_id)
    return df.select(checked_id(row_id, "test").alias(TEST_ID), f.alias(TEST_F))


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Round-robin ``df`` over ``partitions`` tasks, or leave it where it lies (``None``).

    The plan passes a count only for a side small enough to move cheaply: such a side may
    arrive as a single parquet row group, which would put a CPU-bound stage on one core.
    """
    return df if partitions is None else df.repartition(partitions)


def block_of(id_col: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks).cast("bigint"))


def replicate(blocks: int):
    """Every block number 0..blocks-1, as BIGINT rows (to be exploded)."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))


def block_rows(df: DataFrame, id_col: str, own_blocks: int, other_blocks: int,
               own: str, other: str) -> DataFrame:
    """Rows tagged with their own block and copied once per block of the other side."""
    return df.select("*", block_of(id_col, own_blocks).alias(own),
                     replicate(other_blocks).alias(other))
