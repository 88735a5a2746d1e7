"""Class votes over the neighbours of each test row.

Two rules, both from the original programs:

* ``nonzero_majority`` -- count neighbours labelled 0 and the rest; predict 1 when the rest
  are at least as many (an even split predicts 1).
* ``label_sum`` -- add the labels; predict 1 when twice the sum exceeds the number of
  neighbours (an even split predicts 0, a label 2 counts twice, -1 subtracts).  Labels must be
  whole numbers.

A test row with fewer than k admissible neighbours votes over the ones it has; a row with none
gets a NULL prediction and is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = ("nonzero_majority", "label_sum")


def check_vote(vote: str) -> str:
    if vote not in VOTES:
        raise ValueError(f"vote must be one of {VOTES}, got {vote!r}")
    return vote


def _whole(label: Column) -> Column:
    return F.when(label.isNull() | (label == F.floor(label)), label).otherwise(
        F.raise_error(F.concat(F.lit("label_sum needs whole-number labels, got "),
                               label.cast("string"))))


def vote_expr(vote: str, label: str = "label") -> Column:
    """Aggregate expression giving the prediction of one group of neighbours."""
    check_vote(vote)
    lab = F.col(label)
    n = F.count(lab)
    if vote == "nonzero_majority":
        ones = F.count_if(lab != 0)
        zeros = F.count_if(lab == 0)
        pred = F.when(ones >= zeros, 1).otherwise(0)
    else:
        total = F.sum(_whole(lab).cast("bigint"))
        pred = F.when(total * 2 > n, 1).otherwise(0)
    return F.when(n == 0, F.lit(None)).otherwise(pred).cast("int")


def vote(neighbours: DataFrame, vote: str = "nonzero_majority",
         test_ids: DataFrame | None = None) -> DataFrame:
    """``test_id, prediction`` for every test row.

    ``test_ids`` (a frame with ``test_id``) brings back rows that have no neighbour: they are
    unioned in with a NULL label, so one partial-then-final aggregation covers both and no join
    is needed.
    """
    rows = neighbours.select("test_id", F.col("label").cast("double").alias("label"))
    if test_ids is not None:
        rows = rows.unionByName(test_ids.select(
            F.col("test_id").cast("bigint").alias("test_id"),
            F.lit(None).cast("double").alias("label")))
    return rows.groupBy("test_id").agg(vote_expr(vote).alias("prediction"))
