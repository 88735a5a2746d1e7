"""Neighbour-label lookup: neighbour id -> training label, as an equi-join.

The candidate rows already carry the label, which is the cheap path used by the classifier.
This join is for neighbour lists that were computed without labels (or against another
labelling of the same rows, such as a second target column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_labels(neighbours: DataFrame, labelled: DataFrame, row_id: str = "row_id",
                  label: str = "label") -> DataFrame:
    """``test_id, rank, train_id, label`` from ``neighbours`` and the labelled rows.

    An inner equi-join on the train id; Spark picks broadcast or sort-merge from the sizes, and
    the neighbour side is at most k rows per test row.
    """
    lab = labelled.select(F.col(row_id).cast("bigint").alias("train_id"),
                          F.col(label).cast("double").alias("label"))
    return (neighbours.select("test_id", "rank", "train_id")
            .join(lab, "train_id", "inner")
            .select("test_id", "rank", "train_id", "label"))
