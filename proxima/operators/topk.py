"""Bounded top-k per test row and the neighbour list built from it.

One tie rule for every strategy: neighbours are ordered by ``(distance, train_id)``, so a
boundary tie goes to the lower train id, whatever the partitioning or input order.  This is
the rule of the original k-pass arg-min selection (the lowest index wins a tie); the
replace-the-maximum selection of the other two programs depended on shuffle order instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOUR_COLUMNS = ["test_id", "rank", "train_id", "distance", "label"]


def check_k(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError(f"k must be a positive integer, got {k!r}")
    return k


def top_k(candidates: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """The k nearest admissible candidates of each test row, with ``rank`` 1..k.

    ``row_number() <= k`` over a window partitioned by ``test_id`` is planned with a partial
    ``WindowGroupLimit`` before the exchange (k up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``), so no task ships more than k rows per
    test row; the candidate list of a row is never gathered whole.

    Admissibility (distance strictly below ``max_distance``, default +Infinity) is applied
    after ranking: inadmissible distances (NULL, NaN, too far) sort after every admissible one,
    so they can only take ranks past the admissible candidates and are then dropped.  Filtering
    first would let Catalyst push the predicate into a nested-loop join condition and compute
    every distance twice.
    """
    check_k(k)
    bound = float("inf") if max_distance is None else float(max_distance)
    w = Window.partitionBy("test_id").orderBy(F.col("distance").asc_nulls_last(),
                                              F.col("train_id").asc())
    return (candidates
            .withColumn("rank", F.row_number().over(w))
            .where((F.col("rank") <= k) & (F.col("distance") < F.lit(bound)))
            .select("test_id", "rank", "train_id", "distance", "label"))


def neighbor_list(neighbours: DataFrame) -> DataFrame:
    """One row per test row with its neighbour ids nearest first (at most k of them)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "train_id")))
    return (neighbours.groupBy("test_id")
            .agg(F.transform(ordered, lambda s: s["train_id"]).alias("neighbors")))
