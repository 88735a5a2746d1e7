"""Row counts per stage without a pass per stage.

For statistics over all pairs of a row use ``vectorized.pair_stats``, which computes them block by
block without turning pairs into rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_counts(stats: DataFrame, train_rows: int, k: int) -> DataFrame:
    """``stage, rows`` for the stages of a classification, from one pass of the pair statistics.

    ``stats`` has a row per test row: ``n`` pairs, ``n_admissible`` of them below the bound asked for
    and ``n_finite`` that can be neighbours.  A test row keeps ``least(k, n_finite)`` neighbours and
    gets one prediction, so every count is a sum over those rows.
    """
    totals = stats.agg(
        F.lit(train_rows).cast("bigint").alias("train"), F.count(F.lit(1)).alias("test"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pairs"),
        F.coalesce(F.sum("n_admissible"), F.lit(0)).cast("bigint").alias("admissible"),
        F.coalesce(F.sum(F.least(F.lit(k), "n_finite")), F.lit(0)).cast("bigint").alias("neighbours"),
        F.count(F.lit(1)).alias("predictions"))
    stages = ["train", "test", "pairs", "admissible", "neighbours", "predictions"]
    pairs = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("rows")) for s in stages))
    return totals.select(F.inline(pairs))
