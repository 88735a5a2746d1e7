"""Train rows with equal vectors as one entry.

A search for k neighbours needs of each distinct vector only its k rows of least id.  ``entries`` turns
a train frame into ``train_id, train_features, rows``: one row per distinct vector, ``train_id`` the least id
and ``rows`` the (id, label) pairs in order of id, at most k.  Searches run over the entries, and tasks
expand the winners to rows where they find them (``vectorized.winners``), so no join follows.

The k rows of a vector are cut by a window before anything is gathered; Spark plans it with a partial group
limit ahead of the exchange, so a vector that a third of all rows share moves k rows per task.  The window
groups by value: NaN equals NaN, 0.0 equals -0.0, which have the same distances; a NULL element counts as NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxima.operators.candidates import ROWS, TRAIN_F, TRAIN_ID
from proxima.operators.topk import check_k
from proxima.session import written

GROUP_LIMIT = 1000               # the largest k for which Spark plans the partial group limit by default


def entries(train: DataFrame, k: int) -> DataFrame:
    """The entries of a prepared train frame, written once."""
    check_k(k)
    vector = F.transform(F.col(TRAIN_F), lambda x: F.coalesce(x, F.lit(float("nan"))))
    by = Window.partitionBy(TRAIN_F).orderBy(TRAIN_ID)
    first = train.withColumn(TRAIN_F, vector).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k)
    out = first.groupBy(TRAIN_F).agg(F.array_sort(F.collect_list(F.struct(TRAIN_ID, "label"))).alias(ROWS))
    return written(out.select(F.col(ROWS)[0][TRAIN_ID].alias(TRAIN_ID), TRAIN_F, ROWS), "entries")


def entry_counts(found: DataFrame) -> tuple[int, int]:
    """Entries and the rows they hold."""
    r = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(ROWS)), F.lit(0)).alias("rows")).first()
    return int(r["n"]), int(r["rows"])
