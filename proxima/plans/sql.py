"""Nearest neighbours as a table function of Spark SQL.

``register_nearest(spark, "nearest", train, k=5)`` makes

    SELECT * FROM nearest(TABLE(SELECT id, vector FROM points))

return ``test_id, rank, train_id, distance, label``: the ``k`` nearest train rows of every row of the table argument,
whose first column is a whole number and whose second is an array of numbers.  The train side is broadcast, so it must
pass the size check of ``knn_neighbors``; rows of the argument stay in their partitions, or in those that ``PARTITION BY`` in
the call asks for, and reach the function as Arrow batches.  A NULL id, a NULL vector or one of another width raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.operators import candidates as C
from proxima.operators import vectorized as V
from proxima.operators.topk import check_k
from proxima.plans.classify import infer_dim, planned
from proxima.session import send


def register_nearest(spark: SparkSession, name: str, train: DataFrame, k: int, *, features: str = "features", label: str = "label",
                     train_id: str = "row_id", dim: int | None = None, max_distance: float | None = None,
                     broadcast_limit: int | None = None, collapse: bool | None = None) -> None:
    """Registers the table function ``name`` over ``train`` in the session."""
    check_k(k)
    dim = infer_dim(train, features) if dim is None else dim
    tr = C.prepare_train(train, features, label, train_id, dim)
    nobody = tr.select(F.col(C.TRAIN_ID).alias(C.TEST_ID)).where("false")
    tr, _ = planned(tr, nobody, dim, k, "broadcast_train", broadcast_limit=broadcast_limit, collapse=collapse)
    bc = send(spark, V.collect_side(tr, C.TRAIN_ID, C.TRAIN_F, dim, C.tail_of(tr)))
    bound = float("inf") if max_distance is None else float(max_distance)

    class Nearest:
        def eval(self, batch):
            ids, vectors = V.int_ids(batch.column(0)), batch.column(1)
            if vectors.null_count:
                raise ValueError(f"row {ids[vectors.is_null().to_numpy(zero_copy_only=False)][0]} has no vector")
            yield V.neighbours_table(ids, *V.winners(V.matrix(vectors, dim), bc.value, k, bound))
    spark.udtf.register(name, F.arrow_udtf(Nearest, returnType=V.NEIGHBOUR_SCHEMA))
