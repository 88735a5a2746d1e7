"""Classifying a stream of test rows against a static train frame.

The original programs are batch jobs and define no streaming operator.  A stream of rows to
classify is handled by applying the same batch plan to every micro-batch with
``foreachBatch``.  The train side is written once, when the stream starts; what a micro-batch
broadcasts or writes to scratch is freed when its output is written.  Each batch goes to its own
``batch_id=N`` directory with overwrite, so a batch replayed after a failure replaces its earlier
output instead of duplicating it; the checkpoint location records the progress of the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from proxima.plans.classify import knn_classify
from proxima.session import released, written


def classify_stream(train: DataFrame, test_stream: DataFrame, k: int, output_path: str,
                    checkpoint_location: str, *, available_now: bool = False,
                    **options) -> StreamingQuery:
    """Start a query writing ``test_id, prediction`` parquet for every micro-batch.

    ``options`` are passed to ``knn_classify`` (``features``, ``vote``, ``strategy``, ...).
    """
    root = output_path.rstrip("/")
    train = written(train, "stream-train")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with released():
            pred = knn_classify(train, batch, k, **options)
            pred.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    writer = test_stream.writeStream.foreachBatch(each_batch).option(
        "checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
