"""A stream of test rows gets the same predictions as the batch classifier."""

from __future__ import annotations

from conftest import frame
from proxima import knn_classify
from proxima.streaming import classify_stream


def test_stream_matches_batch(spark, tmp_path):
    train = frame(spark, [(i, [float(i % 5), float(i % 3)], float(i % 2)) for i in range(30)])
    test_rows = [(i, [float(i % 4), float(i % 6) / 2]) for i in range(12)]
    src = tmp_path / "in"
    frame(spark, test_rows[:6], labelled=False).write.parquet(str(src / "a"))
    frame(spark, test_rows[6:], labelled=False).write.parquet(str(src / "b"))
    stream = (spark.readStream.schema("row_id bigint, features array<double>")
              .option("maxFilesPerTrigger", 1).parquet(str(src / "*")))
    q = classify_stream(train, stream, 3, str(tmp_path / "out"), str(tmp_path / "chk"),
                        available_now=True)
    q.awaitTermination(120)
    got = sorted((r.test_id, r.prediction) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.test_id, r.prediction) for r in knn_classify(
        train, frame(spark, test_rows, labelled=False), 3).collect())
    assert got == want
