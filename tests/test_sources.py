"""Vector frames from the parquet tables."""

from __future__ import annotations

from proxima.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_document_sides_partition_the_documents(spark):
    train, test = T.split_labelled(T.document_vectors(spark, SF))
    n_docs = T.table(spark, SF, "documents").count()
    n_labels = T.table(spark, SF, "labels").count()
    assert train.count() == n_labels and test.count() == n_docs - n_labels
    features = {r.doc_id: list(r.features) for r in T.document_features(T.table(spark, SF, "documents")).collect()}
    assert all(list(r.features) == features[r.row_id] for r in [*train.collect(), *test.collect()])


def test_document_features_definition(spark):
    row = (T.document_features(spark.createDataFrame(
        [(7, "ab 12 c3  ", 10)], "doc_id bigint, text string, n_chars bigint")).collect()[0])
    # characters as given, ' '-separated tokens (empty ones included), digits
    assert list(row.features) == [10.0, 5.0, 3.0]


def test_embedding_vectors_binary_label(spark):
    e = T.embedding_vectors(spark, SF)
    assert e.columns == ["row_id", "features", "label", "raw_label"]
    assert {r.label for r in e.select("label").distinct().collect()} <= {0.0, 1.0}
    assert e.where("label != raw_label % 2").count() == 0
