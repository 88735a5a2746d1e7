"""Labelled and unlabelled vector frames built from the parquet tables.

* ``embeddings`` -- ``vec_id, embedding ARRAY<FLOAT>, label INT (0..9)``: the vector is the
  embedding as doubles; the binary class is ``label % 2`` and the raw label is kept as
  ``raw_label``.
* ``documents`` + ``labels`` -- three numeric text features per document (characters, space
  separated tokens, digits).  Documents with a row in ``labels`` are the train side, the others
  (an anti-join) the test side.

Only the needed columns are selected, so the parquet scans read just those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, features ARRAY<DOUBLE>, label DOUBLE (label % 2), raw_label DOUBLE``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("bigint").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.pmod(F.col("label"), F.lit(2)).cast("double").alias("label"),
        F.col("label").cast("double").alias("raw_label"),
    )


def feature_array(text: str = "text", n_chars: str = "n_chars"):
    """[n_chars, number of ' '-separated tokens, number of digits] as ``ARRAY<DOUBLE>``."""
    return F.array(
        F.col(n_chars).cast("double"),
        F.size(F.split(F.col(text), " ")).cast("double"),
        # digits counted as matches: the same number as the length after deleting every
        # non-digit, without rewriting the whole text
        F.regexp_count(F.col(text), F.lit("[0-9]")).cast("double"),
    ).alias("features")


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` for every document, computed in the scan: whatever join follows moves
    three numbers per document, never the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), feature_array())


def document_vectors(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    """``row_id, features, label, labelled`` for every document, computed in one pass.

    The text is read once, where it lies; the result (three numbers per document) is written to the
    shared scratch folder, so the train side, the test side and the size checks all read that
    small table instead of the text again.
    """
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("double").alias("label"),
        F.lit(True).alias("labelled"))
    features = document_features(table(spark, sf_dir, "documents"))
    out = features.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), "features", "label",
        F.coalesce(F.col("labelled"), F.lit(False)).alias("labelled"))
    return written(out, "document-vectors")


def split_labelled(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) from ``document_vectors``: labelled documents, and all the others."""
    train = vectors.where(F.col("labelled")).select("row_id", "features", "label")
    test = vectors.where(~F.col("labelled")).select("row_id", "features")
    return train, test
