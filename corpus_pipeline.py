"""The corpus pipeline: language identification, near-duplicate removal, substring removal, packing.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a frame that
is written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of
their input.  ``run`` applies them to the ``documents`` table.  SQL cannot state the trained profiles or the
bucket optimisation, so there is no oracle; each stage is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.llm.common import joined_if_small, small_batches, table, written
from proxima.llm.langid import known_language
from proxima.llm.minhash import near_duplicates
from proxima.llm.packing import pack_tokens
from proxima.llm.substrings import remove_repeats

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter (``und``) and those too unlike every labelled language; a null language becomes the predicted one.  Without profiles, texts with letters stay."""
    small_batches(spark)
    names = ("_language", "_score", "_likeness")
    while any(c in names for c in docs.columns):
        names = tuple(f"_{n}" for n in names)
    cols = docs.columns
    kept = known_language(docs, names)
    return kept.select(*[F.coalesce(F.col("lang"), F.col(names[0])).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in cols])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest doc_id, once; of rows that
    repeat it, the one whose text sorts first, empty texts last.  Documents without a doc_id stay."""
    small_batches(spark)
    found = written(near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT), "near-duplicates")
    dropped = written(found.where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    once = joined_if_small(docs, dropped, "doc_id", "left_anti")
    repeated = written(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return once.select(docs.columns)
    rest = joined_if_small(once, repeated, "doc_id", "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = joined_if_small(once, repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(row, F.struct(F.coalesce(F.length("text"), F.lit(0)) == 0, "text", F.to_json(row))).alias("row"))
    return rest.select(docs.columns).union(first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of 50 words or more; a changed text is its kept words joined by one
    space.  A document left without words goes."""
    small_batches(spark)
    out = remove_repeats(docs).where("n_words = 0 or n_removed < n_words")
    changed = F.col("kept").isNotNull()
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    row = [F.col("row").getField(c) for c in docs.columns]
    return out.select(*[(F.when(changed, new[c]).otherwise(r) if c in new else r).alias(c) for c, r in zip(docs.columns, row)])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket and batch of every document that is left, by its tokens."""
    small_batches(spark)
    return pack_tokens(docs)


STAGES = [("language", language), ("near_duplicate", near_duplicate), ("substrings", substrings), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
