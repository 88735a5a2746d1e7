"""Packing by length: optimal length buckets, token-budget batches inside each bucket.

The histogram of all lengths up to the token budget (so at most ``budget + 1`` numbers) goes to the
driver, where dynamic programming chooses the bucket bounds with the least padding: rows of a
bucket are padded to its bound.  The recurrence over bounds is solved with a monotone hull of lines,
which is exact.  Inside a bucket rows stand in order of (length, id) and every ``budget // bound``
of them make a batch, so no batch holds more than ``budget`` padded tokens.

Positions are found without sorting a bucket in one task: rows are sorted in ranges of (length, id), cut
at quantiles and counted, so a length that many rows share, or rows without an id, take as many ranges as
they need.

Rules.  Null and empty texts have length 0 and are packed with the shortest.  A text longer than the
budget is a batch of its own without padding (bucket = the number of buckets).  Rows with equal
length and id are interchangeable.  Null ids come last within a length.  An empty table gives no rows;
other columns are kept, but for input columns of the names that ``pack`` makes, which its own replace.

``pack_tokens`` measures texts in tokens of a tokenizer file, and so do the query and the pipeline;
``pack`` takes any ``length`` and counts words without one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import small_table, tokenizer_path, written
from proxima.llm.counts import token_counts

BUDGET = 8192
BUCKETS = 16


def word_count(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def optimal_bounds(lengths, counts, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over the given distinct lengths (ascending) with the
    least total padding, smallest bounds first among equals."""
    m = len(lengths)
    if not m:
        return []
    total = [0]
    for c in counts:
        total.append(total[-1] + int(c))
    # best[j]: least padded size of the first j lengths; a bucket over i+1..j is padded to length j
    best = [0] + [int(lengths[j]) * total[j + 1] for j in range(m)]
    back = [[0] * (m + 1)]
    for _ in range(min(buckets, m) - 1):
        hull: list[tuple[int, int, int]] = []           # lines: slope -total[i], intercept best[i]
        now, came, at = [0] * (m + 1), [0] * (m + 1), 0
        for j in range(1, m + 1):
            line = (-total[j - 1], best[j - 1], j - 1)
            while len(hull) >= 2:
                (a1, b1, _), (a2, b2, _) = hull[-2], hull[-1]
                # the middle line is never strictly least
                if (line[1] - b1) * (a1 - a2) <= (b2 - b1) * (a1 - line[0]):
                    hull.pop()
                else:
                    break
            hull.append(line)
            at = min(at, len(hull) - 1)
            x = int(lengths[j - 1])
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            now[j], came[j] = hull[at][0] * x + hull[at][1] + x * total[j], hull[at][2]
        back.append(came)
        best = now
    out, j = [], m
    for came in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = came[j]
    return out[::-1]


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, length: Column | None = None,
         id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_tokens, bucket, bucket_len, batch, padding``."""
    cols = docs.columns if keep is None else keep
    length = word_count() if length is None else length
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(id_col).cast("bigint").alias("id"),
                       F.coalesce(length, F.lit(0)).cast("bigint").alias("n"))
    rows = written(rows, "lengths")
    spark = docs.sparkSession
    hist = sorted((r["n"], r["c"]) for r in rows.where(F.col("n") <= budget).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect())
    bounds = optimal_bounds([n for n, _ in hist], [c for _, c in hist], buckets)
    # per length: its bucket, the bucket's bound, and how many rows come before the bucket
    table, k, seen, start = [], 0, 0, 0
    for n, c in hist:
        while n > bounds[k]:
            k, start = k + 1, seen
        table.append((n, k, bounds[k], start))
        seen += c
    lengths = small_table(spark, table, n=pa.int64(), bucket=pa.int32(), bucket_len=pa.int64(), start=pa.int64())

    # place among all rows in order of length and id: sorted ranges, counted; the salt cuts equal keys
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("n").asc(), F.col("id").asc_nulls_last(), F.col("salt").asc()]
    at = F.monotonically_increasing_id()                # range << 33 | place in the range
    ranked = written(rows.withColumn("salt", at).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                     .select("row", "n", at.alias("at")), "ranked")
    part = F.shiftright("at", 33)
    ahead, total = [], 0
    for p, c in sorted(tuple(r) for r in ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()):
        ahead.append((p, total))
        total += c
    ahead = small_table(spark, ahead, part=pa.int64(), ahead=pa.int64())    # one row per range
    out = ranked.withColumn("part", part).join(F.broadcast(ahead), "part").select(
        "row", "n", (F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    out = out.join(F.broadcast(lengths), "n", "left")    # at most budget + 1 rows
    n = F.col("n")
    long = F.col("bucket").isNull()
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    batch = F.floor((F.col("place") - F.col("start")) / per_batch)
    out = out.select(
        "row", n.alias("n_tokens"), F.coalesce("bucket", F.lit(len(bounds))).alias("bucket"),
        F.coalesce("bucket_len", n).alias("bucket_len"),
        F.when(long, F.concat_ws("-", F.lit(str(len(bounds))), n, "place")).otherwise(F.concat_ws("-", "bucket", batch)).alias("batch"),
        F.coalesce(F.col("bucket_len") - n, F.lit(0)).alias("padding"))
    made = ["n_tokens", "bucket", "bucket_len", "batch", "padding"]
    return out.select(*[F.col("row").getField(c).alias(c) for c in cols if c not in made], *made)


def pack_tokens(docs: DataFrame, path: str | None = None, budget: int = BUDGET, buckets: int = BUCKETS,
                id_col: str = "doc_id") -> DataFrame:
    """The ids of ``docs``, packed by the tokens of their texts.  Every row is counted by itself, so null
    and repeated ids have the lengths of their own texts."""
    counted = token_counts(docs, path or tokenizer_path(), id_col=id_col)
    rows = counted.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n_tokens").alias("n"))
    return pack(rows, budget, buckets, F.col("n"), id_col, keep=[id_col])


def pack_report(docs: DataFrame) -> DataFrame:
    return pack_tokens(docs)
