"""Vector text files: one vector per line, numbers separated by spaces, label last.

Two parse modes, after the two readers of the original programs:

* ``strict``  -- tokens separated by exactly one space; an empty token (double or leading space)
  makes the line malformed.  Trailing spaces are dropped first, as Java's ``split`` drops
  trailing empty tokens.
* ``lenient`` -- leading/trailing whitespace trimmed, tokens separated by any whitespace run.

Malformed lines (unparsable token, empty line, wrong width) follow the usual Spark reader
modes: ``FAILFAST`` raises, ``DROPMALFORMED`` drops, ``PERMISSIVE`` keeps the row with NULL
``features``/``label`` and the raw line in ``_corrupt_record``.  Rows are never padded.

Row ordinals (``row_id``) are dense and 0-based in file-name order, then line order -- what
``zipWithIndex`` gave the original programs.  The lines are scanned once and written to the
shared scratch folder with their split and their place in it; the counts of the splits, their
offsets and the lines that get the offsets all come from that written table, so a change of the
split plan between two reads cannot drop or misnumber a line.  A line whose split has no offset
raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxima.session import written

MODES = ("strict", "lenient")
ON_ERROR = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")

# Bytes of split offsets (path, start, offset per split) that are broadcast to the lines; a larger
# table of splits is joined by a shuffle.
OFFSET_BROADCAST_BYTES = 32 << 20


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` plus the file, split start and a per-partition increasing id of every line.

    The id is taken in the scan stage, before any shuffle, so inside one split it follows line
    order.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mono"),
    )


@dataclass(frozen=True)
class NumberedLines:
    """Lines with ``row_id``, and what their splits said: the count and the first line's width."""
    lines: DataFrame
    rows: int
    width: int | None


def number_lines(lines: DataFrame, mode: str = "strict") -> NumberedLines:
    """``row_id`` for the lines of ``read_lines``: 0-based in (file path, split start, line) order.

    One row per split is spread over ranges of (file, split); sums inside a range are windows of
    that range, and only the ranges' totals (one number per shuffle partition) reach the driver.
    """
    spark = lines.sparkSession
    lines = written(lines, "lines")
    splits = lines.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"),
        F.min_by(F.size(tokens(F.col("value"), mode)), "_mono").alias("_width"))
    splits = written(splits.repartitionByRange("_file", "_block").withColumn("_range", F.spark_partition_id()), "splits")
    ranges = splits.groupBy("_range").agg(
        F.sum("_n").alias("n"), F.sum(F.length("_file") + 32).alias("bytes"),
        F.min_by("_width", F.struct("_file", "_block")).alias("width")).orderBy("_range").collect()
    before, total = [], 0
    for r in ranges:
        before.append((r["_range"], total))
        total += int(r["n"])
    w = Window.partitionBy("_range").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(spark.createDataFrame(before, "_range int, _before bigint"))  # one row per range
    offsets = (splits.join(starts, "_range")
               .withColumn("_offset", F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
               .select("_file", "_block", "_first", "_offset"))
    if sum(int(r["bytes"]) for r in ranges) <= OFFSET_BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    place = F.col("_offset") + F.col("_mono") - F.col("_first")
    missing = F.raise_error(F.concat(F.lit("no offset for a split of "), F.col("_file"))).cast("bigint")
    out = (lines.join(offsets, ["_file", "_block"], "left")
           .withColumn("row_id", F.coalesce(place, missing).cast("bigint")).drop("_offset", "_first"))
    return NumberedLines(out, total, int(ranges[0]["width"]) if ranges else None)


def tokens(value: Column, mode: str) -> Column:
    if mode == "strict":
        return F.split(F.rtrim(value), " ", -1)
    if mode == "lenient":
        return F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+", -1)
    raise ValueError(f"mode must be one of {MODES}, got {mode!r}")


def parse_values(value: Column, mode: str = "strict") -> Column:
    """The numbers of a line as ``ARRAY<DOUBLE>``; an unparsable token becomes NULL."""
    return F.transform(tokens(value, mode), lambda t: t.try_cast("double"))


def first_width(lines: DataFrame, mode: str) -> int | None:
    """Number of tokens on the first line (file order), read with one aggregation."""
    row = lines.agg(F.min_by(F.size(tokens(F.col("value"), mode)),
                             F.struct("_file", "_block", "_mono")).alias("w")).first()
    return None if row is None or row["w"] is None else int(row["w"])


def parse_vectors(lines: DataFrame, mode: str = "strict", on_error: str = "FAILFAST",
                  dim: int | None = None, labelled: bool = True) -> DataFrame:
    """Parse ``value`` into ``features`` (and ``label``); other columns are kept.

    ``dim`` counts every number on the line, label included.  Without it each line keeps its
    own width (the strict reader's behaviour).
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}, got {on_error!r}")
    vals = parse_values(F.col("value"), mode)
    lines = lines.withColumn("_values", vals)
    v = F.col("_values")
    min_width = 2 if labelled else 1
    bad = F.exists(v, lambda x: x.isNull()) | (F.size(v) < min_width)
    if dim is not None:
        bad = bad | (F.size(v) != dim)
    if labelled:
        feats = F.slice(v, 1, F.size(v) - 1)
        label = F.element_at(v, -1)
    else:
        feats, label = v, None
    if on_error == "FAILFAST":
        guard = F.when(bad, F.raise_error(F.concat(F.lit("malformed vector line: '"),
                                                   F.col("value"), F.lit("'"))))
        lines = lines.withColumn("_values", F.coalesce(guard, v))
    elif on_error == "DROPMALFORMED":
        lines = lines.where(~bad)
    out = lines.withColumn("features", F.when(~bad, feats) if on_error == "PERMISSIVE" else feats)
    if label is not None:
        out = out.withColumn("label", F.when(~bad, label) if on_error == "PERMISSIVE" else label)
    if on_error == "PERMISSIVE":
        out = out.withColumn("_corrupt_record", F.when(bad, F.col("value")))
    return out.drop("_values")


def read_vectors(spark: SparkSession, path: str | list[str], *, mode: str = "strict",
                 on_error: str = "FAILFAST", dim: int | None = None, labelled: bool = True,
                 uniform: bool | None = None, expected_rows: int | None = None,
                 with_ordinal: bool = True) -> DataFrame:
    """Read a vector text file into ``row_id, features[, label]`` (+ ``_corrupt_record``).

    ``uniform`` (default: on for ``lenient``) takes the width of the first line as ``dim`` when
    none is given, as the matrix reader did; ragged lines are then malformed, never padded.
    ``expected_rows`` replaces the declared row count of the matrix reader: a different number of
    lines raises instead of padding or overflowing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    lines = read_lines(spark, path)
    if uniform is None:
        uniform = mode == "lenient"
    if with_ordinal or expected_rows is not None:
        numbered = number_lines(lines, mode)       # width and count come with the offsets
        lines, width = numbered.lines, numbered.width
        if expected_rows is not None and numbered.rows != expected_rows:
            raise ValueError(f"{path}: {numbered.rows} rows read, {expected_rows} declared")
    else:
        width = first_width(lines, mode) if dim is None and uniform else None
    if dim is None and uniform:
        dim = width
    out = parse_vectors(lines, mode, on_error, dim, labelled)
    cols = (["row_id"] if with_ordinal else []) + ["features"] + (["label"] if labelled else [])
    if on_error == "PERMISSIVE":
        cols.append("_corrupt_record")
    return out.select(*cols)


def vector_lines(df: DataFrame, cols: list[str], sep: str = " ") -> DataFrame:
    """``value`` lines joining the given numeric columns (the text form of a vector file)."""
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value"))
