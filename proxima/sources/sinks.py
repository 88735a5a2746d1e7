"""Prediction sinks.

Two text layouts from the original programs, plus parquet:

* ``pairs`` -- ``(prediction,test_id)`` per line;
* ``rows``  -- ``test_id prediction`` per line (the layout the original intended; its arrays
  were printed as object hashes);
* ``parquet`` -- the frame as is.

Writes never clobber: the default mode is ``errorifexists``, so writing twice to one path
fails instead of the original's random file suffix.  Run parameters (k, dim, strategy) can
be written as partition directories, e.g. ``path/k=5/dim=64/``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYOUTS = ("pairs", "rows", "parquet")


def _null_as_text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def prediction_lines(pred: DataFrame, layout: str) -> DataFrame:
    """The text line of every prediction, in column ``value``."""
    if layout == "pairs":
        line = F.concat(F.lit("("), _null_as_text("prediction"), F.lit(","),
                        _null_as_text("test_id"), F.lit(")"))
    elif layout == "rows":
        line = F.concat_ws(" ", _null_as_text("test_id"), _null_as_text("prediction"))
    else:
        raise ValueError(f"text layout must be 'pairs' or 'rows', got {layout!r}")
    return pred.select(line.alias("value"))


def write_predictions(pred: DataFrame, path: str, layout: str = "rows", *,
                      mode: str = "errorifexists", params: dict | None = None) -> str:
    """Write ``test_id, prediction`` rows to ``path``; returns the path written.

    ``params`` (for example ``{"k": 5, "dim": 64}``) become partition directories in the given
    order, so runs with different parameters can share one root without clobbering.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, got {layout!r}")
    params = params or {}
    out = pred if layout == "parquet" else prediction_lines(pred, layout)
    for name, value in params.items():
        out = out.withColumn(name, F.lit(value))
    writer = out.write.mode(mode)
    if params:
        writer = writer.partitionBy(*params.keys())
    if layout == "parquet":
        writer.parquet(path)
    else:
        writer.text(path)
    return path
