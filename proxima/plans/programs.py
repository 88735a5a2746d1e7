"""Whole programs: two vector text files in, prediction text out.

The three programs differ in which side they broadcast, and with it in how each file is read, how neighbours vote and
how a prediction is written:

| program | train file | test file | vote | line |
| --- | --- | --- | --- | --- |
| ``train_broadcast`` | matrix reader, declared rows | strict reader | label sum | ``(label,row)`` |
| ``test_broadcast`` | strict reader | matrix reader, declared rows | non-zero majority | ``row label`` |
| ``neither_broadcast`` | strict reader | strict reader | non-zero majority | ``row label`` |

Both files hold ``dim`` numbers a line, the label last; the test file's labels are not used.  Rows are numbered from 0 in
file order on each side.  The declared count must be that of the lines.  Parameters of the run become partition
folders of the output, which is never overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from proxima.plans.classify import knn_classify
from proxima.sources.sinks import write_predictions
from proxima.sources.text import read_vectors


@dataclass(frozen=True)
class Program:
    train_mode: str
    test_mode: str
    declared: str | None             # the side whose number of rows is declared
    strategy: str
    vote: str
    layout: str


PROGRAMS = {
    "train_broadcast": Program("lenient", "strict", "train", "broadcast_train", "label_sum", "pairs"),
    "test_broadcast": Program("strict", "lenient", "test", "broadcast_test", "nonzero_majority", "rows"),
    "neither_broadcast": Program("strict", "strict", None, "pivot", "nonzero_majority", "rows"),
}


def classify_files(spark: SparkSession, program: str, train: str, test: str, out: str, *, dim: int, k: int,
                   rows: int | None = None, **search) -> str:
    """Runs ``program`` on two files and writes its predictions under ``out``; returns the path.

    ``rows`` is the declared number of rows of the side that the program declares.  ``search`` goes to
    ``knn_classify`` (``strategy``, ``vote``, ``broadcast_limit``, ...) and may replace what the program says.
    """
    if program not in PROGRAMS:
        raise ValueError(f"program must be one of {tuple(PROGRAMS)}, got {program!r}")
    p = PROGRAMS[program]
    if (rows is None) != (p.declared is None):
        raise ValueError(f"{program} {'declares no rows' if p.declared is None else f'needs the rows of the {p.declared} file'}")

    def read(path, mode, side):
        return read_vectors(spark, path, mode=mode, dim=dim, expected_rows=rows if p.declared == side else None)
    train_rows, test_rows = read(train, p.train_mode, "train"), read(test, p.test_mode, "test").drop("label")
    search = {"strategy": p.strategy, "vote": p.vote, "dim": dim - 1, "unique_ids": True} | search
    pred = knn_classify(train_rows, test_rows, k, **search)
    return write_predictions(pred, out, p.layout, params={"k": k, "dim": dim})
