"""The programs on two text files of their own."""

from __future__ import annotations

import pytest

from conftest import TEST_LINES, TRAIN_LINES, write_lines
from proxima.plans.programs import PROGRAMS, classify_files


def lines_of(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


@pytest.mark.parametrize("program", PROGRAMS)
def test_two_files(spark, tmp_path, program):
    p = PROGRAMS[program]

    def written(name, lines, mode):
        return write_lines(tmp_path / name, lines if mode == "strict" else ["\t" + x.replace(" ", "  \t") + " " for x in lines])
    train, test = written("train", TRAIN_LINES, p.train_mode), written("test", TEST_LINES, p.test_mode)
    rows = {"train": len(TRAIN_LINES), "test": len(TEST_LINES), None: None}[p.declared]
    out = classify_files(spark, program, train, test, str(tmp_path / "out"), dim=3, k=2, rows=rows)
    # two nearest: row 0 -> labels 0, 0 or 0, 1 by id; row 1 -> 1, 1; row 2 -> 0, 0
    want = {0: 0, 1: 1, 2: 0}
    assert lines_of(spark, f"{out}/k=2/dim=3") == sorted(f"({v},{i})" if p.layout == "pairs" else f"{i} {v}" for i, v in want.items())
    with pytest.raises(Exception):                                   # never overwritten
        classify_files(spark, program, train, test, str(tmp_path / "out"), dim=3, k=2, rows=rows)


def test_declared_rows_are_checked(spark, tmp_path):
    train, test = write_lines(tmp_path / "a", TRAIN_LINES), write_lines(tmp_path / "b", TEST_LINES)
    for program, rows in (("train_broadcast", 5), ("test_broadcast", 6), ("train_broadcast", None), ("neither_broadcast", 3), ("other", None)):
        with pytest.raises(ValueError):
            classify_files(spark, program, train, test, str(tmp_path / "o"), dim=3, k=1, rows=rows)
