from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proxima.session import local_session  # noqa: E402

# (strategy, kernel, block_bytes): every plan shape, plus block joins with several blocks
SHAPES = [
    ("broadcast_train", "numpy", None),
    ("broadcast_test", "numpy", None),
    ("block", "numpy", None),
    ("block", "numpy", 64),
    ("pivot", "numpy", None),
    ("pivot", "numpy", 64),
    ("broadcast_train", "sql", None),
    ("broadcast_test", "sql", None),
    ("block", "sql", None),
    ("block", "sql", 64),
    ("pivot", "sql", 64),
]


def shape_id(shape):
    s, k, b = shape
    return f"{s}-{k}" + (f"-b{b}" if b else "")


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="proxima-tests")
    yield s
    s.stop()


def write_lines(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


TRAIN_LINES = ["0 0 0", "0 1 0", "3 4 1", "4 3 1", "5 5 1", "0 -1 1"]
TEST_LINES = ["0 0 0", "4 4 1", "0 2 0"]


@pytest.fixture(scope="module")
def hand(spark, tmp_path_factory):
    """The hand fixture of FIXTURES.md: (train, test) frames read from text files.

    Read once per module and written, so the many plan shapes tested against it do not
    re-read the files (the text reader itself is tested in ``test_edges``).
    """
    from proxima.session import written
    from proxima.sources.text import read_vectors
    d = tmp_path_factory.mktemp("hand")
    tr = written(read_vectors(spark, write_lines(d / "train.txt", TRAIN_LINES)), "hand-train")
    te = written(read_vectors(spark, write_lines(d / "test.txt", TEST_LINES)).drop("label"), "hand-test")
    return tr, te


def frame(spark, rows, labelled=True):
    """A vector frame from python rows: (row_id, [features], label) or (row_id, [features])."""
    if labelled:
        return spark.createDataFrame(rows, "row_id bigint, features array<double>, label double")
    return spark.createDataFrame(rows, "row_id bigint, features array<double>")
