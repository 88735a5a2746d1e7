"""The driver contract: entry, query registry, and oracle agreement on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["embeddings", "documents", "labels", "supplier", "customer", "pages", "benchmark"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["test_id", "prediction"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    """The training-data operators state in ``tests/llm`` what SQL cannot."""
    other = {n for n in E.queries() if n == "pipeline" or re.match(r"op\d+_", n)}
    assert set(E.queries()) - other == set(E.oracle_sql()) - other
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("lost", ["folders", "library"])
def test_other_queries_stand_without_the_subpackage(tmp_path, lost):
    """From a copy without the training-data folders, or where a library that only they need is missing."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    gone = {"llm", "corpus_pipeline.py"} if lost == "folders" else set()
    shutil.copytree(root, tmp_path / "copy", ignore=lambda _, names: [n for n in names if n in gone or n.startswith(".")])
    code = ("import sys; sys.modules['ahocorasick'] = None; sys.modules['regex'] = None; " if lost == "library" else "") + (
        "import __spark_entry__ as E; print(sorted(E.queries()) == sorted(E.oracle_sql()), len(E.queries()), "
        "any(n.startswith('op') or n == 'pipeline' for n in E.queries()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""},
                         capture_output=True, text=True, timeout=300)
    others = [n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n)]
    assert out.stdout.split() == ["True", str(len(others)), "False"], out.stderr


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted(
        "|".join(repr(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(rows, cols) == _digest(orows, ocols)
