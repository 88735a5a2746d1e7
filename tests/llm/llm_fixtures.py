"""Documents with edge cases, shared by the tests of this folder (not a conftest: its name is taken)."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside; the input may have columns of these names.
CLASHES = ["id", "row", "kept", "chunk", "bucket", "key", "rep", "component_id", "n_tokens", "score", "lang_pred", "batch"]


def passage(rng, n):
    return [f"{rng.choice('bcdfglmnprstv')}{rng.choice('aeiou')}{rng.choice('nrstl')}{rng.randrange(60)}" for _ in range(n)]


def edge_rows():
    """Documents with near and exact copies, shared passages, nulls, ties, repeats and long texts."""
    rng = random.Random(5)
    base, shared = passage(rng, 160), passage(rng, 70)
    rows = []

    def add(text, lang="en", i=None):
        rows.append((len(rows) * 3 if i is None else i, text, lang, f"s{len(rows) % 3}", None if text is None else len(text)))
    add(" ".join(base))
    add(" ".join(base))                                             # exact copy
    for k in range(6):                                              # near copies, some below the threshold
        w = list(base)
        for j in rng.sample(range(len(w)), 4 * k + 2):
            w[j] = f"x{k}{j}"
        add("  ".join(w) + "\n")
    add(None)
    add("")
    add(" \t\n")
    add("one")
    add("ONE")
    add("two words")
    add("Two\twords")
    for _ in range(4):                                              # a passage that many share
        add(" ".join(passage(rng, 30) + shared + passage(rng, 20)))
    add(" ".join(shared))
    add(" ".join(shared[:49]))                                      # one word short of a window
    add(" ".join(shared[:50]))
    add("\n".join(passage(rng, 40000) + shared))                    # very long
    add("x " * 400)                                                 # one word again and again
    add("x " * 300)
    add("12345 678 !!!", lang=None)                                 # no letters
    add("don't <|endoftext|> 's ünïcödé 漢字 \U0001f600  end ", lang=None)
    add(" ".join(base), i=0)                                        # a repeated id with its text
    add(" ".join(passage(rng, 80)), i=9)                            # a repeated id with another text
    add(" ".join(base), i=None)
    rows.append((None, " ".join(shared + base), "en", None, None))  # no id
    rows.append((None, "no id here", "de", None, 3))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(edge_rows(), DOCS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def close_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
