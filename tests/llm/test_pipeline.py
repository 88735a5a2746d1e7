"""The pipeline's stages, each on what the one before it has kept."""

from __future__ import annotations

import __spark_entry__ as E
import corpus_pipeline as P

from llm_fixtures import close_components, edge, edge_rows, empty  # noqa: F401


def test_stages_are_four_and_registered():
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicate", "substrings", "packing"]
    assert E.queries()["pipeline"] is P.run and P.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()
    assert [n for n in E.queries() if n.startswith("op")] == sorted(
        (n for n in E.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))


def test_stages_on_edge_rows(spark, edge, tmp_path):
    docs, rows = edge, edge_rows()
    out = []
    for k, (_, stage) in enumerate(P.STAGES):
        result = stage(spark, docs, "/nowhere")
        if k < 3:
            assert result.columns == docs.columns and dict(result.dtypes) == dict(docs.dtypes)
        result.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append(docs.collect())
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted((str(r.doc_id), r.text) for r in out[0]) == sorted((str(i), t) for i, t, *_ in letters)
    assert all(r.lang for r in out[0])
    # the other stages, each on what the one before it kept
    assert sorted((str(r.doc_id), r.text) for r in out[1]) == sorted((str(i), t) for i, t in without_copies([(r.doc_id, r.text) for r in out[0]]))
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in out[2]) == sorted(
        (str(i), t, n) for i, t, n in without_passages([(r.doc_id, r.text, r.n_chars) for r in out[1]]))
    assert sorted(str(r.doc_id) for r in out[3]) == sorted(str(r.doc_id) for r in out[2])
    assert all(r.n_tokens <= r.bucket_len for r in out[3])


def without_copies(rows):
    """One document of each group linked at similarity 0.8 on five-word shingles, that of the smallest doc_id; of rows that
    repeat it the one whose text sorts first, empty texts last.  Rows without a doc_id stay."""
    sets = []
    for _, text in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append({b" ".join(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set())
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    links = [(a, b) for n, a in enumerate(known) for b in known[n + 1:]
             if rows[a][0] == rows[b][0] or sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = close_components(known, links)
    least = {}
    for k in known:
        least[group[k]] = min(least.get(group[k], rows[k][0]), rows[k][0])
    kept = {}
    for k in known:
        i, text = rows[k]
        if least[group[k]] == i:
            kept[i] = min(kept.get(i, text), text, key=lambda t: (not t, t or ""))
    return [*kept.items(), *((i, t) for i, t in rows if i is None)]


def without_passages(rows):
    """Every word covered by a window of 50 that starts in a document of a smaller doc_id is removed; a changed text is its
    words joined by blanks, and one without words left goes."""
    last = 2**63 - 1
    words = [(last if i is None else i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            key = b" ".join(w[k: k + 50])
            first[key] = min(first.get(key, last), i)
    out = []
    for (i, w), (doc, text, n) in zip(words, rows):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[b" ".join(w[k: k + 50])] < i:
                gone[k: k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        if not any(gone):
            out.append((doc, text, n))
        elif kept:
            out.append((doc, kept, len(kept)))
    return out


def test_empty_table(spark, empty, tmp_path):
    docs = empty
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, "/nowhere").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0
