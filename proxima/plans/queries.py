"""The registered queries: one per operator, each with an independent DuckDB SQL oracle.

Inputs are whole tables, never id subsets:

* ``embeddings`` (64-d) is used as an all-rows kNN self-join: every row is a test row and every
  row is a train row, so the work grows with the square of the table.  The binary class is
  ``label % 2``; the raw label (0..9) is used where a multi-class label is the point.
* ``documents`` with three numeric text features: documents with a ``labels`` row are the train
  side, the rest (an anti-join) the test side.
* ``supplier`` and ``embeddings`` rows are written as vector text files (under the shared
  scratch folder) to exercise the text scans, ordinals and sinks.

Every Spark frame aliases its columns to the names used by the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from proxima.functions.vectors import euclidean, feature_part, label_part
from proxima.operators import diagnostics as D
from proxima.operators.labels import attach_labels
from proxima.operators.topk import neighbor_list
from proxima.operators.vote import vote as vote_op
from proxima.plans.classify import (choose_plan, classify_for, knn_classify, knn_neighbors,
                                    neighbours_for, pair_stats_for)
from proxima.plans.programs import classify_files
from proxima.plans.sql import register_nearest
from proxima.operators import candidates as C
from proxima.session import scratch_path
from proxima.sources import tables as T
from proxima.sources.sinks import write_predictions
from proxima.sources.text import read_vectors, vector_lines

K = 5          # neighbours for the search and classification queries
K_VOTE = 4     # an even k, so that vote ties occur
DOCUMENT_DISTANCE = 25.0  # admissibility bound on the three text features
MAX_DISTANCE = 1.25  # admissibility bound for the embedding self-join (about the 5th percentile)

# --------------------------------------------------------------------------- Spark side


def _emb_prepared(spark, sf_dir, dim=64, label="label"):
    e = T.embedding_vectors(spark, sf_dir)
    tr = C.prepare_train(e, "features", label, "row_id", dim)
    te = C.prepare_test(e, "features", "row_id", dim)
    return tr, te


def _emb_neighbours(spark, sf_dir, k, kernel="numpy", strategy="auto", label="label"):
    tr, te = _emb_prepared(spark, sf_dir, label=label)
    plan = choose_plan(tr, te, 64, strategy, kernel)
    return neighbours_for(tr, te, k, plan)


def _emb_classify(spark, sf_dir, k, vote, strategy, kernel, label="label", broadcast_limit=None):
    tr, te = _emb_prepared(spark, sf_dir, label=label)
    plan = choose_plan(tr, te, 64, strategy, kernel, broadcast_limit)
    return classify_for(tr, te, k, plan, vote)


def _supplier_file(spark, sf_dir, sep_layout: str) -> str:
    s = T.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    if sep_layout == "strict":
        lines = vector_lines(s.orderBy("s_suppkey"), ["s_suppkey", "s_nationkey", "s_acctbal"])
    else:  # tabs, double spaces, leading and trailing blanks
        lines = s.orderBy("s_suppkey").select(F.concat(
            F.lit(" "), F.col("s_suppkey").cast("string"), F.lit("\t"),
            F.col("s_nationkey").cast("string"), F.lit("  "),
            F.col("s_acctbal").cast("string"), F.lit(" \t")).alias("value"))
    path = scratch_path(spark, f"supplier-{sep_layout}")
    lines.write.text(path)
    return path


def _values_long(df: DataFrame) -> DataFrame:
    vals = F.concat(F.col("features"), F.array(F.col("label")))
    return df.select("row_id", F.posexplode(vals).alias("pos", "value")).select(
        "row_id", (F.col("pos") + 1).cast("int").alias("pos"), "value")


def q_vector_parse_strict(spark, sf_dir):
    path = _supplier_file(spark, sf_dir, "strict")
    return _values_long(read_vectors(spark, path, mode="strict"))


def q_vector_parse_lenient(spark, sf_dir):
    path = _supplier_file(spark, sf_dir, "lenient")
    return _values_long(read_vectors(spark, path, mode="lenient"))


def q_vector_parse_declared(spark, sf_dir):
    """The matrix reader's declared row count, checked against the lines read."""
    path = _supplier_file(spark, sf_dir, "lenient")
    n = T.table(spark, sf_dir, "supplier").count()
    return _values_long(read_vectors(spark, path, mode="lenient", expected_rows=n))


def q_dense_row_ordinal(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    path = scratch_path(spark, "embedding-lines")
    vector_lines(e.orderBy("vec_id"), ["vec_id", "label"]).write.text(path)
    v = read_vectors(spark, path, mode="strict")
    return v.select("row_id", F.col("features")[0].cast("bigint").alias("vec_id"))


def q_feature_label_split(spark, sf_dir):
    e = T.embedding_vectors(spark, sf_dir)
    values = F.concat(F.col("features"), F.array(F.col("label")))
    rows = e.select(F.col("row_id").alias("vec_id"), values.alias("values"))
    f = feature_part("values")
    return rows.select("vec_id", F.size(f).cast("int").alias("n_features"),
                       F.element_at(f, 1).alias("first_feature"),
                       F.element_at(f, -1).alias("last_feature"),
                       label_part("values").alias("label"))


def q_feature_label_declared(spark, sf_dir):
    """A declared width below the line's: the label is the value at that place, the rest is unread."""
    dim = 17
    rows = T.embedding_vectors(spark, sf_dir).select(F.col("row_id").alias("vec_id"), F.col("features").alias("values"))
    f = feature_part("values", dim)
    return rows.select("vec_id", F.size(f).cast("int").alias("n_features"),
                       F.element_at(f, -1).alias("last_feature"), label_part("values", dim).alias("label"))


def _neighbour_distances(spark, sf_dir, dim):
    """The distance of every kept pair, computed anew from both feature tables by column expression:
    with ``dim`` unrolled into generated code, without it by higher-order functions."""
    tr, te = _emb_prepared(spark, sf_dir)
    kept = neighbours_for(tr, te, K, choose_plan(tr, te, 64)).select("test_id", "train_id")
    pairs = kept.join(te, "test_id").join(tr, "train_id")
    return pairs.select("test_id", "train_id", euclidean(C.TEST_F, C.TRAIN_F, dim).alias("distance"))


def q_pairwise_distance(spark, sf_dir):
    return _neighbour_distances(spark, sf_dir, 64)


def q_pairwise_distance_hof(spark, sf_dir):
    return _neighbour_distances(spark, sf_dir, None)


def _emb_pair_stats(spark, sf_dir, max_distance=None, strategy="auto"):
    """Statistics of every test row's distances to all train rows, without pair rows."""
    tr, te = _emb_prepared(spark, sf_dir)
    return pair_stats_for(tr, te, choose_plan(tr, te, 64, strategy, k=1), max_distance)


def q_admissible_candidates(spark, sf_dir):
    return _emb_pair_stats(spark, sf_dir, MAX_DISTANCE).select(
        "test_id", F.col("n_admissible").alias("n_candidates"))


def q_candidate_group_stats(spark, sf_dir):
    return _emb_pair_stats(spark, sf_dir, strategy="broadcast_test").select("test_id", "n", "min_d", "max_d")


def q_distance_row(spark, sf_dir):
    return _emb_pair_stats(spark, sf_dir).select("test_id", "n", "first_d", "last_d", "min_d")


def q_knn_topk(spark, sf_dir):
    """TOP-1 as the window operator itself: the winners of every task cut by a ranked window."""
    return _emb_neighbours(spark, sf_dir, K, "sql", "broadcast_test").select(
        "test_id", "rank", "train_id", "distance")


def q_knn_topk_vectorized(spark, sf_dir):
    return _emb_neighbours(spark, sf_dir, K, "numpy").select("test_id", "rank", "train_id", "distance")


def q_knn_sql_function(spark, sf_dir):
    """The search as a table function, called from SQL over all rows of the table."""
    register_nearest(spark, "nearest_embeddings", T.embedding_vectors(spark, sf_dir), K, label="raw_label", dim=64)
    return spark.sql("SELECT test_id, rank, train_id, distance, label FROM nearest_embeddings(TABLE("
                     f"SELECT CAST(vec_id AS BIGINT), CAST(embedding AS ARRAY<DOUBLE>) FROM parquet.`{sf_dir.rstrip('/')}/embeddings.parquet`))")


def q_neighbor_list(spark, sf_dir):
    n = neighbor_list(_emb_neighbours(spark, sf_dir, K, "numpy", "block"))
    return n.select("test_id", F.array_join(F.col("neighbors").cast("array<string>"), ",")
                    .alias("neighbors"))


def q_neighbor_labels(spark, sf_dir):
    neigh = _emb_neighbours(spark, sf_dir, K, "numpy", "broadcast_test")
    e = T.embedding_vectors(spark, sf_dir)
    return attach_labels(neigh, e, "row_id", "raw_label").select("test_id", "rank", "label")


def q_vote_nonzero_majority(spark, sf_dir):
    return vote_op(_emb_neighbours(spark, sf_dir, K_VOTE), "nonzero_majority")


def q_vote_label_sum(spark, sf_dir):
    return vote_op(_emb_neighbours(spark, sf_dir, K_VOTE), "label_sum")


def q_vote_label_sum_multiclass(spark, sf_dir):
    neigh = _emb_neighbours(spark, sf_dir, K_VOTE, label="raw_label")
    return vote_op(neigh, "label_sum")


def q_classify_broadcast_train(spark, sf_dir):
    return _emb_classify(spark, sf_dir, K, "label_sum", "broadcast_train", "sql")


def q_classify_block(spark, sf_dir):
    return _emb_classify(spark, sf_dir, K, "nonzero_majority", "block", "sql")


def q_classify_broadcast_test(spark, sf_dir):
    return _emb_classify(spark, sf_dir, K, "nonzero_majority", "broadcast_test", "sql")


def q_classify_cartesian(spark, sf_dir):
    """The program that joined everything with everything: broadcasts off, the chooser takes the
    pivot join or, where a sample says that nothing is pruned, the block join.  No product is formed."""
    return _emb_classify(spark, sf_dir, K, "nonzero_majority", "auto", "sql", broadcast_limit=0)


def q_classify_vectorized(spark, sf_dir):
    return _emb_classify(spark, sf_dir, K, "nonzero_majority", "auto", "numpy")


def q_classify_vectorized_blocks(spark, sf_dir):
    return _emb_classify(spark, sf_dir, K, "label_sum", "block", "numpy")


def q_classify_vectorized_broadcast_test(spark, sf_dir):
    return _emb_classify(spark, sf_dir, K, "nonzero_majority", "broadcast_test", "numpy")


def _sink(spark, sf_dir, layout):
    pred = _emb_classify(spark, sf_dir, K, "nonzero_majority", "auto", "numpy")
    path = write_predictions(pred, scratch_path(spark, f"predictions-{layout}"), layout)
    return spark.read.text(path).select(F.col("value").alias("line"))


def q_prediction_sink_pairs(spark, sf_dir):
    return _sink(spark, sf_dir, "pairs")


def q_prediction_sink_rows(spark, sf_dir):
    return _sink(spark, sf_dir, "rows")


def q_stage_counts(spark, sf_dir):
    """Every stage's count from one pass of the pair kernel."""
    tr, te = _emb_prepared(spark, sf_dir)
    plan = choose_plan(tr, te, 64)
    return D.stage_counts(pair_stats_for(tr, te, plan, MAX_DISTANCE), plan.train_rows, K)


def q_text_to_text(spark, sf_dir):
    """A whole program: vector text in, classification, prediction text out, parameters in the path."""
    def vectors(df, name):
        width = len(df.columns)
        path = scratch_path(spark, f"vectors-{name}")
        vector_lines(df, df.columns).write.text(path)
        return read_vectors(spark, path, mode="strict", dim=width)
    s = T.table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", "s_acctbal", (F.col("s_suppkey") % 2).alias("label")).orderBy("s_suppkey")
    train = vectors(s, "train")
    pred = knn_classify(train, train.drop("label"), K, dim=3, vote="nonzero_majority", unique_ids=True)
    root = write_predictions(pred, scratch_path(spark, "text-to-text"), "rows", params={"k": K, "dim": 3})
    return spark.read.text(root).select(F.col("value").alias("line"), "k", "dim")


def _program(spark, sf_dir, name, loose):
    """A program on two files: all suppliers are train rows, all customers test rows; ``loose`` names the side
    whose file has tabs, runs of blanks and blanks at both ends."""
    def written(side, table, key, *cols):
        rows = T.table(spark, sf_dir, table).select(*cols, (F.col(key) % 2).alias("label")).orderBy(key)
        lines = vector_lines(rows, [*cols, "label"])
        if side == loose:
            lines = lines.select(F.concat(F.lit(" \t"), F.replace("value", F.lit(" "), F.lit("\t  ")), F.lit("  ")).alias("value"))
        path = scratch_path(spark, f"program-{side}")
        lines.write.text(path)
        return path
    train = written("train", "supplier", "s_suppkey", "s_suppkey", "s_nationkey", "s_acctbal")
    test = written("test", "customer", "c_custkey", "c_custkey", "c_nationkey", "c_acctbal")
    table = {"train": "supplier", "test": "customer"}.get(loose)
    root = classify_files(spark, name, train, test, scratch_path(spark, name), dim=4, k=K_VOTE,
                          rows=T.table(spark, sf_dir, table).count() if table else None)
    return spark.read.text(root).select(F.col("value").alias("line"), "k", "dim")


def q_program_train_broadcast(spark, sf_dir):
    """Test read strictly, train by the matrix reader with its declared rows, label sums, ``(label,row)`` lines."""
    return _program(spark, sf_dir, "train_broadcast", "train")


def q_program_test_broadcast(spark, sf_dir):
    """Train read strictly, test by the matrix reader with its declared rows, majorities, ``row label`` lines."""
    return _program(spark, sf_dir, "test_broadcast", "test")


def q_program_neither_broadcast(spark, sf_dir):
    """Both files read strictly, the pivot join, majorities, ``row label`` lines."""
    return _program(spark, sf_dir, "neither_broadcast", None)


def q_sink_refuses_overwrite(spark, sf_dir):
    """SNK-3: parameters name the output; a second write to it is refused and changes nothing."""
    pred = _emb_classify(spark, sf_dir, K, "nonzero_majority", "auto", "numpy")
    path = scratch_path(spark, "predictions-once")
    write_predictions(pred, path, "parquet", params={"k": K})
    refused = False
    try:
        write_predictions(pred.limit(1), path, "parquet", params={"k": K})
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).select("test_id", "prediction", "k", F.lit(refused).alias("refused"))


def _docs(spark, sf_dir, target="quality"):
    return T.split_labelled(T.document_vectors(spark, sf_dir, target))


def q_classify_documents_quality(spark, sf_dir):
    tr, te = _docs(spark, sf_dir)
    return knn_classify(tr, te, K, dim=3, vote="nonzero_majority")


def q_classify_documents_toxic(spark, sf_dir):
    tr, te = _docs(spark, sf_dir, "toxic")
    return knn_classify(tr, te, K, dim=3, vote="label_sum", strategy="pivot", collapse=True)


def q_knn_documents(spark, sf_dir):
    tr, te = _docs(spark, sf_dir)
    return knn_neighbors(tr, te, K, dim=3, strategy="broadcast_test").select(
        "test_id", "rank", "train_id", "distance", "label")


def q_knn_documents_pivot(spark, sf_dir):
    """The same neighbours through the pivot-partitioned join, which prunes on these features."""
    tr, te = _docs(spark, sf_dir)
    return knn_neighbors(tr, te, K, dim=3, strategy="pivot").select(
        "test_id", "rank", "train_id", "distance", "label")


def q_document_range_stats(spark, sf_dir):
    """For every unlabelled document the labelled ones within a distance, the nearest and the farthest, by rings."""
    tr, te = _docs(spark, sf_dir)
    tr, te = C.prepare_train(tr, dim=3), C.prepare_test(te, dim=3)
    stats = pair_stats_for(tr, te, choose_plan(tr, te, 3, "pivot"), DOCUMENT_DISTANCE)
    return stats.select("test_id", "n", "min_d", "max_d", "first_d", "last_d", F.col("n_admissible").alias("n_candidates"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vector_parse_strict": q_vector_parse_strict,
    "vector_parse_lenient": q_vector_parse_lenient,
    "vector_parse_declared": q_vector_parse_declared,
    "dense_row_ordinal": q_dense_row_ordinal,
    "feature_label_split": q_feature_label_split,
    "feature_label_declared": q_feature_label_declared,
    "pairwise_distance": q_pairwise_distance,
    "pairwise_distance_hof": q_pairwise_distance_hof,
    "admissible_candidates": q_admissible_candidates,
    "candidate_group_stats": q_candidate_group_stats,
    "distance_row": q_distance_row,
    "knn_topk": q_knn_topk,
    "knn_topk_vectorized": q_knn_topk_vectorized,
    "knn_sql_function": q_knn_sql_function,
    "neighbor_list": q_neighbor_list,
    "neighbor_labels": q_neighbor_labels,
    "vote_nonzero_majority": q_vote_nonzero_majority,
    "vote_label_sum": q_vote_label_sum,
    "vote_label_sum_multiclass": q_vote_label_sum_multiclass,
    "classify_broadcast_train": q_classify_broadcast_train,
    "classify_block": q_classify_block,
    "classify_broadcast_test": q_classify_broadcast_test,
    "classify_cartesian": q_classify_cartesian,
    "classify_vectorized": q_classify_vectorized,
    "classify_vectorized_blocks": q_classify_vectorized_blocks,
    "classify_vectorized_broadcast_test": q_classify_vectorized_broadcast_test,
    "prediction_sink_pairs": q_prediction_sink_pairs,
    "prediction_sink_rows": q_prediction_sink_rows,
    "sink_refuses_overwrite": q_sink_refuses_overwrite,
    "program_train_broadcast": q_program_train_broadcast,
    "program_test_broadcast": q_program_test_broadcast,
    "program_neither_broadcast": q_program_neither_broadcast,
    "text_to_text": q_text_to_text,
    "stage_counts": q_stage_counts,
    "classify_documents_quality": q_classify_documents_quality,
    "classify_documents_toxic": q_classify_documents_toxic,
    "knn_documents": q_knn_documents,
    "knn_documents_pivot": q_knn_documents_pivot,
    "document_range_stats": q_document_range_stats,
}

# --------------------------------------------------------------------------- DuckDB oracle

_EMB = ("e AS (SELECT CAST(vec_id AS BIGINT) AS row_id, CAST(embedding AS DOUBLE[]) AS f, "
        "CAST(label % 2 AS DOUBLE) AS label, CAST(label AS DOUBLE) AS raw_label FROM embeddings)")
# left-to-right sum of squared differences, as in the Spark expression
_DIST = ("sqrt(list_reduce(list_transform(list_zip(t.f, r.f), "
         "lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b))")
_PAIRS = (f"pairs AS (SELECT t.row_id AS test_id, r.row_id AS train_id, {_DIST} AS distance, "
          "r.label AS label, r.raw_label AS raw_label FROM e t, e r)")
_RANKED = ("ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY test_id "
           "ORDER BY distance, train_id) AS INTEGER) AS rank FROM pairs "
           "WHERE distance < CAST('Infinity' AS DOUBLE))")
_EMB_KNN = f"WITH {_EMB}, {_PAIRS}, {_RANKED}"

_NONZERO = ("CAST(CASE WHEN count(*) FILTER (WHERE label <> 0) >= count(*) FILTER (WHERE label = 0) "
            "THEN 1 ELSE 0 END AS INTEGER)")
_LABEL_SUM = "CAST(CASE WHEN sum(CAST(label AS BIGINT)) * 2 > count(*) THEN 1 ELSE 0 END AS INTEGER)"


def _vote_sql(k: int, rule: str) -> str:
    return (f"{_EMB_KNN} SELECT test_id, {rule} AS prediction FROM ranked "
            f"WHERE rank <= {k} GROUP BY test_id")


def _program_sql(rule: str, line: str) -> str:
    def side(name, table, key, *cols):
        values = ", ".join(f"CAST({c} AS DOUBLE)" for c in cols)
        return (f"{name} AS (SELECT CAST(row_number() OVER (ORDER BY {key}) - 1 AS BIGINT) AS row_id, [{values}] AS f, "
                f"CAST({key} % 2 AS DOUBLE) AS label, 0.0 AS raw_label FROM {table})")
    return (f"WITH {side('r', 'supplier', 's_suppkey', 's_suppkey', 's_nationkey', 's_acctbal')}, "
            f"{side('t', 'customer', 'c_custkey', 'c_custkey', 'c_nationkey', 'c_acctbal')}, "
            f"{_PAIRS.replace('FROM e t, e r', 'FROM t, r')}, {_RANKED}, v AS (SELECT test_id, {rule} AS prediction FROM ranked "
            f"WHERE rank <= {K_VOTE} GROUP BY test_id) SELECT {line} AS line, CAST({K_VOTE} AS INTEGER) AS k, CAST(4 AS INTEGER) AS dim FROM v")


_SUPPLIER_LONG = (
    "WITH s AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS row_id, "
    "CAST(s_suppkey AS DOUBLE) AS a, CAST(s_nationkey AS DOUBLE) AS b, CAST(s_acctbal AS DOUBLE) AS c "
    "FROM supplier) "
    "SELECT row_id, CAST(1 AS INTEGER) AS pos, a AS value FROM s UNION ALL "
    "SELECT row_id, CAST(2 AS INTEGER), b FROM s UNION ALL "
    "SELECT row_id, CAST(3 AS INTEGER), c FROM s")

_DOCS = (
    "d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, "
    "[CAST(n_chars AS DOUBLE), CAST(len(string_split(text, ' ')) AS DOUBLE), "
    "CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE)] AS f FROM documents), "
    "tr AS (SELECT d.doc_id AS row_id, d.f, CAST(l.{target} AS DOUBLE) AS label "
    "FROM d JOIN labels l ON d.doc_id = l.doc_id), "
    "te AS (SELECT d.doc_id AS row_id, d.f FROM d "
    "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)), "
    f"pairs AS (SELECT t.row_id AS test_id, r.row_id AS train_id, {_DIST} AS distance, "
    "r.label AS label FROM te t, tr r), "
    f"{_RANKED}")


def _docs_vote_sql(target: str, rule: str, k: int = K) -> str:
    return (f"WITH {_DOCS.format(target=target)} "
            f"SELECT te.row_id AS test_id, p.prediction FROM te LEFT JOIN "
            f"(SELECT test_id, {rule} AS prediction FROM ranked WHERE rank <= {k} GROUP BY test_id) p "
            f"ON te.row_id = p.test_id")


ORACLE_SQL: dict[str, str] = {
    "vector_parse_strict": _SUPPLIER_LONG,
    "vector_parse_lenient": _SUPPLIER_LONG,
    "vector_parse_declared": _SUPPLIER_LONG,
    "dense_row_ordinal": ("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_id, "
                          "CAST(vec_id AS BIGINT) AS vec_id FROM embeddings"),
    "feature_label_split": (
        f"WITH {_EMB} SELECT row_id AS vec_id, CAST(len(f) AS INTEGER) AS n_features, "
        "f[1] AS first_feature, f[len(f)] AS last_feature, label FROM e"),
    "feature_label_declared": (
        f"WITH {_EMB} SELECT row_id AS vec_id, CAST(16 AS INTEGER) AS n_features, "
        "f[16] AS last_feature, f[17] AS label FROM e"),
    "pairwise_distance": f"{_EMB_KNN} SELECT test_id, train_id, distance FROM ranked WHERE rank <= {K}",
    "pairwise_distance_hof": f"{_EMB_KNN} SELECT test_id, train_id, distance FROM ranked WHERE rank <= {K}",
    "admissible_candidates": (
        f"WITH {_EMB}, {_PAIRS} SELECT test_id, "
        f"CAST(count(*) FILTER (WHERE distance < {MAX_DISTANCE}) AS BIGINT) AS n_candidates "
        "FROM pairs GROUP BY test_id"),
    "candidate_group_stats": (
        f"WITH {_EMB}, {_PAIRS} SELECT test_id, CAST(count(*) AS BIGINT) AS n, "
        "min(distance) AS min_d, max(distance) AS max_d FROM pairs GROUP BY test_id"),
    "distance_row": (
        f"WITH {_EMB}, {_PAIRS} SELECT test_id, CAST(count(*) AS BIGINT) AS n, "
        "arg_min(distance, train_id) AS first_d, arg_max(distance, train_id) AS last_d, "
        "min(distance) AS min_d FROM pairs GROUP BY test_id"),
    "knn_topk": f"{_EMB_KNN} SELECT test_id, rank, train_id, distance FROM ranked WHERE rank <= {K}",
    "knn_sql_function": f"{_EMB_KNN} SELECT test_id, rank, train_id, distance, raw_label AS label FROM ranked WHERE rank <= {K}",
    "knn_topk_vectorized": (f"{_EMB_KNN} SELECT test_id, rank, train_id, distance FROM ranked "
                            f"WHERE rank <= {K}"),
    "neighbor_list": (
        f"{_EMB_KNN} SELECT test_id, string_agg(CAST(train_id AS VARCHAR), ',' ORDER BY rank) "
        f"AS neighbors FROM ranked WHERE rank <= {K} GROUP BY test_id"),
    "neighbor_labels": (f"{_EMB_KNN} SELECT test_id, rank, raw_label AS label FROM ranked "
                        f"WHERE rank <= {K}"),
    "vote_nonzero_majority": _vote_sql(K_VOTE, _NONZERO),
    "vote_label_sum": _vote_sql(K_VOTE, _LABEL_SUM),
    "vote_label_sum_multiclass": _vote_sql(K_VOTE, _LABEL_SUM.replace("label", "raw_label")),
    "classify_broadcast_train": _vote_sql(K, _LABEL_SUM),
    "classify_block": _vote_sql(K, _NONZERO),
    "classify_broadcast_test": _vote_sql(K, _NONZERO),
    "classify_cartesian": _vote_sql(K, _NONZERO),
    "classify_vectorized": _vote_sql(K, _NONZERO),
    "classify_vectorized_blocks": _vote_sql(K, _LABEL_SUM),
    "classify_vectorized_broadcast_test": _vote_sql(K, _NONZERO),
    "prediction_sink_pairs": (
        f"WITH v AS ({_vote_sql(K, _NONZERO)}) SELECT '(' || CAST(prediction AS VARCHAR) || ',' "
        "|| CAST(test_id AS VARCHAR) || ')' AS line FROM v"),
    "prediction_sink_rows": (
        f"WITH v AS ({_vote_sql(K, _NONZERO)}) SELECT CAST(test_id AS VARCHAR) || ' ' "
        "|| CAST(prediction AS VARCHAR) AS line FROM v"),
    "sink_refuses_overwrite": (
        f"WITH v AS ({_vote_sql(K, _NONZERO)}) SELECT test_id, prediction, CAST({K} AS INTEGER) AS k, "
        "true AS refused FROM v"),
    "text_to_text": (
        "WITH e AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS row_id, "
        "[CAST(s_suppkey AS DOUBLE), CAST(s_nationkey AS DOUBLE), CAST(s_acctbal AS DOUBLE)] AS f, "
        "CAST(s_suppkey % 2 AS DOUBLE) AS label, 0.0 AS raw_label FROM supplier), "
        f"{_PAIRS}, {_RANKED}, v AS (SELECT test_id, {_NONZERO} AS prediction FROM ranked "
        f"WHERE rank <= {K} GROUP BY test_id) SELECT CAST(test_id AS VARCHAR) || ' ' || "
        f"CAST(prediction AS VARCHAR) AS line, CAST({K} AS INTEGER) AS k, CAST(3 AS INTEGER) AS dim FROM v"),
    "program_train_broadcast": _program_sql(_LABEL_SUM, "'(' || CAST(prediction AS VARCHAR) || ',' || CAST(test_id AS VARCHAR) || ')'"),
    "program_test_broadcast": _program_sql(_NONZERO, "CAST(test_id AS VARCHAR) || ' ' || CAST(prediction AS VARCHAR)"),
    "program_neither_broadcast": _program_sql(_NONZERO, "CAST(test_id AS VARCHAR) || ' ' || CAST(prediction AS VARCHAR)"),
    "stage_counts": (
        f"{_EMB_KNN} SELECT 'train' AS stage, CAST(count(*) AS BIGINT) AS rows FROM e "
        "UNION ALL SELECT 'test', CAST(count(*) AS BIGINT) FROM e "
        "UNION ALL SELECT 'pairs', CAST(count(*) AS BIGINT) FROM pairs "
        f"UNION ALL SELECT 'admissible', CAST(count(*) AS BIGINT) FROM pairs WHERE distance < {MAX_DISTANCE} "
        f"UNION ALL SELECT 'neighbours', CAST(count(*) AS BIGINT) FROM ranked WHERE rank <= {K} "
        "UNION ALL SELECT 'predictions', CAST(count(DISTINCT test_id) AS BIGINT) FROM ranked"),
    "classify_documents_quality": _docs_vote_sql("quality", _NONZERO),
    "classify_documents_toxic": _docs_vote_sql("toxic", _LABEL_SUM),
    "knn_documents": (f"WITH {_DOCS.format(target='quality')} SELECT test_id, rank, train_id, "
                      f"distance, label FROM ranked WHERE rank <= {K}"),
}
ORACLE_SQL["knn_documents_pivot"] = ORACLE_SQL["knn_documents"]
ORACLE_SQL["document_range_stats"] = (
    f"WITH {_DOCS.format(target='quality')} SELECT test_id, CAST(count(*) AS BIGINT) AS n, min(distance) AS min_d, max(distance) AS max_d, "
    "arg_min(distance, train_id) AS first_d, arg_max(distance, train_id) AS last_d, "
    f"CAST(count(*) FILTER (WHERE distance < {DOCUMENT_DISTANCE}) AS BIGINT) AS n_candidates FROM pairs GROUP BY test_id")
