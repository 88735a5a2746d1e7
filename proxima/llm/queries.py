"""The registered queries of the subpackage: one ``opN_<name>`` per operator, over whole tables.

``ORACLE_SQL`` holds DuckDB SQL where SQL can state the result; the other queries are tested
against brute force, round trips or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proxima.llm.bpe import encode_digests
from proxima.llm.common import table, tokenizer_path
from proxima.llm.counts import token_counts
from proxima.llm.embeddings import near_duplicate_vectors
from proxima.llm.extract import extract_main_text
from proxima.llm.fingerprints import edited_pairs
from proxima.llm.idfiles import id_file_report
from proxima.llm.langid import identify_languages
from proxima.llm.maxsketch import ranked_search
from proxima.llm.minhash import near_duplicates
from proxima.llm.packing import pack_report
from proxima.llm.substrings import substring_report
from proxima.llm.warc import capture_report
from proxima.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_minhash_near_dedup(spark, sf_dir):
    """Components of documents linked at similarity 0.8 on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


@register
def op2_substring_dedup(spark, sf_dir):
    """Words covered by 50-word windows that also start in an earlier document."""
    return substring_report(table(spark, sf_dir, "documents"))


@register
def op3_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


@register
def op4_document_fingerprints(spark, sf_dir):
    """Fingerprints of every text and its edited text, with their likeness."""
    return edited_pairs(table(spark, sf_dir, "documents"))


@register
def op5_packing(spark, sf_dir):
    """Length bucket and batch of every document."""
    return pack_report(table(spark, sf_dir, "documents"))


@register
def op6_warc(spark, sf_dir):
    """Pages written as WARC archives, read back and merged into one capture index."""
    return capture_report(table(spark, sf_dir, "pages"))


@register
def op7_embedding_near_dedup(spark, sf_dir):
    """Links and components of vectors at cosine 0.95."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@register
def op8_bpe(spark, sf_dir):
    """Digests of the ids and of the decoded text of every document."""
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op9_token_counts(spark, sf_dir):
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op10_language_id(spark, sf_dir):
    """Predicted language of every document, trained on four fifths of the labelled ones."""
    return identify_languages(table(spark, sf_dir, "documents"))


@register
def op11_token_id_files(spark, sf_dir):
    """Bit-packed id files of all documents, read back."""
    return id_file_report(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@register
def op12_ranked_search(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op13_embedding_whitening(spark, sf_dir):
    """Sixteen whitened components of every vector."""
    return whiten(table(spark, sf_dir, "embeddings"))


# --------------------------------------------------------------------------- DuckDB oracle

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

# every document reaches the smallest id that its links lead to
_REACH = """,
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, root) AS (SELECT {id}, {id} FROM {table} UNION
                    SELECT b, root FROM reach JOIN both_ways ON a = id),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

ORACLE_SQL["op1_minhash_near_dedup"] = (
    "WITH RECURSIVE w AS (SELECT doc_id, " + _WORDS.format(
        text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """ AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) > 1
       THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
          WHERE 100 * c >= 80 * (p.n + q.n - c))""" + _REACH.format(id="doc_id", table="documents") + """
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN comp ON comp.id = d.doc_id""")

ORACLE_SQL["op2_substring_dedup"] = (
    "WITH w AS (SELECT doc_id, " + _WORDS.format(text="coalesce(text, '')") + """ AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
first AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN first USING (k), range(50) t(j) WHERE d < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""")

ORACLE_SQL["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
             max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM q"""

ORACLE_SQL["op7_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e, list_dot_product(e, e) AS s FROM v
         WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id
          WHERE list_dot_product(x.e, y.e) / sqrt(x.s * y.s) >= 0.95)""" + _REACH.format(id="vec_id", table="embeddings") + """,
n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.id = vec_id"""

_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE_SQL["op12_ranked_search"] = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, TERMS AS ts FROM documents),
tot AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, tot GROUP BY t),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(ts) * docs) // terms) AS m FROM d, tot WHERE len(ts) > 0),
i AS (SELECT item_id, row_number() OVER () AS q, list_distinct(TERMS) AS ts FROM benchmark),
s AS (SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM (SELECT q, item_id, unnest(ts) AS t FROM i) JOIN f USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY q, item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50""".replace("TERMS", _TERMS)
