"""Queries of sources, sinks and table maintenance, bound to ``documents``, ``conversations`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text as X
from ..sources import store as S
from . import evaluation  # noqa: F401
from .registry import Tables, derived, query, source

_ESCAPE = "replace(replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), ' '), chr(9), ' ')"


def _json(**fields: str) -> str:
    """SQL that builds one JSON object of text from SQL expressions."""
    parts = [f"chr(34) || '{k}' || chr(34) || ':' || {v}" for k, v in fields.items()]
    return "chr(123) || " + " || ',' || ".join(parts) + " || chr(125)"


def _text(sql: str) -> str:
    return f"chr(34) || {_ESCAPE.replace('{c}', sql)} || chr(34)"


source("turns", """
    SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) END AS context FROM {conversations}""")
_CALLS = "CASE WHEN (conv_id + turn) % 4 = 0 THEN '[]' WHEN (conv_id + turn) % 4 = 1 THEN '[' || {one} || ',' || {two} || ']' ELSE '[' || {one} || ']' END"
_CALLS = _CALLS.replace("{one}", _json(name="chr(34) || 'search' || chr(34)", result=_text("coalesce(asked, '')"))).replace("{two}", _json(name="chr(34) || 'fetch' || chr(34)", result="chr(34) || chr(34)"))
source("trace_lines", "SELECT " + _json(
    trace_id="chr(34) || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || chr(34)", channel="chr(34) || 'web' || chr(34)", user_input=_text("coalesce(asked, '')"),
    retrieved_context=_text("coalesce(context, '')"), tool_calls=_CALLS, assistant_output=_text("text")) + " AS value FROM {turns} WHERE role = 'assistant'")
source("stored_docs", "SELECT doc_id, text, " + _json(
    title=_text("substr(text, 1, 20)"), source_url="chr(34) || 'https://host' || CAST(doc_id % 5 AS STRING) || '.example/' || CAST(doc_id AS STRING) || chr(34)", language="chr(34) || lang || chr(34)",
    published="CASE WHEN doc_id % 4 = 0 THEN chr(34) || 'May 2020' || chr(34) ELSE chr(34) || '2020-01-02' || chr(34) END", size_bytes="CASE WHEN doc_id % 7 = 0 THEN chr(34) || 'big' || chr(34) ELSE CAST(n_chars AS STRING) END", host="chr(34) || source || chr(34)")
    + " AS provenance, " + _json(lang="chr(34) || lang || chr(34)", part="CAST(doc_id % 3 AS STRING)") + " AS metadata FROM {documents}")
source("live_docs", "SELECT doc_id, text, lang FROM {documents} WHERE doc_id % 4 <> 3")
source("batch_docs", "SELECT doc_id, text || ' edited' AS text, lang FROM {documents} WHERE doc_id % 2 = 1")


@query("""
    SELECT value->>'$.trace_id' AS trace_id, value->>'$.user_input' AS user_input, value->>'$.assistant_output' AS assistant_output, CASE WHEN json_array_length(value, '$.tool_calls') > 0 THEN 'agent' ELSE 'ask' END AS endpoint_type,
        coalesce(array_to_string(list_transform(list_filter(CAST(value->'$.tool_calls' AS STRUCT(name VARCHAR, result VARCHAR)[]), lambda c: c.result <> ''), lambda c: c.name || '=' || left(c.result, 200)), '|'), '') AS citations,
        CASE WHEN value->>'$.retrieved_context' <> '' THEN 'supported' ELSE 'not_applicable' END AS rag_status FROM {trace_lines}""")
def load_traces(t: Tables) -> DataFrame:
    return S.load_traces(t("trace_lines"))


@query("""
    SELECT CASE WHEN json_array_length(value, '$.tool_calls') = 0 THEN 'empty' ELSE 'array' END AS calls_type, count(*) AS n, count(*) FILTER (value->>'$.retrieved_context' = '') AS n_no_context FROM {trace_lines} GROUP BY ALL""")
def trace_load_qa(t: Tables) -> DataFrame:
    return S.trace_load_qa(t("trace_lines"))


@query("SELECT doc_id, " + ", ".join(f"provenance->>'$.{k}' AS {k}" for k in S.PROVENANCE) + ", TRY_CAST(provenance->>'$.size_bytes' AS BIGINT) AS size_bytes FROM {stored_docs}")
def provenance_view(t: Tables) -> DataFrame:
    return S.provenance_view(t("stored_docs"))


@query("SELECT doc_id FROM {stored_docs} WHERE metadata->>'$.lang' = 'en' AND metadata->>'$.part' = '1'")
def filter_metadata(t: Tables) -> DataFrame:
    return S.filter_metadata(t("stored_docs"), {"lang": "en", "part": 1}).select("doc_id")


@query("SELECT doc_id, provenance FROM {stored_docs} ORDER BY doc_id LIMIT 20 OFFSET 40")
def get_page(t: Tables) -> DataFrame:
    return S.get_page(t("stored_docs"), ("doc_id", "provenance"), 20, 40)


@query("SELECT doc_id, lang, md5(text) AS text_md5 FROM {batch_docs} UNION ALL SELECT doc_id, lang, md5(text) FROM {live_docs} WHERE doc_id NOT IN (SELECT doc_id FROM {batch_docs})")
def upsert_latest(t: Tables) -> DataFrame:
    return S.upsert_latest(t("live_docs"), t("batch_docs")).select("doc_id", "lang", F.md5("text").alias("text_md5"))


source("double_batch", "SELECT doc_id, text, lang, doc_id AS batch_order FROM {batch_docs} UNION ALL SELECT doc_id, lower(text) AS text, lang, doc_id + 1000000 AS batch_order FROM {batch_docs}")


@query("SELECT doc_id, md5(text) AS text_md5 FROM {live_docs} UNION ALL SELECT doc_id, md5(text) FROM {batch_docs} WHERE doc_id NOT IN (SELECT doc_id FROM {live_docs})")
def insert_ignore(t: Tables) -> DataFrame:
    return S.insert_ignore(t("live_docs"), t("double_batch")).select("doc_id", F.md5("text").alias("text_md5"))


source("artifacts", "SELECT 'a/' || CAST(doc_id AS STRING) AS path, md5(text) AS sha, doc_id % 10 AS updated_at FROM {live_docs}")
source("new_artifacts", "SELECT 'a/' || CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE md5(lower(text)) END AS sha, 50 + doc_id % 10 AS updated_at FROM {documents} WHERE doc_id % 2 = 1")


@query("""
    SELECT coalesce(n.path, o.path) AS path, coalesce(n.sha, o.sha) AS sha, CASE WHEN n.sha IS NULL OR n.sha = o.sha THEN coalesce(o.updated_at, n.updated_at) ELSE n.updated_at END AS updated_at
    FROM {artifacts} o FULL JOIN {new_artifacts} n ON n.path = o.path""")
def upsert_if_changed(t: Tables) -> DataFrame:
    return S.upsert_if_changed(t("artifacts"), t("new_artifacts"))


source("with_provenance", "SELECT doc_id, text, provenance FROM {stored_docs} WHERE doc_id % 4 <> 3")
source("incoming_provenance", "SELECT doc_id, text || ' edited' AS text, CASE WHEN doc_id % 3 = 0 THEN 'new' END AS provenance FROM {stored_docs} WHERE doc_id % 2 = 1")


@query("""
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, md5(CASE WHEN n.doc_id IS NOT NULL THEN n.text ELSE o.text END) AS text_md5, coalesce(n.provenance, o.provenance) AS provenance
    FROM {with_provenance} o FULL JOIN {incoming_provenance} n ON n.doc_id = o.doc_id""")
def save_keep_provenance(t: Tables) -> DataFrame:
    return S.save_keep_provenance(t("with_provenance"), t("incoming_provenance")).select("doc_id", F.md5("text").alias("text_md5"), "provenance")


#: Chunks of 300 characters of all whole documents, and those of documents of one language that came again, shorter by their first chunk.
_CUT = "SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(text, CAST(i * 300 + 1 AS BIGINT), 300) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 300) AS BIGINT))) AS i FROM ({docs}))"
source("came_again", "SELECT doc_id, substr(text, 301) AS text FROM {documents} WHERE lang = 'de' AND length(text) > 300")


@derived("stored_chunks", _CUT.replace("{docs}", "SELECT * FROM {documents}"))
def stored_chunks(t: Tables) -> DataFrame:
    return X.chunk_fixed(t("documents"), 300)


@derived("incoming_chunks", _CUT.replace("{docs}", "SELECT * FROM {came_again}"))
def incoming_chunks(t: Tables) -> DataFrame:
    return X.chunk_fixed(t("came_again"), 300)


@query("SELECT doc_id, chunk_index, md5(text) AS text_md5 FROM {stored_chunks} WHERE doc_id NOT IN (SELECT doc_id FROM {incoming_chunks}) UNION ALL SELECT doc_id, chunk_index, md5(text) FROM {incoming_chunks}")
def replace_document_chunks(t: Tables) -> DataFrame:
    return S.replace_document_chunks(t("stored_chunks"), t("incoming_chunks")).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


@query()
def export_with_manifest(t: Tables) -> DataFrame:
    tables = {"documents": t("documents"), "orders": t("orders"), "labels": t("labels")}
    return S.export_with_manifest(tables, S.working_folder(t.spark))


source("store_a", "SELECT vec_id AS id, CAST(label AS STRING) AS content, CAST(vec_id % 9 AS STRING) AS metadata, embedding FROM {embeddings} WHERE vec_id % 31 <> 0")
source("store_b", "SELECT vec_id AS id, CASE WHEN vec_id % 50 = 1 THEN 'changed' ELSE CAST(label AS STRING) END AS content, CAST(vec_id % 9 AS STRING) AS metadata, embedding FROM {embeddings} WHERE vec_id % 37 <> 0")


@query("""
    SELECT count(*) FILTER (b.id IS NULL) AS only_left, count(*) FILTER (a.id IS NULL) AS only_right, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL AND (a.content <> b.content OR a.metadata <> b.metadata)) AS n_different,
        round(max(list_distance(a.embedding, b.embedding)), 6) AS max_gap, FALSE AS equal FROM {store_a} a FULL JOIN {store_b} b ON a.id = b.id""")
def reconcile_stores(t: Tables) -> DataFrame:
    return S.reconcile_stores(t("store_a"), t("store_b"))


@query("SELECT check_name, count(*) AS n, sum(CASE WHEN pass THEN 1 ELSE 0 END) AS n_pass FROM {check_results} GROUP BY check_name")
def named_queries(t: Tables) -> DataFrame:
    registry = S.NamedQueries()
    registry.register("eval_by_check", "SELECT check_name, count(*) AS n, sum(CASE WHEN pass THEN 1 ELSE 0 END) AS n_pass FROM nq_results GROUP BY check_name")
    registry.register("corpus_counts", "SELECT count(*) AS n FROM nq_documents")
    return registry.run("eval_by_check", {"nq_results": t("check_results"), "nq_documents": t("documents")})
