"""Queries of memory and graphs, bound to ``conversations``, ``customer`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import memory as M
from .registry import Tables, query, source

source("notes", """
    SELECT c_custkey AS note_id, '[[' || c_name || ']] works_at [[Nation ' || CAST(c_nationkey AS STRING) || ']] and more.' || CASE WHEN c_custkey % 3 = 0 THEN ' [[' || c_name || ']] reports_to [[Boss ' || CAST(c_custkey % 10 AS STRING) || ']] see [[Other]]' ELSE '' END AS text FROM {customer}""")
source("edges", r"""
    SELECT DISTINCT regexp_extract(h, '\[\[([^\]]+)\]\] (works_at|reports_to) \[\[([^\]]+)\]\]', 1) AS src, regexp_extract(h, '\[\[([^\]]+)\]\] (works_at|reports_to) \[\[([^\]]+)\]\]', 2) AS rel, regexp_extract(h, '\[\[([^\]]+)\]\] (works_at|reports_to) \[\[([^\]]+)\]\]', 3) AS dst
    FROM (SELECT unnest(regexp_extract_all(text, '\[\[[^\]]+\]\] (?:works_at|reports_to) \[\[[^\]]+\]\]')) AS h FROM {notes})""")


@query("SELECT * FROM {edges}")
def wikilink_edges(t: Tables) -> DataFrame:
    return M.wikilink_edges(t("notes"))


@query(r"SELECT node, count(*) AS n_mentions FROM (SELECT unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) AS node FROM {notes}) GROUP BY node")
def wikilink_nodes(t: Tables) -> DataFrame:
    return M.wikilink_nodes(t("notes"))


source("asked_entities", "SELECT DISTINCT 'BOSS ' || CAST(c_custkey % 10 AS STRING) AS entity FROM {customer}")


@query("SELECT entity, src, rel, dst FROM {asked_entities} a JOIN {edges} e ON (lower(e.src) = lower(entity) OR lower(e.dst) = lower(entity)) AND rel = 'reports_to'")
def graph_neighbours(t: Tables) -> DataFrame:
    return M.graph_neighbours(M.wikilink_edges(t("notes")), t("asked_entities"), "reports_to")


source("item_links", """
    SELECT doc_id AS item, 'source' AS kind, source || CAST(doc_id % (1 + CAST(floor(n_docs / 4) AS BIGINT)) AS STRING) AS value FROM {documents} CROSS JOIN (SELECT count(*) AS n_docs FROM {documents}) UNION ALL SELECT doc_id AS item, 'identifier' AS kind, 'i' || CAST(floor(doc_id / 3) AS STRING) AS value FROM {documents} WHERE doc_id % 4 <> 0""")
source("seeds", "SELECT doc_id AS item FROM {documents} WHERE doc_id % 20 = 5")


@query("""
    SELECT item, edge, seed FROM (SELECT l.item, s.kind AS edge, s.item AS seed, row_number() OVER (PARTITION BY l.item ORDER BY s.kind, s.item) AS k FROM {item_links} l
        JOIN (SELECT * FROM {item_links} WHERE item IN (SELECT item FROM {seeds})) s ON s.kind = l.kind AND s.value = l.value WHERE l.item NOT IN (SELECT item FROM {seeds})) WHERE k = 1""")
def one_hop_expand(t: Tables) -> DataFrame:
    return M.one_hop_expand(t("item_links"), t("seeds"))


source("memory_log", "SELECT 'user' || CAST(user_id AS STRING) || ':' || event_type AS key, props AS value, event_id AS seq FROM {events}")


@query("SELECT key, arg_max(value, seq) AS value, max(seq) AS seq, count(*) AS n_writes FROM {memory_log} GROUP BY key")
def memory_state(t: Tables) -> DataFrame:
    return M.memory_state(t("memory_log"))


source("remembering", "SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'User says: I PREFER short answers ' WHEN 1 THEN chr(10) || 'remember that the key is x' || chr(10) || 'neverland' ELSE '' END AS text FROM {documents}")


@query(r"""
    SELECT doc_id, n - 1 AS line_no, trim(line) AS quarantined FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {remembering})
    WHERE regexp_matches(line, '(?i)\b(always|never|prefer|remember that|from now on)\b')""")
def memory_write_gate(t: Tables) -> DataFrame:
    return M.memory_write_gate(t("remembering"))


@query("""
    SELECT conv_id, turn, role, CAST(n_dropped AS BIGINT) AS n_dropped FROM (SELECT *, sum(CASE WHEN role <> 'system' AND back > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS n_dropped FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS back FROM {conversations})) WHERE role = 'system' OR back <= 4""")
def compact_history(t: Tables) -> DataFrame:
    return M.compact_history(t("conversations"))


@query("""
    SELECT conv_id, role, tokens, round(tokens / nullif(sum(tokens) OVER (PARTITION BY conv_id), 0), 4) AS share, round(100.0 * sum(tokens) OVER (PARTITION BY conv_id) / 4000, 3) AS window_percent
    FROM (SELECT conv_id, role, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM {conversations} GROUP BY ALL)""")
def context_budget(t: Tables) -> DataFrame:
    return M.context_budget(t("conversations"))
