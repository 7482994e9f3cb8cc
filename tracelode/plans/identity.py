"""Queries of document identity, bound to ``documents`` with planted identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity as I
from . import maintenance
from .registry import Tables, query, source


@query("SELECT doc_id, twin_id, sha FROM (SELECT doc_id, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY text) AS twin_id FROM {documents}) WHERE doc_id <> twin_id")
def content_duplicates(t: Tables) -> DataFrame:
    return I.content_duplicates(t("documents"))


source("id_live", "SELECT doc_id, text FROM {documents} WHERE doc_id % 4 <> 3")
source("id_versions", "SELECT doc_id, CAST(v AS BIGINT) AS version, md5(text || CAST(v AS STRING)) AS key, CASE WHEN v = 1 THEN text ELSE text || ' v' || CAST(v AS STRING) END AS text FROM {documents} CROSS JOIN (VALUES (1), (2), (3)) AS x(v) WHERE doc_id % 3 = 0 AND v <= 1 + doc_id % 5")
source("id_incoming", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 5 = 1 THEN text || ' v2' ELSE text || ' new' || CAST(n AS STRING) END AS text, CAST(n AS BIGINT) AS batch_order FROM {documents} CROSS JOIN (VALUES (1), (2)) AS x(n)")


@query("""
    WITH ver AS (SELECT doc_id, version, sha256(text) AS sha FROM {id_versions}), known AS (SELECT * FROM ver UNION ALL SELECT doc_id, 1, sha256(text) FROM {id_live} WHERE doc_id NOT IN (SELECT doc_id FROM ver)),
    ever AS (SELECT doc_id, sha FROM known UNION SELECT doc_id, sha256(text) FROM {id_live}), inc AS (SELECT doc_id, sha256(text) AS sha, min(batch_order) AS batch_order FROM {id_incoming} GROUP BY ALL),
    fresh AS (SELECT i.* FROM inc i WHERE NOT EXISTS (SELECT 1 FROM ever e WHERE e.doc_id = i.doc_id AND e.sha = i.sha))
    SELECT doc_id, 1 AS version, sha256(text) AS sha, 'backfill' AS why FROM {id_live} WHERE doc_id NOT IN (SELECT doc_id FROM ver) AND doc_id IN (SELECT doc_id FROM inc)
    UNION ALL SELECT f.doc_id, coalesce((SELECT max(version) FROM known k WHERE k.doc_id = f.doc_id), 0) + row_number() OVER (PARTITION BY f.doc_id ORDER BY batch_order), sha, 'staged' FROM fresh f""")
def stage_versions(t: Tables) -> DataFrame:
    versions = t("id_versions").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    return I.stage_versions(t("id_live"), versions, t("id_incoming"))


source("decided_docs", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN text ELSE text || ' next' END AS text, doc_id % 4 = 1 AS authenticated, doc_id % 3 AS n_flags FROM {documents}")
source("resolutions", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'SAME_SOURCE' ELSE 'NEW_SOURCE' END AS status, CASE WHEN doc_id % 5 = 1 THEN doc_id % 20 END AS source_id FROM {documents}")
source("linked_docs", "SELECT doc_id % (1 + CAST(floor(n_docs / 60) AS BIGINT)) AS source_id, doc_id, 1000000 - doc_id AS linked_order FROM {documents} CROSS JOIN (SELECT count(*) AS n_docs FROM {documents}) WHERE doc_id % 20 <> 11")


@query("""
    WITH twins AS (SELECT text, min(doc_id) AS twin_id FROM {id_live} GROUP BY text), early AS (SELECT source_id, arg_min(doc_id, linked_order) AS earliest FROM {linked_docs} GROUP BY source_id),
    j AS (SELECT d.doc_id, twin_id, r.status, earliest, l.doc_id IS NOT NULL AS is_known, authenticated, n_flags FROM {decided_docs} d LEFT JOIN twins ON twins.text = d.text LEFT JOIN {resolutions} r ON r.doc_id = d.doc_id
        LEFT JOIN early e ON e.source_id = r.source_id LEFT JOIN {id_live} l ON l.doc_id = d.doc_id)
    SELECT doc_id, CASE WHEN twin_id IS NOT NULL THEN 'duplicate' WHEN status = 'CONFLICT' THEN 'reject' WHEN status = 'SAME_SOURCE' AND earliest <> doc_id THEN 'redirect' WHEN is_known AND authenticated AND n_flags = 0 THEN 'stage_accepted' WHEN is_known THEN 'stage' ELSE 'live' END AS decision,
        CASE WHEN twin_id IS NOT NULL THEN twin_id WHEN status = 'CONFLICT' THEN NULL WHEN status = 'SAME_SOURCE' AND earliest <> doc_id THEN earliest END AS target_id FROM j""")
def ingest_decision(t: Tables) -> DataFrame:
    return I.ingest_decision(t("decided_docs"), t("id_live"), t("resolutions"), t("linked_docs"))


source("acceptances", "SELECT doc_id, version, 'editor' || CAST(doc_id % 3 AS STRING) AS accepted_by FROM {id_versions} WHERE (doc_id + version) % 3 <> 0")


@query("""
    SELECT v.doc_id, v.version, CASE WHEN accepted_by IS NULL THEN 'pending' WHEN v.version = max(CASE WHEN accepted_by IS NOT NULL THEN v.version END) OVER (PARTITION BY v.doc_id) THEN 'live' ELSE 'past' END AS state, accepted_by
    FROM {id_versions} v LEFT JOIN {acceptances} a ON a.doc_id = v.doc_id AND a.version = v.version""")
def version_history(t: Tables) -> DataFrame:
    return I.version_history(t("id_versions").select("doc_id", "version"), t("acceptances"))


source("text_pairs", "SELECT doc_id, text AS old_text, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || 'added line' WHEN 1 THEN replace(text, 'the', 'teh') ELSE 'a first line' || chr(10) || text END AS new_text FROM {documents}")


@query("""
    WITH o AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(old_text, chr(10))) AS line FROM {text_pairs}) GROUP BY ALL), n AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(new_text, chr(10))) AS line FROM {text_pairs}) GROUP BY ALL),
    j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.n, 0) AS a, coalesce(n.n, 0) AS b FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.line = n.line)
    SELECT doc_id, sum(b) - sum(least(a, b)) AS added, sum(a) - sum(least(a, b)) AS removed, sum(least(a, b)) AS kept, round(2.0 * sum(least(a, b)) / (sum(a) + sum(b)), 6) AS similarity FROM j GROUP BY doc_id""")
def version_change_summary(t: Tables) -> DataFrame:
    return I.version_change_summary(t("text_pairs"))


source("raw_identifiers", """
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'doi' WHEN 2 THEN 'isbn' WHEN 3 THEN 'pmid' WHEN 4 THEN 'url' ELSE 'other' END AS type,
        CASE doc_id % 12 WHEN 0 THEN 'arXiv:2101.' || CAST(10000 + doc_id AS STRING) || 'v2' WHEN 6 THEN 'https://arxiv.org/pdf/2305.0' || CAST(1000 + doc_id % 9000 AS STRING) || '.pdf' WHEN 1 THEN ' DOI: 10.1234/ABC.' || CAST(doc_id AS STRING) || '.' WHEN 7 THEN 'https://dx.doi.org/10.5555/x' || CAST(doc_id AS STRING)
            WHEN 2 THEN 'ISBN-10: 0-306-40615-2' WHEN 8 THEN '978' || CAST(1000000000 + doc_id * 37 AS STRING) WHEN 3 THEN 'PMID: 00' || CAST(doc_id AS STRING) WHEN 9 THEN '12x'
            WHEN 4 THEN 'HTTPS://Www.Example.com:443/a/index.html?utm_source=z&b=2&a=' || CAST(doc_id AS STRING) || '#top' WHEN 10 THEN 'http://h.example:8080/p' || CAST(doc_id AS STRING) || '/' ELSE ' note ' || CAST(doc_id AS STRING) || ' ' END AS value_raw
    FROM {documents}""")
_DIGITS = " + ".join(f"{10 - i} * CAST(substr(v, {i + 1}, 1) AS INT)" for i in range(9))
_SUM12 = " + ".join(f"{1 if i % 2 == 0 else 3} * CAST(substr({{v}}, {i + 1}, 1) AS INT)" for i in range(12))
source("normal_identifiers", rf"""
    SELECT doc_id, type, value_raw, CASE type
        WHEN 'arxiv' THEN CASE WHEN regexp_matches(x, '^[0-9]{{4}}\.[0-9]{{4,5}}$') THEN x END
        WHEN 'doi' THEN CASE WHEN regexp_matches(d, '^10\.[0-9]{{4,9}}/[^\s]+$') THEN d END
        WHEN 'isbn' THEN CASE WHEN length(v) = 10 AND ({_DIGITS} + CASE WHEN substr(v, 10, 1) = 'X' THEN 10 ELSE CAST(substr(v, 10, 1) AS INT) END) % 11 = 0 THEN '978' || substr(v, 1, 9) || CAST((10 - ({_SUM12.replace('{v}', "('978' || v)")}) % 10) % 10 AS VARCHAR)
            WHEN length(v) = 13 AND CAST((10 - ({_SUM12.replace('{v}', 'v')}) % 10) % 10 AS VARCHAR) = substr(v, 13, 1) THEN v END
        WHEN 'pmid' THEN CASE WHEN regexp_matches(m, '^[0-9]{{1,9}}$') AND regexp_matches(m, '[1-9]') THEN ltrim(m, '0') END
        WHEN 'url' THEN CASE WHEN doc_id % 12 = 4 THEN 'https://www.example.com/a?a=' || doc_id || '&b=2' ELSE 'http://h.example:8080/p' || doc_id END
        ELSE trim(value_raw) END AS value_norm
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(value_raw), '^https://arxiv.org/(abs|pdf)/', ''), '^arXiv:', ''), '\.pdf$', ''), 'v[0-9]+$', '') AS x,
        rtrim(lower(trim(regexp_replace(regexp_replace(trim(value_raw), '^DOI:\s*', ''), '^https://dx.doi.org/', ''))), '.,;:') AS d, CASE WHEN type = 'isbn' THEN regexp_replace(regexp_replace(value_raw, '^ISBN-1[03]: *', ''), '[\s-]', '', 'g') ELSE '0000000000000' END AS v,
        regexp_replace(value_raw, '^PMID: *', '') AS m FROM {{raw_identifiers}})""")


@query("SELECT doc_id, type, value_norm FROM {normal_identifiers}")
def normalise_identifiers(t: Tables) -> DataFrame:
    return I.normalise_identifiers(t("raw_identifiers")).select("doc_id", "type", "value_norm")


_Q = "chr(34) || {v} || chr(34)"
#: How many values of each kind there are grows with the documents, so that a value is shared by a few of them at any size.
source("id_scale", "SELECT 1 + CAST(floor(count(*) * 0.45) AS BIGINT) AS dois, 1 + CAST(floor(count(*) * 0.3) AS BIGINT) AS more_dois, 1 + CAST(floor(count(*) * 0.2) AS BIGINT) AS urls, 1 + CAST(floor(count(*) * 0.1) AS BIGINT) AS isbns FROM {documents}")
source("isbn_bodies", "SELECT doc_id, '978' || lpad(CAST(doc_id % isbns AS STRING), 9, '0') AS v FROM {documents} CROSS JOIN {id_scale}")
source("isbns", f"SELECT doc_id, v || CAST((10 - ({_SUM12.replace('{v}', 'v')}) % 10) % 10 AS STRING) AS isbn FROM {{isbn_bodies}}")
source("identified_docs", "SELECT d.doc_id, d.doc_id % 3 <> 0 AS trusted, " + maintenance._json(
    doi=_Q.replace("{v}", "CASE WHEN d.doc_id % 7 = 0 THEN 'not a doi' ELSE '10.1000/s' || CAST(d.doc_id % dois AS STRING) END"), isbn=_Q.replace("{v}", "CASE WHEN d.doc_id % 4 = 2 THEN isbn ELSE '0-306-40615-' || CAST(d.doc_id % 4 AS STRING) END"),
    source_url=_Q.replace("{v}", "'http://h.example:80/d' || CAST(d.doc_id % urls AS STRING) || '/'"), identifier_origin=_Q.replace("{v}", "CASE WHEN d.doc_id % 2 = 0 THEN 'original' ELSE 'derived' END"))
    + " AS provenance, " + maintenance._json(DOI=_Q.replace("{v}", "'https://doi.org/10.1000/S' || CAST(d.doc_id % more_dois AS STRING)")) + " AS metadata FROM {documents} d JOIN {isbns} i ON i.doc_id = d.doc_id CROSS JOIN {id_scale}")
source("identifiers", """
    SELECT doc_id, type, value_norm, max(canonical) AS is_canonical FROM (
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'doi' END AS type, CASE WHEN doc_id % 7 = 0 THEN 'not a doi' ELSE '10.1000/s' || CAST(doc_id % dois AS STRING) END AS value_norm, doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 2 = 0 AS canonical FROM {documents} CROSS JOIN {id_scale}
        UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'isbn' ELSE 'other' END, CASE WHEN doc_id % 4 = 2 THEN isbn ELSE '0-306-40615-' || CAST(doc_id % 4 AS STRING) END, doc_id % 4 = 2 AND doc_id % 3 <> 0 FROM {isbns}
        UNION ALL SELECT doc_id, 'url', 'http://h.example/d' || CAST(doc_id % urls AS STRING), FALSE FROM {documents} CROSS JOIN {id_scale}
        UNION ALL SELECT doc_id, 'doi', '10.1000/s' || CAST(doc_id % more_dois AS STRING), doc_id % 3 <> 0 FROM {documents} CROSS JOIN {id_scale}) AS u GROUP BY doc_id, type, value_norm""")


@query("SELECT * FROM {identifiers}")
def extract_identifiers(t: Tables) -> DataFrame:
    return I.extract_identifiers(t("identified_docs"))


#: Documents of one language are new, the others' identifiers are linked to sources, whose number grows with the documents.
source("source_links", """
    SELECT DISTINCT i.doc_id % (1 + CAST(floor(n_docs / 60) AS BIGINT)) AS source_id, type, value_norm, is_canonical AND i.doc_id % 11 < 5 AS is_canonical
    FROM {identifiers} i JOIN {documents} d ON d.doc_id = i.doc_id CROSS JOIN (SELECT count(*) AS n_docs FROM {documents}) WHERE d.lang <> 'fr'""")
source("new_identifiers", "SELECT i.doc_id, type, value_norm, is_canonical FROM {identifiers} i JOIN {documents} d ON d.doc_id = i.doc_id WHERE d.lang = 'fr'")


@query("""
    WITH n AS (SELECT * FROM {new_identifiers} WHERE type <> 'other'), l AS (SELECT * FROM {source_links} WHERE type <> 'other'),
    cn AS (SELECT doc_id, type, min(value_norm) AS canon, count(DISTINCT value_norm) AS k FROM n WHERE is_canonical GROUP BY ALL), dbl AS (SELECT DISTINCT doc_id FROM cn WHERE k > 1),
    st AS (SELECT n.doc_id, count(DISTINCT l.source_id) AS k, min(l.source_id) AS source_id FROM n JOIN l ON n.type = l.type AND n.value_norm = l.value_norm AND n.is_canonical AND l.is_canonical GROUP BY n.doc_id),
    dif AS (SELECT DISTINCT cn.doc_id, l.source_id FROM cn JOIN l ON l.type = cn.type AND l.is_canonical AND l.value_norm <> cn.canon), weak AS (SELECT DISTINCT n.doc_id, l.source_id FROM n JOIN l ON n.type = l.type AND n.value_norm = l.value_norm),
    rev AS (SELECT doc_id FROM (SELECT * FROM weak EXCEPT SELECT * FROM dif)), ign AS (SELECT doc_id, count(*) AS k FROM (SELECT * FROM weak INTERSECT SELECT * FROM dif) GROUP BY doc_id),
    s AS (SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM dbl) THEN 'CONFLICT' WHEN st.k > 1 THEN 'CONFLICT' WHEN EXISTS (SELECT 1 FROM dif WHERE dif.doc_id = d.doc_id AND dif.source_id = st.source_id) THEN 'CONFLICT' WHEN st.k = 1 THEN 'SAME_SOURCE' WHEN d.doc_id IN (SELECT doc_id FROM rev) THEN 'REVIEW' ELSE 'NEW_SOURCE' END AS status, st.source_id AS sid
        FROM (SELECT DISTINCT doc_id FROM n) d LEFT JOIN st ON st.doc_id = d.doc_id)
    SELECT s.doc_id, status, CASE WHEN status = 'SAME_SOURCE' THEN sid END AS source_id, coalesce(ign.k, 0) AS n_ignored FROM s LEFT JOIN ign ON ign.doc_id = s.doc_id""")
def resolve_sources(t: Tables) -> DataFrame:
    return I.resolve_sources(t("new_identifiers"), t("source_links"))


source("chained", "SELECT doc_id, 'doi' AS type, 'c' || CAST(floor((doc_id + x) / 3) AS STRING) AS value_norm, doc_id % 10 <> 9 AS is_canonical FROM {documents} CROSS JOIN (VALUES (0), (1)) AS v(x)")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM {chained} a JOIN {chained} b ON a.value_norm = b.value_norm AND a.is_canonical AND b.is_canonical),
    r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
    SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id""")
def source_components(t: Tables) -> DataFrame:
    return I.source_components(t("chained"))


@query("SELECT source_id, type, count(DISTINCT value_norm) AS n_values FROM {source_links} WHERE is_canonical GROUP BY ALL HAVING count(DISTINCT value_norm) > 1")
def canonical_conflicts(t: Tables) -> DataFrame:
    return I.canonical_conflicts(t("source_links"))


@query("SELECT type, count(*) AS n_links, count(DISTINCT source_id) AS n_sources FROM {source_links} WHERE is_canonical GROUP BY type")
def canonical_counts(t: Tables) -> DataFrame:
    return I.canonical_counts(t("source_links"))


@query("SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {linked_docs})")
def orphan_documents(t: Tables) -> DataFrame:
    return t("documents").select("doc_id").join(t("linked_docs").select("doc_id"), "doc_id", "left_anti")


source("given_identifiers", "SELECT DISTINCT type, value_norm FROM {new_identifiers} WHERE doc_id % 4 = 1")


@query("""
    SELECT l.source_id, type, value_norm, documents FROM {source_links} l LEFT JOIN (SELECT source_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY linked_order, doc_id) AS documents FROM {linked_docs} GROUP BY source_id) d ON d.source_id = l.source_id
    WHERE l.source_id IN (SELECT x.source_id FROM {source_links} x JOIN {given_identifiers} g ON g.type = x.type AND g.value_norm = x.value_norm)""")
def source_lookup(t: Tables) -> DataFrame:
    return I.source_lookup(t("source_links"), t("linked_docs"), t("given_identifiers"))
