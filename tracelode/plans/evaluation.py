"""Queries of evaluation, bound to rankings and to checks derived from ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.store import written
from . import ranking  # noqa: F401
from .registry import Tables, query, source

source("golden", """
    SELECT e.query_id, CASE WHEN q.number % 3 = 0 THEN 'supported' WHEN q.number % 3 = 1 THEN 'insufficient' ELSE 'not_applicable' END AS expected_status,
        CASE WHEN q.number % 3 = 0 THEN expected_document_id END AS expected_document_id FROM {expected} e JOIN {questions} q ON q.query_id = e.query_id""")
source("live_documents", "SELECT doc_id AS document_id FROM {documents} WHERE lang <> 'fr'")
source("golden_answers", "SELECT query_id, CASE WHEN number % 4 IN (0, 3) THEN 'supported' WHEN number % 4 = 2 THEN 'insufficient' ELSE 'not_applicable' END AS status FROM {questions}")
source("golden_cited", "SELECT query_id, document_id FROM {context} WHERE position <= 2 AND distance <= 1.2")
source("cases", """
    SELECT q.query_id, e.expected_document_id, c.chunk_id AS expected_chunk_id, CASE WHEN q.number % 3 = 0 THEN 'direct' ELSE 'paraphrase' END AS stratum
    FROM {questions} q JOIN {expected} e ON e.query_id = q.query_id JOIN {candidates} c ON c.query_id = q.query_id AND c.rank = 1 + (q.number * 3) % 11""")
source("variant_rankings", """
    SELECT query_id, chunk_id, document_id, rank, 'dense' AS variant FROM {candidates}
    UNION ALL SELECT query_id, chunk_id, document_id, fused_rank AS rank, 'hybrid' AS variant FROM {hybrid}""")
source("variant_contexts", """
    SELECT query_id, document_id, 'dense' AS variant FROM {context}
    UNION ALL SELECT query_id, document_id, 'hybrid' AS variant FROM {fused_context}""")
source("records", """
    SELECT r.query_id, c.stratum, r.variant, CAST(max(CASE WHEN r.rank <= 5 AND (r.document_id = c.expected_document_id OR r.chunk_id = c.expected_chunk_id) THEN 1 ELSE 0 END) AS DOUBLE) AS doc_hit,
        coalesce(max(CASE WHEN r.document_id = c.expected_document_id OR r.chunk_id = c.expected_chunk_id THEN 1 / CAST(r.rank AS DOUBLE) END), CAST(0 AS DOUBLE)) AS doc_rr,
        coalesce(max(CASE WHEN r.chunk_id = c.expected_chunk_id THEN 1 / CAST(r.rank AS DOUBLE) END), CAST(0 AS DOUBLE)) AS chunk_rr,
        CASE WHEN r.variant = 'dense' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END + CAST(r.query_id % 7 AS DOUBLE) / 100 AS latency
    FROM {variant_rankings} r JOIN {cases} c ON c.query_id = r.query_id GROUP BY r.query_id, c.stratum, r.variant""")
source("differences", """
    SELECT a.query_id, CAST(b.doc_rr - a.doc_rr AS DOUBLE) AS difference FROM {records} a JOIN {records} b ON b.query_id = a.query_id AND a.variant = 'dense' AND b.variant = 'hybrid'""")
source("signals", "SELECT d.query_id, b.gap, d.difference + 0.05 AS gain, CAST(floor(d.query_id / 20) AS INT) % 2 AS fold FROM {differences} d JOIN {bands} b ON b.query_id = d.query_id")
source("check_results", """
    SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS trace_id, k.check_name, k.check_type, r.run_label, k.severity,
        (conv_id * 7 + turn * 13 + k.i * 5 + r.j * 3) % (8 + 6 * r.j + k.i) > 0 AS pass
    FROM {conversations} CROSS JOIN (VALUES ('grounded', 'code', 'critical', 0), ('limits', 'code', 'high', 1), ('action', 'judge', 'medium', 2)) AS k(check_name, check_type, severity, i)
    CROSS JOIN (VALUES ('baseline', 0), ('after', 1)) AS r(run_label, j) WHERE role = 'assistant' AND NOT (k.i = 2 AND r.j = 0)""")
source("tickets", """
    SELECT conv_id * 100 + turn AS message_id, 'Turn ' || CAST(turn AS STRING) AS subject,
        text || CASE (conv_id * 5 + turn) % 9 WHEN 0 THEN ' I was charged twice, refund please' WHEN 1 THEN ' the app crash is urgent' WHEN 2 THEN ' How do I find it'
            WHEN 3 THEN ' login fails, not urgent, no rush' WHEN 4 THEN ' cannot access anything, everyone is down' WHEN 5 THEN ' please add a feature' WHEN 6 THEN ' delete my invoice' ELSE '' END AS body,
        CASE conv_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'critical' ELSE 'medium' END AS asked,
        CASE (conv_id * 5 + turn) % 9 WHEN 0 THEN 'billing' WHEN 1 THEN 'bug' WHEN 2 THEN 'how_to' WHEN 3 THEN 'account' WHEN 4 THEN 'account' WHEN 5 THEN 'feature_request' WHEN 6 THEN 'billing' ELSE NULL END AS expected_category,
        CASE WHEN (conv_id * 5 + turn) % 9 IN (1, 4) THEN 'P1' WHEN (conv_id * 5 + turn) % 9 IN (0, 3, 6) THEN 'P2' END AS expected_priority,
        (conv_id * 5 + turn) % 9 IN (0, 6) AS expected_irreversible, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS slice
    FROM {conversations} WHERE role = 'user'""")

# Keyword tables of the triage, routing and knowledge-base rules.
TRIAGE = (
    (("refund", "charged", "invoice", "billing", "payment"), "billing"),
    (("error", "crash", "broken", "500", "fails", "bug"), "bug"),
    (("password", "log in", "login", "locked out", "access"), "account"),
    (("how do i", "how to", "where is", "can i"), "how_to"),
    (("would be great", "feature", "please add", "wish"), "feature_request"),
)
URGENT = ("down", "outage", "cannot access", "urgent", "everyone")
DOWNPLAYED = ("not urgent", "no rush", "low priority")
IRREVERSIBLE = ("refund", "delete", "cancel", "legal", "lawyer")
TECHNICAL = ("error", "bug", "crash", "not working", "broken")
BILLING = ("bill", "charge", "payment", "invoice", "refund")
HOURS = {"low": 48, "medium": 24, "high": 4, "critical": 1}


@query("SELECT query_id, expected_document_id FROM {golden} WHERE expected_document_id IS NOT NULL AND expected_document_id NOT IN (SELECT document_id FROM {live_documents})")
def golden_preflight(t: Tables) -> DataFrame:
    return E.golden_preflight(t("golden"), t("live_documents"))


source("golden_scores", """
    SELECT query_id, retrieval_ok, status_ok, citation_ok, status_ok AND citation_ok AS generation_ok FROM (
        SELECT g.query_id, CASE WHEN expected_document_id IS NOT NULL THEN EXISTS (SELECT 1 FROM {context} c WHERE c.query_id = g.query_id AND c.document_id = expected_document_id)
                ELSE coalesce((SELECT min(distance) FROM {candidates} c WHERE c.query_id = g.query_id) <= 1.2, FALSE) = (expected_status <> 'not_applicable') END AS retrieval_ok,
            (SELECT max(status) FROM {golden_answers} a WHERE a.query_id = g.query_id) IS NOT DISTINCT FROM expected_status AS status_ok,
            CASE WHEN expected_document_id IS NOT NULL THEN EXISTS (SELECT 1 FROM {golden_cited} c WHERE c.query_id = g.query_id AND c.document_id = expected_document_id)
                ELSE NOT EXISTS (SELECT 1 FROM {golden_cited} c WHERE c.query_id = g.query_id) END AS citation_ok
        FROM {golden} g)""")


def _scores(t: Tables) -> DataFrame:
    return E.golden_score(t("golden"), t("candidates"), t("context"), t("golden_answers"), t("golden_cited"))


@query("SELECT * FROM {golden_scores}")
def golden_score(t: Tables) -> DataFrame:
    return _scores(t)


@query("""SELECT count(*) AS n, count(*) FILTER (retrieval_ok) AS n_retrieval_ok, count(*) FILTER (status_ok) AS n_status_ok, count(*) FILTER (citation_ok) AS n_citation_ok,
    count(*) FILTER (generation_ok) AS n_generation_ok FROM {golden_scores}""")
def golden_totals(t: Tables) -> DataFrame:
    return E.golden_totals(_scores(t))


@query("""
    SELECT r.query_id, r.variant, coalesce(h.doc_hit, 0.0) AS doc_hit, round(coalesce(1.0 / dr, 0), 6) AS doc_rr, round(coalesce(1.0 / cr, 0), 6) AS chunk_rr
    FROM (SELECT c.query_id, v.variant, min(CASE WHEN v.document_id = c.expected_document_id THEN v.rank END) AS dr, min(CASE WHEN v.chunk_id = c.expected_chunk_id THEN v.rank END) AS cr
        FROM {cases} c LEFT JOIN {variant_rankings} v ON v.query_id = c.query_id AND v.rank <= 8 GROUP BY ALL) r
    LEFT JOIN (SELECT c.query_id, v.variant, max(CASE WHEN v.document_id = c.expected_document_id THEN CAST(1.0 AS DOUBLE) ELSE 0.0 END) AS doc_hit
        FROM {cases} c JOIN {variant_contexts} v ON v.query_id = c.query_id GROUP BY ALL) h ON h.query_id = r.query_id AND h.variant = r.variant""")
def retrieval_metrics(t: Tables) -> DataFrame:
    return E.retrieval_metrics(t("cases").drop("stratum"), t("variant_rankings"), t("variant_contexts"))


def _once(t: Tables, *names: str) -> DataFrame:
    """The last of these inputs; each is written where it lies, as reports and the passes of percentiles read them again and again."""
    for name in names:
        t.give(name, written(t(name), name))
    return t(names[-1])


@query("""
    SELECT r.variant, stratum, count(*) AS n, round(avg(doc_hit), 6) AS mean_doc_hit, round(avg(doc_rr), 6) AS mean_doc_rr, round(avg(chunk_rr), 6) AS mean_chunk_rr, round(avg(latency), 6) AS mean_latency,
        count(*) FILTER (doc_rr > base_rr) AS wins, count(*) FILTER (doc_rr < base_rr) AS losses
    FROM {records} r JOIN (SELECT query_id AS b, doc_rr AS base_rr FROM {records} WHERE variant = 'dense') ON b = query_id
    GROUP BY GROUPING SETS ((r.variant, stratum), (r.variant))""")
def eval_report(t: Tables) -> DataFrame:
    return E.eval_report(_once(t, "records"), "dense")


@query("""
    WITH h AS (SELECT query_id, max(CASE WHEN v.document_id = c.expected_document_id AND variant = 'dense' THEN 1 ELSE 0 END) AS b, max(CASE WHEN v.document_id = c.expected_document_id AND variant = 'hybrid' THEN 1 ELSE 0 END) AS a
        FROM {cases} c LEFT JOIN {variant_contexts} v USING (query_id) GROUP BY query_id)
    SELECT sum(b) AS hits_before, sum(a) AS hits_after, count(*) FILTER (a > b) AS won, count(*) FILTER (a < b) AS lost, sum(a) < sum(b) AS regression FROM h""")
def hit_regression_gate(t: Tables) -> DataFrame:
    return E.hit_regression_gate(t("cases"), t("context"), t("fused_context"))


#: The two-sided tail of the normal distribution by its power series, whose double factorials come from the gamma function.
_TAIL = """CASE WHEN x > 8 THEN 0.0 WHEN x = 0 THEN 1.0 ELSE greatest(1 - 2 * exp(-x * x / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(150), lambda k: exp((2 * k + 1) * ln(x) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))), 0) END"""


@query(f"""
    WITH digests AS (SELECT k, difference, md5('7:' || k || ':' || query_id) AS h FROM {{differences}}, range(79) r(k)),
    s AS (SELECT k * 128 + i + 1 AS p, sum(CASE WHEN ((strpos('0123456789abcdef', substr(h, CAST(i // 4 + 1 AS BIGINT), 1)) - 1) >> (3 - i % 4)) & 1 = 1 THEN -difference ELSE difference END) AS s
        FROM digests, range(128) b(i) GROUP BY ALL),
    f AS (SELECT count(*) AS n, avg(difference) AS mean, stddev_samp(difference) AS sd, sum(difference) AS total, max(abs(difference)) AS largest FROM {{differences}}),
    g AS (SELECT *, mean / nullif(sd / sqrt(n), 0) AS t, abs(mean / nullif(sd / sqrt(n), 0)) AS x FROM f)
    SELECT n, round(mean, 6) AS mean_difference, round(sd, 6) AS sd, round(t, 5) AS t, round(CASE WHEN t IS NOT NULL THEN {_TAIL} END, 5) AS p_t,
        round(CASE WHEN largest = 0 THEN 1.0 ELSE ((SELECT count(*) FROM s WHERE p <= 10000 AND abs(s) >= abs(total) - 1e-9) + 1) / 10001 END, 6) AS p FROM g""")
def paired_tests(t: Tables) -> DataFrame:
    return E.paired_tests(_once(t, "records", "differences"))


@query("""
    WITH grid AS (SELECT DISTINCT unnest(quantile_cont(gap, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS threshold FROM {signals} WHERE fold = 0),
    tried AS (SELECT threshold, count(*) FILTER (gap <= threshold) AS calls, sum(CASE WHEN gap <= threshold THEN gain ELSE 0 END) AS kept, sum(gain) AS all_gain FROM {signals}, grid WHERE fold = 0 GROUP BY threshold),
    best AS (SELECT threshold, calls FROM tried WHERE kept >= 0.9 * all_gain - 1e-12 ORDER BY calls, threshold LIMIT 1)
    SELECT round(threshold, 6) AS threshold, calls, count(*) FILTER (fold = 1 AND gap <= threshold) AS odd_calls, round(sum(CASE WHEN fold = 1 AND gap <= threshold THEN gain ELSE 0 END), 6) AS odd_gain,
        round(sum(CASE WHEN fold = 1 THEN gain ELSE 0 END), 6) AS odd_all_gain FROM {signals}, best GROUP BY threshold, calls""")
def gate_threshold_search(t: Tables) -> DataFrame:
    return E.gate_threshold_search(_once(t, "records", "signals"))


@query("""
    WITH e AS (SELECT quantile_cont(gap, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e, corr(gap, gain) AS c FROM {signals})
    SELECT bin, count(*) AS n, round(avg(gain), 6) AS mean_gain, round(any_value(c), 6) AS correlation
    FROM {signals}, e, (VALUES (0), (1), (2), (3)) b(bin) WHERE gap >= e[bin + 1] AND gap <= e[bin + 2] GROUP BY bin""")
def signal_quartile_gain(t: Tables) -> DataFrame:
    return E.signal_quartile_gain(_once(t, "records", "signals"))


@query(r"""
    WITH fit AS (SELECT *, md5('13:' || chunk_id) AS h FROM {chunks} WHERE chunk_index > 0 AND length(text) >= 400 AND len(regexp_extract_all(text, '\[[0-9]{1,3}\]')) < 3),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY h) AS k FROM fit) WHERE k = 1)
    SELECT stratum, place, chunk_id, document_id FROM (SELECT *, document_id % 3 AS stratum, row_number() OVER (PARTITION BY document_id % 3 ORDER BY h) AS place FROM one) WHERE place <= 5""")
def stratified_candidates(t: Tables) -> DataFrame:
    return E.stratified_candidates(t("chunks"))


source("generated", """
    SELECT c.conv_id * 1000 + c.turn AS query_id, c.turn % 3 AS stratum, c.text || CASE WHEN c.conv_id % 7 = 0 THEN ' passage' ELSE '' END AS question, d.text || CASE WHEN c.conv_id % 2 = 0 THEN ' ' || c.text ELSE '' END AS text
    FROM {conversations} c CROSS JOIN (SELECT count(*) AS n_docs FROM {documents}) JOIN {documents} d ON d.doc_id = (c.conv_id * 7 + c.turn) % n_docs WHERE c.role = 'user'""")


@query(r"""
    WITH w AS (SELECT *, list_filter(regexp_split_to_array(lower(question), '[^\p{L}0-9]+'), lambda x: x <> '') AS q, list_filter(regexp_split_to_array(lower(text), '[^\p{L}0-9]+'), lambda x: x <> '') AS b FROM {generated})
    SELECT CASE WHEN list_has_any(q, ['passage', 'document', 'excerpt']) THEN 'leak' WHEN len(q) < CASE stratum WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 3 END OR len(q) > CASE stratum WHEN 0 THEN 20 WHEN 1 THEN 14 ELSE 12 END THEN 'length'
        WHEN len(list_intersect(list_distinct(q), list_distinct(b))) / greatest(len(list_distinct(q)), 1) > 0.5 THEN 'overlap' ELSE 'ok' END AS reason, count(*) AS n FROM w GROUP BY ALL""")
def question_filters(t: Tables) -> DataFrame:
    return E.question_filters(t("generated"), ("passage", "document", "excerpt"), {0: (5, 20), 1: (8, 14), 2: (3, 12)})


source("check_summaries", "SELECT run_label, check_name, check_type, count(*) AS total, count(*) FILTER (WHERE pass) AS passed, round(100.0 * count(*) FILTER (WHERE pass) / count(*), 2) AS percent FROM {check_results} GROUP BY ALL")


@query("SELECT * FROM {check_summaries}")
def check_summary(t: Tables) -> DataFrame:
    return E.check_summary(t("check_results"))


@query("SELECT check_name AS category, count(*) AS total, count(*) FILTER (NOT pass) AS failures, round(count(*) FILTER (NOT pass) / count(*), 4) AS failure_rate FROM {check_results} GROUP BY ALL")
def failure_summary(t: Tables) -> DataFrame:
    return E.failure_summary(t("check_results").withColumnRenamed("check_name", "category"))


@query("""
    SELECT category, severity, failures, priority_score, rank() OVER (ORDER BY priority_score DESC) AS priority_rank FROM (
        SELECT check_name AS category, severity, count(*) FILTER (NOT pass) AS failures, count(*) FILTER (NOT pass) * CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS priority_score FROM {check_results} GROUP BY check_name, severity)""")
def failure_priority(t: Tables) -> DataFrame:
    counts = t("check_results").groupBy(F.col("check_name").alias("category"), "severity").agg(F.sum(F.when(~F.col("pass"), 1).otherwise(0)).alias("failures"))
    return E.failure_priority(counts, {"critical": 4, "high": 3, "medium": 2, "low": 1})


source("trace_passes", "SELECT run_label, trace_id, min(CASE WHEN pass THEN 1 ELSE 0 END) AS ok FROM {check_results} GROUP BY run_label, trace_id")


@query("""
    SELECT *, CASE WHEN rate >= 0.95 THEN 'SHIP' WHEN rate >= 0.85 THEN 'MITIGATE' ELSE 'BLOCK' END AS decision FROM (
        SELECT run_label, count(*) AS total, count(*) FILTER (ok = 1) AS passed, round(avg(ok), 4) AS rate FROM {trace_passes} GROUP BY run_label)""")
def ship_decision(t: Tables) -> DataFrame:
    return E.ship_decision(t("check_results"))


@query("""
    SELECT coalesce(a.check_name, b.check_name) AS check_name, a.percent AS before, b.percent AS after, round(b.percent - a.percent, 2) AS delta
    FROM (SELECT * FROM {check_summaries} WHERE run_label = 'baseline') a FULL JOIN (SELECT * FROM {check_summaries} WHERE run_label = 'after') b ON a.check_name = b.check_name""")
def run_delta(t: Tables) -> DataFrame:
    return E.run_delta(t("check_results"), "baseline", "after")


@query("""
    SELECT a.trace_id, CASE WHEN a.ok = 0 AND b.ok = 1 THEN 'fixed' WHEN a.ok = 1 AND b.ok = 0 THEN 'regressed' WHEN a.ok = 0 THEN 'still_failing' ELSE 'passing' END AS flip
    FROM {trace_passes} a JOIN {trace_passes} b ON a.trace_id = b.trace_id AND a.run_label = 'baseline' AND b.run_label = 'after'""")
def trace_flips(t: Tables) -> DataFrame:
    return E.trace_flips(t("check_results"), "baseline", "after")


def _triaged(t: Tables) -> DataFrame:
    return E.triage_rules(t("tickets"), TRIAGE, URGENT, DOWNPLAYED, IRREVERSIBLE)


def _like(words: tuple[str, ...], text: str = "x") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_CATEGORY = "CASE " + " ".join(f"WHEN {_like(w)} THEN '{c}'" for w, c in TRIAGE) + " ELSE 'other' END"
source("triaged", f"""
    SELECT *, CASE WHEN NOT {_like(DOWNPLAYED)} AND {_like(URGENT)} THEN 'P1' WHEN category IN ('bug', 'billing', 'account') THEN 'P2' ELSE 'P3' END AS priority, TRUE AS needs_human FROM (
        SELECT *, {_CATEGORY} AS category, {_like(IRREVERSIBLE)} AS irreversible FROM (SELECT *, lower(subject || ' ' || body) AS x FROM {{tickets}}))""")


@query("SELECT message_id, category, priority, irreversible, needs_human FROM {triaged}")
def triage_rules(t: Tables) -> DataFrame:
    return _triaged(t).select("message_id", "category", "priority", "irreversible", "needs_human")


@query("""
    WITH l AS (SELECT slice, 'category' AS field, expected_category AS e, category AS g FROM {triaged} UNION ALL SELECT slice, 'priority', expected_priority, priority FROM {triaged}
        UNION ALL SELECT slice, 'irreversible', CAST(expected_irreversible AS STRING), CAST(irreversible AS STRING) FROM {triaged} UNION ALL SELECT slice, 'p1_recall', CASE WHEN expected_priority = 'P1' THEN 'P1' END, priority FROM {triaged})
    SELECT field, slice, count(*) FILTER (e = g) AS hits, count(*) AS total, round(count(*) FILTER (e = g) / count(*), 4) AS accuracy FROM l WHERE e IS NOT NULL GROUP BY GROUPING SETS ((field, slice), (field))""")
def field_accuracy(t: Tables) -> DataFrame:
    return E.field_accuracy(_triaged(t), ("category", "priority", "irreversible"))


@query("""
    SELECT message_id, field, e AS expected, g AS got FROM (SELECT message_id, 'category' AS field, expected_category AS e, category AS g FROM {triaged} UNION ALL SELECT message_id, 'priority', expected_priority, priority FROM {triaged}
        UNION ALL SELECT message_id, 'irreversible', CAST(expected_irreversible AS STRING), CAST(irreversible AS STRING) FROM {triaged}) WHERE e IS NOT NULL AND e IS DISTINCT FROM g""")
def accuracy_misses(t: Tables) -> DataFrame:
    return E.accuracy_misses(_triaged(t), ("category", "priority", "irreversible"))


@query("""
    SELECT event_type, value AS percentile, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {events} WHERE value IS NOT NULL)
    WHERE i = round_even(0.95 * (n - 1), 0)""")
def nearest_rank_percentile(t: Tables) -> DataFrame:
    return E.nearest_rank_percentile(t("events"), "event_type", "value", 0.95)


@query(f"SELECT message_id, CASE WHEN {_like(TECHNICAL, 'lower(body)')} THEN 'technical' WHEN {_like(BILLING, 'lower(body)')} THEN 'billing' ELSE 'general' END AS category FROM {{tickets}}")
def route_category(t: Tables) -> DataFrame:
    return E.route_category(t("tickets").select("message_id", F.col("body").alias("text")), TECHNICAL, BILLING).select("message_id", "category")


source("articles", "SELECT * FROM (VALUES (1, 'login', 'Login Issues'), (2, 'crash', 'App Crashing'), (3, 'slow', 'Performance Issues')) AS a(position, keyword, title)")


@query("""
    SELECT message_id, coalesce((SELECT arg_min(title, position) FROM {articles} WHERE contains(lower(body), keyword)), 'General Support') AS title,
        CAST(CASE asked WHEN 'low' THEN 48 WHEN 'medium' THEN 24 WHEN 'high' THEN 4 WHEN 'critical' THEN 1 ELSE 24 END AS BIGINT) AS hours FROM {tickets}""")
def kb_keyword_lookup(t: Tables) -> DataFrame:
    messages = t("tickets").select("message_id", F.col("body").alias("text"), F.col("asked").alias("priority"))
    return E.kb_keyword_lookup(messages, t("articles"), HOURS)
