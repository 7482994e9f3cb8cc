"""Queries of operations, cost and statistics, bound to ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import operations as O
from .registry import Tables, query, source

source("requests", """
    SELECT event_id, event_id AS request_id, user_id, ts AS created_at, event_type AS kind, value AS latency_ms,
        CASE event_type WHEN 'view' THEN '/ask' WHEN 'click' THEN '/agent' WHEN 'purchase' THEN '/ingest' WHEN 'signup' THEN '/stats' ELSE '/ask' END AS path,
        CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 500 WHEN event_type = 'error' AND event_id % 3 = 1 THEN 503 WHEN event_id % 29 = 0 THEN 422 ELSE 200 END AS http_status,
        event_type = 'error' AND event_id % 5 = 0 AS error,
        CASE WHEN event_type IN ('signup', 'purchase') THEN NULL WHEN event_id % 3 = 0 THEN 'supported' WHEN event_id % 3 = 1 THEN 'insufficient' ELSE 'not_applicable' END AS status,
        CASE WHEN event_id % 2 = 0 THEN 'dense' ELSE 'hybrid' END AS rag_mode, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 10000 END AS input_cost, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 5000 END AS output_cost,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 10000 + value / 5000 END AS cost_usd, CAST(round(value * 20) AS BIGINT) AS tokens, props
    FROM {events}""")
source("completions", "SELECT request_id, http_status, latency_ms FROM {requests} WHERE event_id % 17 <> 0")
source("usage", """
    SELECT event_id AS call_id, 'm' || CAST(event_id % 5 AS STRING) AS model, CASE WHEN event_id % 7 = 0 THEN 'batch' ELSE 'standard' END AS tier, CASE event_id % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END AS provider,
        event_id % 5 = 3 AS is_local, CAST(round(value * 100) AS BIGINT) AS input_tokens, CAST(round(value * 40) AS BIGINT) AS output_tokens, CASE WHEN event_id % 50 = 0 THEN 'sampled' END AS note, ts, value
    FROM {events}""")
source("prices", """
    SELECT * FROM (VALUES ('m0', 'standard', 'north', DATE '2023-01-01', 1.0e0, 3.0e0), ('m0', 'standard', 'south', DATE '2024-02-01', 0.5e0, 1.5e0), ('m0', 'batch', 'north', DATE '2023-05-01', 0.4e0, 1.0e0),
        ('m1', 'standard', 'south', DATE '2023-03-01', 2.0e0, 8.0e0), ('m1', 'standard', 'south', DATE '2022-03-01', 4.0e0, 9.0e0), ('m2', 'standard', 'west', DATE '2024-01-01', 0.1e0, 0.4e0))
        AS p(model, tier, provider, effective_from, input_rate, output_rate)""")
source("newest_prices", """
    SELECT model, tier, provider, input_rate, output_rate, effective_from FROM (
        SELECT *, row_number() OVER (PARTITION BY model, tier ORDER BY effective_from DESC, provider DESC) AS k FROM {prices}) WHERE k = 1""")


@query("SELECT event_id, created_at, latency_ms FROM {requests} WHERE kind = 'error' ORDER BY created_at DESC, event_id LIMIT 500")
def query_events(t: Tables) -> DataFrame:
    return O.query_events(t("requests"), "error").select("event_id", "created_at", "latency_ms")


@query("""
    SELECT s.request_id, path, c.latency_ms, CASE WHEN c.http_status IS NULL THEN 'open' WHEN c.http_status >= 400 THEN 'failed' ELSE 'done' END AS state
    FROM {requests} s LEFT JOIN {completions} c ON c.request_id = s.request_id""")
def request_outcomes(t: Tables) -> DataFrame:
    return O.request_outcomes(t("requests"), t("completions"))


@query("""
    SELECT path, count(*) AS n, CASE WHEN count(latency_ms) >= 10 THEN round(quantile_cont(latency_ms, 0.5), 1) END AS p50, CASE WHEN count(latency_ms) >= 10 THEN round(quantile_cont(latency_ms, 0.95), 1) END AS p95,
        count(*) FILTER (error OR http_status >= 400) AS errors, CASE WHEN count(*) >= 10 THEN round(count(*) FILTER (error OR http_status >= 400) / count(*), 4) END AS error_rate,
        CASE WHEN count(status) >= 10 THEN round(count(*) FILTER (status = 'supported') / count(status), 4) END AS hit_rate,
        CASE WHEN path = '/agent' AND count(*) >= 10 THEN round(count(*) FILTER (status = 'not_applicable') / count(*), 4) END AS found_nothing_rate,
        CASE WHEN count(cost_usd) >= 10 THEN round(sum(cost_usd), 6) END AS cost_total, CASE WHEN count(cost_usd) >= 10 THEN round(avg(cost_usd), 6) END AS cost_per_ask
    FROM {requests} WHERE created_at >= TIMESTAMP '2024-01-08 00:00:00' AND path IN ('/ask', '/agent', '/ingest') GROUP BY path""")
def stats_summary(t: Tables) -> DataFrame:
    return O.stats_summary(t("requests"), "2024-01-08 00:00:00", ("/ask", "/agent", "/ingest"))


source("cell_counts", "SELECT user_id, path, count(*) AS n FROM {requests} GROUP BY user_id, path")


@query("SELECT user_id, path, n, n > 0 AND n < 10 AS hidden FROM {cell_counts}")
def suppress_primary(t: Tables) -> DataFrame:
    return O.primary_suppression(t("cell_counts"))


source("nested_counts", """
    SELECT CAST(user_id AS STRING) || path AS name, count(*) AS n FROM {requests} GROUP BY user_id, path
    UNION ALL SELECT CAST(user_id AS STRING) AS name, count(*) AS n FROM {requests} GROUP BY user_id
    UNION ALL SELECT 'all' AS name, count(*) AS n FROM {requests}""")
source("nested_groups", """
    SELECT DISTINCT CAST(user_id AS STRING) AS total, CAST(user_id AS STRING) || path AS cell FROM {requests}
    UNION SELECT DISTINCT 'all' AS total, CAST(user_id AS STRING) AS cell FROM {requests}""")


@query()
def suppress_small_cells(t: Tables) -> DataFrame:
    return O.suppress_small_cells(t("nested_counts"), t("nested_groups"))


@query()
def published_rates(t: Tables) -> DataFrame:
    """Error rate of each user and path, without those that small or hidden cells would disclose."""
    failed = F.sum(F.when(F.col("http_status") >= 400, 1).otherwise(0))
    name = F.concat(F.col("user_id").cast("string"), "path")
    rates = t("requests").groupBy("user_id", "path").agg(failed.alias("part"), F.count("*").alias("whole")).select(name.alias("name"), "part", "whole", name.alias("cell"))
    return O.published_rates(rates, O.suppress_small_cells(t("nested_counts"), t("nested_groups")))


@query("SELECT date_trunc('day', created_at) AS bucket, count(*) AS n FROM {requests} GROUP BY ALL")
def request_volume(t: Tables) -> DataFrame:
    return O.request_volume(t("requests"))


@query("""
    SELECT category, n, round(n / sum(n) OVER (), 4) AS share FROM (
        SELECT CASE WHEN latency_ms >= 60 THEN 'timeout' WHEN http_status IN (502, 503, 504) THEN 'provider' WHEN http_status >= 500 THEN 'internal' WHEN http_status >= 400 THEN 'logical' ELSE 'ok' END AS category, count(*) AS n FROM {requests} GROUP BY ALL)""")
def error_categories(t: Tables) -> DataFrame:
    return O.error_categories(t("requests"))


@query("SELECT path, status, n, round(sum(CASE WHEN status = 'supported' THEN n ELSE 0 END) OVER (PARTITION BY path) / sum(n) OVER (PARTITION BY path), 4) AS supported_share FROM (SELECT path, status, count(*) AS n FROM {requests} WHERE status IS NOT NULL GROUP BY ALL)")
def outcome_mix(t: Tables) -> DataFrame:
    return O.outcome_mix(t("requests"))


@query("""
    SELECT bin, count(*) AS n, count(*) FILTER (d <= 1.2) AS n_passing FROM (
        SELECT d, CAST(CASE WHEN d < 0 THEN 0 WHEN d >= 50 THEN 21 ELSE floor(d / 2.5) + 1 END AS BIGINT) AS bin FROM (SELECT min(latency_ms) AS d FROM {requests} GROUP BY user_id, kind)) GROUP BY bin""")
def distance_histogram(t: Tables) -> DataFrame:
    pools = t("requests").groupBy("user_id", "kind").agg(F.array(F.min("latency_ms"), F.max("latency_ms")).alias("distances"))
    return O.distance_histogram(pools, 0.0, 50.0)


source("request_distances", "SELECT request_id, latency_ms / 50 AS top_distance FROM {requests} WHERE event_id % 4 <> 0")


@query("""
    SELECT status, rag_mode, count(*) AS n, round(avg(confidence), 4) AS confidence, round(avg(top_distance), 4) AS distance, round(avg(cost_usd * 100), 4) AS cents, round(sum(cost_usd * 100), 4) AS total_cents,
        round(avg(latency_ms), 4) AS latency, round(avg(tokens), 2) AS tokens
    FROM {requests} r LEFT JOIN {request_distances} d ON d.request_id = r.request_id WHERE confidence IS NOT NULL GROUP BY status, rag_mode""")
def outcome_summary(t: Tables) -> DataFrame:
    return O.outcome_summary(t("requests"), t("request_distances"))


@query("""SELECT round(sum(cost_usd), 6) AS total, round(sum(cost_usd) FILTER (status = 'not_applicable'), 6) AS not_applicable, round(sum(cost_usd) FILTER (status = 'not_applicable') / sum(cost_usd), 4) AS share,
    round(sum(input_cost), 6) AS input, round(sum(output_cost), 6) AS output FROM {requests}""")
def spend_by_outcome(t: Tables) -> DataFrame:
    return O.spend_by_outcome(t("requests"))


@query("SELECT path, round(q[1], 6) AS least, round(q[2], 6) AS q1, round(q[3], 6) AS median, round(q[4], 6) AS q3, round(q[5], 6) AS most FROM (SELECT path, quantile_cont(latency_ms, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM {requests} GROUP BY path)")
def five_number_summary(t: Tables) -> DataFrame:
    return O.five_number_summary(t("requests"), "path", "latency_ms")


@query("SELECT round(sum(cost_usd) / 30, 6) AS per_day, round(sum(cost_usd) / 30 * 7, 6) AS per_week, round(sum(cost_usd) / 30 * 30, 6) AS per_month FROM {requests}")
def cost_forecast(t: Tables) -> DataFrame:
    return O.cost_forecast(t("requests"), 30)


@query("""
    SELECT round(w, 3) AS worst_p95, CASE WHEN w <= 50 THEN 'ok' ELSE 'breach' END AS latency_status, round(e, 4) AS error_rate, CASE WHEN e <= 0.02 THEN 'ok' ELSE 'breach' END AS error_status,
        round(f, 4) AS found_nothing, CASE WHEN f <= 0.15 THEN 'ok' WHEN f <= 0.25 THEN 'watch' ELSE 'breach' END AS found_nothing_status
    FROM (SELECT count(*) FILTER (http_status >= 400) / count(*) AS e, count(*) FILTER (path = '/agent' AND status = 'not_applicable') / count(*) FILTER (path = '/agent') AS f FROM {requests}),
        (SELECT max(p) AS w FROM (SELECT quantile_cont(latency_ms, 0.95) AS p FROM {requests} GROUP BY path))""")
def slo_status(t: Tables) -> DataFrame:
    return O.slo_status(t("requests"), p95_limit=50.0)


@query("SELECT u.call_id, u.model, u.tier, p.provider AS price_provider, input_rate, output_rate, CAST(effective_from AS STRING) AS effective_from FROM {usage} u LEFT JOIN {newest_prices} p ON p.model = u.model AND p.tier = u.tier")
def latest_price(t: Tables) -> DataFrame:
    keys = t("usage").select("call_id", "model", "tier")
    return O.latest_price(keys, t("prices")).withColumnRenamed("provider", "price_provider").withColumn("effective_from", F.col("effective_from").cast("string"))


source("costed", """
    SELECT u.call_id, u.model, u.input_tokens, u.output_tokens, u.note, u.ts, CASE WHEN is_local THEN 0 ELSE input_tokens / 1e6 * input_rate END AS input_cost, CASE WHEN is_local THEN 0 ELSE output_tokens / 1e6 * output_rate END AS output_cost
    FROM {usage} u LEFT JOIN {newest_prices} p ON p.model = u.model AND p.tier = u.tier""")


@query("SELECT call_id, round(input_cost, 8) AS input_cost, round(output_cost, 8) AS output_cost, round(input_cost + output_cost, 8) AS cost_usd FROM {costed}")
def token_cost(t: Tables) -> DataFrame:
    return O.token_cost(t("usage").drop("provider"), t("prices")).select("call_id", *[F.round(c, 8).alias(c) for c in ("input_cost", "output_cost", "cost_usd")])


source("tools", "SELECT * FROM (VALUES ('search', 10.0e0, FALSE), ('fetch', 2.5e0, TRUE)) AS x(tool, per_thousand, content_free)")
source("tool_calls", """
    SELECT event_id AS call_id, 'm' || CAST(event_id % 3 AS STRING) AS model, 'standard' AS tier, CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'fetch' WHEN 2 THEN 'search' ELSE 'unknown' END AS tool,
        1 + event_id % 6 AS n_calls, CAST(round(value * 30) AS BIGINT) AS content_tokens FROM {events}""")


@query("""
    SELECT call_id, round(n_calls * per_thousand / 1000 + CASE WHEN content_free THEN 0 ELSE content_tokens / 1e6 * input_rate END, 8) AS cost_usd
    FROM {tool_calls} c LEFT JOIN {tools} t ON t.tool = c.tool LEFT JOIN {newest_prices} p ON p.model = c.model AND p.tier = c.tier""")
def tool_call_cost(t: Tables) -> DataFrame:
    return O.tool_call_cost(t("tool_calls"), t("tools"), t("prices")).select("call_id", F.round("cost_usd", 8).alias("cost_usd"))


@query("""
    SELECT model, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, round(sum(input_cost + output_cost), 6) AS cost,
        CASE WHEN bool_or(input_cost + output_cost IS NULL) THEN 'partial' ELSE 'full' END AS known, min(note) AS note FROM {costed} GROUP BY model""")
def usage_by_model(t: Tables) -> DataFrame:
    return O.usage_by_model(O.token_cost(t("usage").drop("provider"), t("prices")))


source("price_book", "SELECT CAST(p_partkey AS STRING) AS model, p_brand AS provider, p_retailprice AS rate FROM {part} WHERE p_partkey % 3 <> 0")
source("price_updates", "SELECT CAST(p_partkey AS STRING) AS model, p_brand AS provider, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_retailprice + 1 END AS rate FROM {part} UNION ALL SELECT CAST(p_partkey AS STRING) AS model, p_brand AS provider, p_retailprice AS rate FROM {part} WHERE p_partkey % 6 = 0")


@query("SELECT * FROM {price_book} UNION ALL (SELECT DISTINCT * FROM {price_updates} EXCEPT SELECT * FROM {price_book})")
def append_price_if_new(t: Tables) -> DataFrame:
    return O.append_price_if_new(t("price_book"), t("price_updates"))


source("entitlements", "SELECT * FROM (VALUES ('north', 1000, 'calls'), ('west', 50000, 'tokens')) AS x(provider, allowance, unit)")


@query("SELECT call_id, u.provider, 'first ' || CAST(allowance AS STRING) || ' ' || unit || ' free' AS entitlement FROM {usage} u LEFT JOIN {entitlements} e ON e.provider = u.provider")
def entitlement_note(t: Tables) -> DataFrame:
    return O.entitlement_note(t("usage").select("call_id", "provider"), t("entitlements")).select("call_id", "provider", "entitlement")


source("catalogue", "SELECT DISTINCT 'p' || CAST(user_id % 7 AS STRING) AS provider, 'u' || CAST(user_id AS STRING) AS model FROM {events}")
source("observations", "SELECT 'p' || CAST(user_id % 7 AS STRING) AS provider, 'u' || CAST(user_id AS STRING) AS model, CAST(ts AS DATE) AS seen_on FROM {events} WHERE event_type = 'purchase'")


@query("""
    SELECT c.provider, c.model, CAST(max(seen_on) AS STRING) AS last_seen, coalesce(date_diff('day', max(seen_on), DATE '2024-07-20') > 180, FALSE) AS retired
    FROM {catalogue} c LEFT JOIN {observations} o ON o.provider = c.provider AND o.model = c.model GROUP BY c.provider, c.model""")
def stale_models(t: Tables) -> DataFrame:
    return O.stale_models(t("catalogue"), t("observations"), "2024-07-20").withColumn("last_seen", F.col("last_seen").cast("string"))


source("model_candidates", """
    SELECT DISTINCT user_id % 40 AS purpose, 'm' || CAST(event_id % 5 AS STRING) AS model, 'standard' AS tier, event_id % 5 = 3 AS is_local, event_id % 5 IN (2, 4) AS is_free, event_id % 5 AS listed FROM {events}""")


@query("""
    SELECT purpose, model, cost_tier, round(cost, 6) AS cost, row_number() OVER (PARTITION BY purpose ORDER BY cost_tier, cost NULLS LAST, listed) AS place FROM (
        SELECT *, CASE WHEN is_local THEN 0 WHEN is_free AND cost IS NOT NULL THEN 1 WHEN is_free THEN 2 ELSE 3 END AS cost_tier FROM (
            SELECT c.*, input_rate + output_rate AS cost FROM {model_candidates} c LEFT JOIN {newest_prices} p ON p.model = c.model AND p.tier = c.tier))""")
def cost_frontier(t: Tables) -> DataFrame:
    return O.cost_frontier(t("model_candidates"), t("prices"))


source("titled", """
    SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE substr(text, 1, 30) END AS title, lang, source, CAST(floor(n_chars / 1000) AS BIGINT) AS size_class,
        CAST(TIMESTAMP '2024-01-01 00:00:00' AS DATE) AS first_day, doc_id % 365 AS day, CASE WHEN doc_id % 7 = 0 THEN 'undated' WHEN doc_id % 7 > 1 THEN CAST(1990 + n_chars % 33 AS STRING) || '-05' END AS published FROM {documents}""")


@query("""
    SELECT field, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS place FROM (
        SELECT field, value, count(*) AS n FROM (SELECT 'lang' AS field, lang AS value FROM {titled} UNION ALL SELECT 'source', source FROM {titled} UNION ALL SELECT 'size_class', CAST(size_class AS STRING) FROM {titled})
        WHERE value IS NOT NULL GROUP BY field, value)) WHERE place <= 8
    UNION ALL SELECT f, CASE f WHEN 'first_year' THEN low ELSE high END, n, 1 FROM (SELECT min(y) AS low, max(y) AS high, count(y) AS n FROM (SELECT nullif(regexp_extract(published, '^([0-9]{4})', 1), '') AS y FROM {titled})), (VALUES ('first_year'), ('last_year')) v(f)""")
def corpus_profile(t: Tables) -> DataFrame:
    return O.corpus_profile(t("titled"), ("lang", "source", "size_class"), published="published")


@query("SELECT doc_id, coalesce(title, CAST(doc_id AS STRING)) AS title FROM {titled} ORDER BY md5('5:' || doc_id) LIMIT 10")
def title_sample(t: Tables) -> DataFrame:
    return O.title_sample(t("titled"))


@query("SELECT count(*) AS n_documents, max(day) AS last_update, count(*) - count(title) AS untitled FROM {titled}")
def corpus_overview(t: Tables) -> DataFrame:
    return O.corpus_overview(t("titled").withColumnRenamed("day", "updated_at"))
