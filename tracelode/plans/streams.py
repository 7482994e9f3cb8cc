"""Streaming jobs run to the end of ``events`` (availableNow), held against the batch result on closed windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import working_folder
from ..streaming import jobs as J
from . import operations  # noqa: F401
from .registry import Tables, query, source

#: Windows that append mode has emitted: their end is not after the newest event less the lateness.
_CLOSED = "date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM {events}) - INTERVAL 1 HOUR"


def _events(t: Tables) -> DataFrame:
    return J.read_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("SELECT event_id, event_type, user_id FROM {events}")
def stream_events(t: Tables) -> DataFrame:
    twice = _events(t)
    doubled = twice.union(twice)
    return J.drain(J.stream_events(doubled, "40 days"), "events").select("event_id", "event_type", "user_id")


_PATH = "CASE event_type WHEN 'view' THEN '/ask' WHEN 'click' THEN '/agent' WHEN 'purchase' THEN '/ingest' WHEN 'signup' THEN '/stats' ELSE '/ask' END"
_STATUS = "CASE WHEN event_type = 'error' AND event_id % 3 < 2 THEN 500 ELSE 200 END"


def _windows(begin: str, width: str) -> str:
    """Statistics of closed windows; ``within`` says that the p95 of the summary has a rank that its accuracy allows."""
    return f"""
        SELECT CAST(w AS VARCHAR) AS window_start, {_PATH} AS path, count(*) AS n, count(*) FILTER ({_STATUS} >= 400) AS errors, round(count(*) FILTER ({_STATUS} >= 400) / count(*), 4) AS error_rate, TRUE AS within
        FROM (SELECT *, {begin} AS w FROM {{events}}) WHERE w + INTERVAL {width} <= (SELECT max(ts) FROM {{events}}) - INTERVAL 1 HOUR GROUP BY ALL"""


def _requests(events: DataFrame) -> DataFrame:
    return events.select("ts", F.expr(_PATH).alias("path"), F.expr(_STATUS).alias("http_status"), F.col("value").alias("latency_ms"))


def _checked(t: Tables, found: DataFrame, width: str, slide: str | None) -> DataFrame:
    """The stream's rows, with the rank of their p95 held against the values of its window."""
    values = _requests(t("events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.window("ts", width, slide).start.alias("window_start"), "path", "latency_ms")
    met = values.join(found.select("window_start", "path", "p95"), ["window_start", "path"])
    ranks = met.groupBy("window_start", "path").agg(F.sum(F.when(F.col("latency_ms") < F.col("p95"), 1).otherwise(0)).alias("below"), F.sum(F.when(F.col("latency_ms") <= F.col("p95"), 1).otherwise(0)).alias("upto"), F.count("latency_ms").alias("m"))
    wanted, slack = F.ceil(0.95 * F.col("m")), F.col("m") / J.ACCURACY + 1
    within = (F.col("below") + 1 <= wanted + slack) & (F.col("upto") >= wanted - slack)
    joined = found.join(ranks.select("window_start", "path", within.alias("within")), ["window_start", "path"], "left")
    return joined.select(F.col("window_start").cast("string").alias("window_start"), "path", "n", "errors", "error_rate", "within")


@query(_windows("date_trunc('day', ts)", "1 DAY"))
def stream_stats(t: Tables) -> DataFrame:
    return _checked(t, J.drain(J.stream_stats(_requests(_events(t))), "stats"), "1 day", None)


@query(_windows("unnest([date_trunc('day', ts) + INTERVAL 6 HOUR * (CAST(floor(date_part('hour', ts) / 6) AS BIGINT) - k) for k in [0, 1, 2, 3]])", "1 DAY"))
def stream_sliding_stats(t: Tables) -> DataFrame:
    found = J.drain(J.stream_stats(_requests(_events(t)), "1 day", "6 hours"), "sliding")
    return _checked(t, found, "1 day", "6 hours")


@query("""
    WITH e AS (SELECT event_id AS request_id, ts AS started, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 10 MINUTE END AS completed FROM {events})
    SELECT request_id, CAST(started AS VARCHAR) AS started, CAST(completed AS VARCHAR) AS completed FROM e WHERE started < (SELECT max(ts) FROM {events}) - INTERVAL 3 DAY""")
def stream_open_requests(t: Tables) -> DataFrame:
    starts = _events(t).select(F.col("event_id").alias("request_id"), "ts")
    done = _events(t).where("event_id % 3 = 0").select(F.col("event_id").alias("request_id"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"))
    found = J.drain(J.stream_open_requests(starts, done), "open")
    newest = t("events").agg(F.max(F.col("ts").cast("timestamp")).alias("newest"))
    closed = found.join(F.broadcast(newest)).where("started < newest - INTERVAL 3 DAYS")  # one row
    return closed.select("request_id", F.col("started").cast("string").alias("started"), F.col("completed").cast("string").alias("completed"))


@query("""
    SELECT sum(n) AS n_lines, sum(CASE WHEN event_id % 50 = 0 THEN n ELSE 0 END) AS n_malformed, sum(CASE WHEN event_id % 50 <> 0 THEN n - 1 ELSE 0 END) AS n_repeated, 0 AS n_below, count(*) FILTER (event_id % 50 <> 0) AS n_new
    FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS n FROM {events})""")
def stream_observation_drain(t: Tables) -> DataFrame:
    line = F.when(F.col("event_id") % 50 == 0, "not json").otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("string").alias("observed_at"), F.col("event_type").alias("decision"))))
    copies = F.array_repeat(line, F.when(F.col("event_id") % 7 == 0, 2).otherwise(1))
    root = f"{working_folder(t.spark)}/drain-{uuid.uuid4().hex}"
    J.stream_observation_drain(_events(t).select(F.explode(copies).alias("value")), root)
    report = t.spark.read.schema("n_lines long, n_malformed long, n_repeated long, n_below long, n_known long, n_new long, batch long").parquet(f"{root}/report")
    return report.agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_malformed", "n_repeated", "n_below", "n_new")])


@query("SELECT 'user' || CAST(user_id AS STRING) || ':' || event_type AS key, max(event_id) AS seq, arg_max(props, event_id) AS value FROM {events} GROUP BY ALL")
def stream_memory(t: Tables) -> DataFrame:
    log = _events(t).select(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"))
    changes = J.drain_updates(J.stream_memory(log), "memory")
    return changes.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


@query(f"""
    SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, u.model, round(sum(input_tokens / 1e6 * input_rate + output_tokens / 1e6 * output_rate), 8) AS cost, count(*) FILTER (input_rate IS NULL) AS n_unpriced, count(*) AS n
    FROM {{usage}} u LEFT JOIN {{newest_prices}} p ON p.model = u.model AND p.tier = u.tier WHERE {_CLOSED} GROUP BY ALL""")
def stream_cost(t: Tables) -> DataFrame:
    tokens = lambda k: F.round(F.col("value") * k).cast("long")
    usage = _events(t).select("ts", F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("model"), F.when(F.col("event_id") % 7 == 0, "batch").otherwise("standard").alias("tier"), tokens(100).alias("input_tokens"), tokens(40).alias("output_tokens"))
    prices = t("newest_prices").select("model", "tier", "input_rate", "output_rate")
    found = J.drain(J.stream_cost(usage, prices), "cost")
    return found.withColumn("window_start", F.col("window_start").cast("string"))
