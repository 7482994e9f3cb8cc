"""Request logs, statistics, costs and prices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import removed, written
from .selection import percentiles

ASK, INGEST, AGENT = ("/ask",), ("/ingest",), "/agent"


def _ones(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def query_events(events: DataFrame, kind: str, limit: int = 500) -> DataFrame:
    """The newest ``limit`` events of one kind (a top-k report)."""
    return events.where(F.col("kind") == kind).orderBy(F.col("created_at").desc(), F.col("event_id")).limit(limit)


def request_outcomes(starts: DataFrame, completions: DataFrame) -> DataFrame:
    """Each start with its completion; started ones without completion stay visible."""
    done = completions.select("request_id", "http_status", "latency_ms")
    state = F.when(F.col("http_status").isNull(), "open").when(F.col("http_status") >= 400, "failed").otherwise("done")
    return starts.select("request_id", "path").join(done, "request_id", "left").select("request_id", "path", "latency_ms", state.alias("state"))


def stats_summary(requests: DataFrame, since: str, allowed: Sequence[str], least: int = 10) -> DataFrame:
    """Per allow-listed path since a time: n, linear p50 and p95, errors, error, supported and found-nothing rates, and cost.

    The filter on time comes first, so busy windows count in full.  Percentiles, rates and costs of fewer than ``least`` rows
    are null; only agent runs have a found-nothing rate.
    """
    rows = requests.where((F.col("created_at") >= F.lit(since).cast("timestamp_ntz")) & F.col("path").isin(*allowed))
    found = rows.groupBy("path").agg(
        F.count("*").alias("n"), _ones(F.col("error") | (F.col("http_status") >= 400)).alias("errors"), _ones(F.col("status").isNotNull()).alias("asked"), _ones(F.col("status") == "supported").alias("good"),
        _ones(F.col("status") == "not_applicable").alias("nothing"), F.count("cost_usd").alias("costs"), F.sum("cost_usd").alias("cost"),
    )
    q = percentiles(rows, ["path"], "latency_ms", (0.5, 0.95)).select(F.col("path").alias("_path"), F.col("n").alias("timed"), "q")
    enough = lambda of, value, digits: F.when(F.col(of) >= least, F.round(value, digits))
    rate = lambda part, of: enough(of, F.col(part) / F.nullif(F.col(of), F.lit(0)), 4)
    return found.join(q, F.col("path").eqNullSafe(F.col("_path")), "left").select(
        "path", "n", enough("timed", F.element_at("q", 1), 1).alias("p50"), enough("timed", F.element_at("q", 2), 1).alias("p95"), "errors",
        rate("errors", "n").alias("error_rate"), rate("good", "asked").alias("hit_rate"), F.when(F.col("path") == AGENT, rate("nothing", "n")).alias("found_nothing_rate"),
        enough("costs", F.col("cost"), 6).alias("cost_total"), enough("costs", F.col("cost") / F.col("costs"), 6).alias("cost_per_ask"),
    )


def published_rates(rates: DataFrame, cells: DataFrame, least: int = 10) -> DataFrame:
    """(name, rate) of (name, part, whole, cell) rows: null on fewer than ``least`` rows, and where the cell that the rate would disclose is hidden.

    ``cells`` is a result of ``suppress_small_cells``; a cell that it does not have hides nothing.
    """
    known = cells.select(F.col("name").alias("cell"), "hidden")
    shown = (F.col("whole") >= least) & ~F.coalesce("hidden", F.lit(False))
    return rates.join(known, "cell", "left").select("name", F.when(shown, F.round(F.col("part") / F.nullif(F.col("whole"), F.lit(0)), 4)).alias("rate"))


def primary_suppression(counts: DataFrame, least: int = 10) -> DataFrame:
    """Counts of 1 to ``least`` - 1 are hidden; a zero discloses nothing."""
    return counts.withColumn("hidden", (F.col("n") > 0) & (F.col("n") < least))


def suppress_small_cells(counts: DataFrame, groups: DataFrame, least: int = 10) -> DataFrame:
    """(name, n, hidden) after primary and complementary suppression, run to a fixed point.

    ``groups`` has (total, cell) rows.  Where a total is published, its hidden cells must number 0, or at least 2
    with ``least`` together, else its smallest visible cell (or the total) is hidden too.  Where a total is hidden,
    at least one of its cells must be.  Every step hides something or ends; both tables are aggregates, of a row for each
    published number.  Each step is written to the working folder; only whether it found anything comes to the driver.
    """
    state = written(primary_suppression(counts, least), "suppression")
    while True:
        cells = groups.join(state.select(F.col("name").alias("cell"), "n", "hidden"), "cell").where("n > 0")
        facts = cells.groupBy("total").agg(
            _ones(F.col("hidden")).alias("n_hidden"), F.sum(F.when(F.col("hidden"), F.col("n")).otherwise(0)).alias("hidden_sum"),
            F.min(F.when(~F.col("hidden"), F.struct("n", "cell"))).alias("smallest"),
        ).join(state.select(F.col("name").alias("total"), F.col("hidden").alias("total_hidden")), "total")
        broken = F.when(F.col("total_hidden"), F.col("n_hidden") == 0).otherwise((F.col("n_hidden") == 1) | ((F.col("n_hidden") > 0) & (F.col("hidden_sum") < least)))
        more = facts.where(broken).select(F.coalesce("smallest.cell", F.when(~F.col("total_hidden"), F.col("total"))).alias("name")).where("name IS NOT NULL").distinct()
        more = written(more, "suppression-more")
        if more.isEmpty():
            removed(more)
            return state
        last, state = state, written(state.join(more.withColumn("more", F.lit(True)), "name", "left").select("name", "n", (F.col("hidden") | F.col("more").isNotNull()).alias("hidden")), "suppression")
        removed(last, more)


def request_volume(requests: DataFrame, unit: str = "day") -> DataFrame:
    return requests.groupBy(F.date_trunc(unit, F.col("created_at")).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


def error_categories(requests: DataFrame) -> DataFrame:
    """First category that fits (timeout, provider, internal, logical, ok) with counts and shares."""
    kind = (
        F.when(F.col("latency_ms") >= 60, "timeout").when(F.col("http_status").isin(502, 503, 504), "provider")
        .when(F.col("http_status") >= 500, "internal").when(F.col("http_status") >= 400, "logical").otherwise("ok")
    )
    found = requests.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n").alias("total"))
    return found.join(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # one row


def outcome_mix(requests: DataFrame) -> DataFrame:
    """Counts by path and status, and the supported share of the path."""
    found = requests.where("status IS NOT NULL").groupBy("path", "status").agg(F.count("*").alias("n"))
    whole = found.groupBy("path").agg(F.round(F.sum(F.when(F.col("status") == "supported", F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("supported_share"))
    return found.join(whole, "path")


def distance_histogram(pools: DataFrame, low: float, high: float, bins: int = 20, gate: float = 1.2) -> DataFrame:
    """Histogram of the first distance of each pool (``distances`` is nearest first), and the side of the gate."""
    top1 = pools.select(F.try_element_at("distances", F.lit(1)).alias("d")).where("d IS NOT NULL")
    return top1.groupBy(F.expr(f"width_bucket(d, double({low}), double({high}), {bins})").cast("long").alias("bin")).agg(F.count("*").alias("n"), _ones(F.col("d") <= gate).alias("n_passing"))


def outcome_summary(requests: DataFrame, distances: DataFrame) -> DataFrame:
    """By status and mode: means of confidence, distance, cost in cents, latency and tokens; rows without confidence go."""
    rows = requests.where("confidence IS NOT NULL").join(distances, "request_id", "left")
    mean = lambda c, name, k=4: F.round(F.avg(c), k).alias(name)
    return rows.groupBy("status", "rag_mode").agg(
        F.count("*").alias("n"), mean("confidence", "confidence"), mean("top_distance", "distance"), mean(F.col("cost_usd") * 100, "cents"),
        F.round(F.sum(F.col("cost_usd") * 100), 4).alias("total_cents"), mean("latency_ms", "latency"), mean("tokens", "tokens", 2),
    )


def spend_by_outcome(requests: DataFrame) -> DataFrame:
    """One row: total spend, the part and share on not_applicable, and input and output cost."""
    waste = F.sum(F.when(F.col("status") == "not_applicable", F.col("cost_usd")).otherwise(0.0))
    return requests.agg(F.round(F.sum("cost_usd"), 6).alias("total"), F.round(waste, 6).alias("not_applicable"), F.round(waste / F.sum("cost_usd"), 4).alias("share"), F.round(F.sum("input_cost"), 6).alias("input"), F.round(F.sum("output_cost"), 6).alias("output"))


def five_number_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Least value, quartiles and greatest value of each group that has values."""
    five = percentiles(rows, [by], value, (0.0, 0.25, 0.5, 0.75, 1.0))
    return five.select(by, *[F.round(F.element_at("q", i + 1), 6).alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "most"))])


def cost_forecast(requests: DataFrame, days: int) -> DataFrame:
    """Spend of a window of ``days`` carried on linearly to a day, a week and a month of 30 days."""
    day = F.sum("cost_usd") / days
    return requests.agg(F.round(day, 6).alias("per_day"), F.round(day * 7, 6).alias("per_week"), F.round(day * 30, 6).alias("per_month"))


def slo_status(requests: DataFrame, p95_limit: float = 3000.0, error_limit: float = 0.02, bands: tuple[float, float] = (0.15, 0.25)) -> DataFrame:
    """One row: worst p95 over paths, error rate and found-nothing share, each against its limit."""
    worst = percentiles(requests, ["path"], "latency_ms", (0.95,)).agg(F.max(F.element_at("q", 1)).alias("worst_p95"))
    rates = requests.agg((_ones(F.col("http_status") >= 400) / F.count("*")).alias("e"), (_ones((F.col("path") == AGENT) & (F.col("status") == "not_applicable")) / F.nullif(_ones(F.col("path") == AGENT), F.lit(0))).alias("f"))
    return rates.join(F.broadcast(worst)).select(
        F.round("worst_p95", 3).alias("worst_p95"), F.when(F.col("worst_p95") <= p95_limit, "ok").otherwise("breach").alias("latency_status"),
        F.round("e", 4).alias("error_rate"), F.when(F.col("e") <= error_limit, "ok").otherwise("breach").alias("error_status"),
        F.round("f", 4).alias("found_nothing"), F.when(F.col("f") <= bands[0], "ok").when(F.col("f") <= bands[1], "watch").otherwise("breach").alias("found_nothing_status"),
    )


def latest_price(keys: DataFrame, prices: DataFrame, provider: str | None = None) -> DataFrame:
    """Newest price row by ``effective_from`` for each (model, tier); none gives nulls."""
    rows = prices if provider is None else prices.where(F.col("provider") == provider)
    newest = rows.groupBy("model", "tier").agg(F.max_by(F.struct("provider", "input_rate", "output_rate"), F.struct("effective_from", "provider")).alias("price_row"), F.max("effective_from").alias("effective_from"))
    return keys.join(newest, ["model", "tier"], "left").select(*keys.columns, "price_row.*", "effective_from")


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Input, output and total cost; an unknown price stays null, a local model costs 0."""
    priced = latest_price(usage, prices)
    part = lambda tokens, rate: F.when(F.col("is_local"), 0.0).otherwise(F.col(tokens) / 1e6 * F.col(rate))
    costed = priced.withColumns({"input_cost": part("input_tokens", "input_rate"), "output_cost": part("output_tokens", "output_rate")})
    return costed.withColumn("cost_usd", F.col("input_cost") + F.col("output_cost"))


def tool_call_cost(calls: DataFrame, tools: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls times the price of a thousand, plus content tokens at the model's input rate unless they are free."""
    priced = latest_price(calls, prices).join(tools, "tool", "left")
    content = F.when(F.col("content_free"), 0.0).otherwise(F.col("content_tokens") / 1e6 * F.col("input_rate"))
    return priced.withColumn("cost_usd", F.col("n_calls") * F.col("per_thousand") / 1000 + content)


def usage_by_model(costed: DataFrame) -> DataFrame:
    """Per model: calls, tokens, known cost, ``partial`` where any cost is unknown."""
    return costed.groupBy("model").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost"), F.when(F.max(F.col("cost_usd").isNull()), "partial").otherwise("full").alias("known"),
        F.min("note").alias("note"),
    )


def append_price_if_new(book: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append rows that are not in the book in every column; repeats within the increment count once."""
    return book.unionByName(incoming.select(*book.columns).distinct().exceptAll(book.distinct()))


def entitlement_note(usage: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Free-allowance text by provider; null where there is none."""
    return usage.join(entitlements, "provider", "left").withColumn("entitlement", F.when(F.col("allowance").isNotNull(), F.concat_ws(" ", F.lit("first"), F.col("allowance").cast("string"), "unit", F.lit("free"))))


def stale_models(catalogue: DataFrame, observations: DataFrame, today: str, days: int = 180) -> DataFrame:
    """Last observation of each model; retired if it is older than ``days``; a model never seen is not retired."""
    last = observations.groupBy("provider", "model").agg(F.max("seen_on").alias("last_seen"))
    age = F.datediff(F.lit(today).cast("date"), F.col("last_seen").cast("date"))
    return catalogue.join(last, ["provider", "model"], "left").select("provider", "model", "last_seen", F.coalesce(age > days, F.lit(False)).alias("retired"))


def cost_frontier(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """Candidates of each purpose in the order local, free and priced, free without price, paid; then known cost, then listed order."""
    priced = latest_price(candidates, prices)
    cost = F.col("input_rate") + F.col("output_rate")
    tier = F.when(F.col("is_local"), 0).when(F.col("is_free") & cost.isNotNull(), 1).when(F.col("is_free"), 2).otherwise(3)
    w = Window.partitionBy("purpose").orderBy("cost_tier", F.col("cost").asc_nulls_last(), "listed")
    return priced.withColumns({"cost": cost, "cost_tier": tier}).withColumn("place", F.row_number().over(w).cast("long")).select("purpose", "model", "cost_tier", F.round("cost", 6).alias("cost"), "place")


def corpus_profile(docs: DataFrame, columns: Iterable[str], k: int = 8, published: str | None = None) -> DataFrame:
    """Top-k values of each column with their counts: (field, value, n, place).

    With a column ``published`` of dates as text, two more rows have the first and last year (four digits at its beginning)
    and how many documents have one; without any, their value is null.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = docs.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    found = counts.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)
    if published is None:
        return found
    year = F.nullif(F.regexp_extract(published, "^([0-9]{4})", 1), F.lit(""))
    span = docs.select(year.alias("y")).agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("y").alias("n"))
    years = span.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("first_year", "low"), ("last_year", "high"))))).alias("y"))
    return found.union(years.select("y.field", "y.value", "n", F.lit(1).cast("long")))


def title_sample(docs: DataFrame, k: int = 10, seed: str = "5") -> DataFrame:
    """A stable sample of titles by hash order; the id stands in for a missing title (a sampling operator)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), h.alias("h")).orderBy("h").limit(k).select("doc_id", "title")


def corpus_overview(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_documents"), F.max("updated_at").alias("last_update"), _ones(F.col("title").isNull()).alias("untitled"))
