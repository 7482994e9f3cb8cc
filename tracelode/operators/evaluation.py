"""Scores of retrieval, answers, checks and predictions against golden sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_two_sided
from .ranking import THRESHOLD, top
from .selection import percentiles, values_at


def _ones(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def golden_preflight(golden: DataFrame, documents: DataFrame) -> DataFrame:
    """Golden rows whose expected document is gone."""
    wanted = golden.where("expected_document_id IS NOT NULL")
    return wanted.join(documents.select(F.col("document_id").alias("expected_document_id")), "expected_document_id", "left_anti").select("query_id", "expected_document_id")


def golden_score(golden: DataFrame, candidates: DataFrame, context: DataFrame, answers: DataFrame, cited: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per golden question: retrieval, status, citation and overall verdicts.

    Retrieval is right if the expected document is in the context, or, where none is expected, if the gate
    stands on the side that the expected status names.  The expected document must be among the cited ones;
    where none is expected nothing may be cited.
    """
    gate = candidates.groupBy("query_id").agg((F.min("distance") <= threshold).alias("passes"))
    has = context.select("query_id", "document_id").distinct().withColumn("in_context", F.lit(True))
    cites = cited.select("query_id", "document_id").distinct()
    named = cites.withColumn("is_cited", F.lit(True))
    n_cited = cites.groupBy("query_id").agg(F.count("*").alias("n_cited"))
    expected = F.col("expected_document_id")
    g = golden.withColumn("document_id", expected)
    joined = g.join(has, ["query_id", "document_id"], "left").join(named, ["query_id", "document_id"], "left").join(gate, "query_id", "left").join(n_cited, "query_id", "left").join(answers, "query_id", "left")
    passes = F.coalesce("passes", F.lit(False))
    retrieval = F.when(expected.isNotNull(), F.coalesce("in_context", F.lit(False))).otherwise(passes == (F.col("expected_status") != "not_applicable"))
    citation = F.when(expected.isNotNull(), F.coalesce("is_cited", F.lit(False))).otherwise(F.coalesce("n_cited", F.lit(0)) == 0)
    status = F.col("status").eqNullSafe(F.col("expected_status"))
    return joined.select("query_id", retrieval.alias("retrieval_ok"), status.alias("status_ok"), citation.alias("citation_ok"), (status & citation).alias("generation_ok"))


def golden_totals(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), *[_ones(F.col(c)).alias(f"n_{c}") for c in ("retrieval_ok", "status_ok", "citation_ok", "generation_ok")])


def retrieval_metrics(cases: DataFrame, ranked: DataFrame, context: DataFrame, depth: int = 8) -> DataFrame:
    """Per case and variant: expected document in the context; reciprocal ranks of document and chunk within ``depth``."""
    r = cases.join(ranked.where(F.col("rank") <= depth), "query_id", "left").groupBy("query_id", "variant").agg(
        F.min(F.when(F.col("document_id") == F.col("expected_document_id"), F.col("rank"))).alias("dr"),
        F.min(F.when(F.col("chunk_id") == F.col("expected_chunk_id"), F.col("rank"))).alias("cr"),
    )
    h = cases.join(context, "query_id").groupBy("query_id", "variant").agg(F.max(F.when(F.col("document_id") == F.col("expected_document_id"), 1.0).otherwise(0.0)).alias("doc_hit"))
    inverse = lambda c: F.round(F.coalesce(1.0 / F.col(c), F.lit(0.0)), 6)
    return r.join(h, ["query_id", "variant"], "left").select("query_id", "variant", F.coalesce("doc_hit", F.lit(0.0)).alias("doc_hit"), inverse("dr").alias("doc_rr"), inverse("cr").alias("chunk_rr"))


def eval_report(records: DataFrame, baseline: str) -> DataFrame:
    """Means by variant, overall (stratum null) and per stratum, with wins and losses against the baseline."""
    base = records.where(F.col("variant") == baseline).select("query_id", F.col("doc_rr").alias("base_rr"))
    joined = records.join(base, "query_id", "left").withColumn("win", F.col("doc_rr") > F.col("base_rr")).withColumn("loss", F.col("doc_rr") < F.col("base_rr"))
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("doc_hit", "doc_rr", "chunk_rr", "latency")], _ones(F.col("win")).alias("wins"), _ones(F.col("loss")).alias("losses")]
    overall = joined.groupBy("variant").agg(*aggs).withColumn("stratum", F.lit(None).cast("string"))
    return joined.groupBy("variant", "stratum").agg(*aggs).unionByName(overall)


def hit_regression_gate(cases: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: hits of the expected document in two contexts, cases won and lost, and whether hits fell."""

    def hits(context: DataFrame, name: str) -> DataFrame:
        return cases.join(context, "query_id", "left").groupBy("query_id").agg(F.max(F.when(F.col("document_id") == F.col("expected_document_id"), 1).otherwise(0)).alias(name))

    both = hits(before, "b").join(hits(after, "a"), "query_id")
    return both.agg(F.sum("b").alias("hits_before"), F.sum("a").alias("hits_after"), _ones(F.col("a") > F.col("b")).alias("won"), _ones(F.col("a") < F.col("b")).alias("lost")).withColumn("regression", F.col("hits_after") < F.col("hits_before"))


#: Sign flips that one digest gives, and differences that are flipped at once.
FLIPS, FLIP_ROWS = 128, 512


def sign_flip_sums(differences: DataFrame, permutations: int, seed: str) -> DataFrame:
    """(permutation, s): the sum of all differences under each of ``permutations`` flips of their signs, from 1.

    The signs of 128 permutations are the bits of md5(seed:block:id), the first bit for the first.  A task multiplies blocks
    of differences with the unpacked bits, and sends one sum a permutation, whatever number of rows it has.
    """
    blocks = -(-permutations // FLIPS)

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks * FLIPS)
        for batch in batches:
            ids, difference = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(ids), FLIP_ROWS):
                packed = b"".join(hashlib.md5(f"{seed}:{k}:{q}".encode()).digest() for q in ids[i : i + FLIP_ROWS] for k in range(blocks))
                part = difference[i : i + FLIP_ROWS]
                minus = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(len(part), -1)
                total += part.sum() - 2 * (part @ minus)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, permutations + 1)), pa.array(total[:permutations])], ["permutation", "s"])

    rows = differences.where("difference IS NOT NULL").select(F.coalesce(F.col("query_id").cast("string"), F.lit("")).alias("query_id"), F.col("difference").cast("double"))
    return rows.mapInArrow(flip, "permutation long, s double").groupBy("permutation").agg(F.sum("s").alias("s"))


def paired_tests(differences: DataFrame, permutations: int = 10_000, seed: str = "7") -> DataFrame:
    """One row: mean difference, sample deviation, t with its two-sided normal p value, and the sign-flip p value (hits + 1) / (permutations + 1).

    Signs come from a hash of (seed, block, id), so both engines flip alike.  All-zero differences give p = 1; without a
    deviation there is no t, and ``p_t`` is null.  Null differences are left out.
    """
    sums = sign_flip_sums(differences, permutations, seed)
    facts = differences.agg(F.count("difference").alias("n"), F.avg("difference").alias("mean"), F.stddev_samp("difference").alias("sd"), F.sum("difference").alias("total"), F.max(F.abs("difference")).alias("largest"))
    hits = sums.join(F.broadcast(facts)).agg(_ones(F.abs("s") >= F.abs("total") - 1e-9).alias("hits"))  # facts is one row
    p = F.when(F.col("largest") == 0, 1.0).otherwise((F.col("hits") + 1) / (permutations + 1))
    t = F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return facts.join(F.broadcast(hits)).select("n", F.round("mean", 6).alias("mean_difference"), F.round("sd", 6).alias("sd"), F.round(t, 5).alias("t"), F.round(normal_two_sided(t), 5).alias("p_t"), F.round(p, 6).alias("p"))


def gate_threshold_search(signals: DataFrame, share: float = 0.9, steps: int = 10) -> DataFrame:
    """Threshold on ``gap`` with the fewest calls (gap <= threshold) that keep ``share`` of the gain on even rows.

    The grid is ``steps`` + 1 quantiles of the even rows; the odd rows report what the choice does elsewhere.
    """
    even = signals.where("fold = 0")
    grid = percentiles(even, [], "gap", [i / steps for i in range(steps + 1)]).select(F.explode("q").alias("threshold")).distinct()
    tried = even.join(F.broadcast(grid)).groupBy("threshold").agg(_ones(F.col("gap") <= F.col("threshold")).alias("calls"), F.sum(F.when(F.col("gap") <= F.col("threshold"), F.col("gain")).otherwise(0.0)).alias("kept"), F.sum("gain").alias("all_gain"))
    good = tried.where(F.col("kept") >= share * F.col("all_gain") - 1e-12)
    best = good.agg(F.min(F.struct("calls", "threshold")).alias("b")).select(F.col("b.threshold").alias("threshold"), F.col("b.calls").alias("calls"))
    used = (F.col("fold") == 1) & (F.col("gap") <= F.col("threshold"))
    return signals.join(F.broadcast(best)).groupBy("threshold", "calls").agg(_ones(used).alias("odd_calls"), F.round(F.sum(F.when(used, F.col("gain")).otherwise(0.0)), 6).alias("odd_gain"), F.round(F.sum(F.when(F.col("fold") == 1, F.col("gain")).otherwise(0.0)), 6).alias("odd_all_gain")).withColumn("threshold", F.round("threshold", 6))


def signal_quartile_gain(signals: DataFrame) -> DataFrame:
    """Mean gain in quartile bins of ``gap``; bins are closed on both sides, so a value on an edge counts twice."""
    correlation = signals.agg(F.corr("gap", "gain").alias("correlation"))
    edges = percentiles(signals, [], "gap", (0.0, 0.25, 0.5, 0.75, 1.0)).select(F.col("q").alias("e")).join(F.broadcast(correlation))  # one row each
    bins = edges.select("correlation", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.element_at("e", i).alias("low"), F.element_at("e", i + 1).alias("high")))).alias("bin", "x"))
    joined = signals.join(F.broadcast(bins), (F.col("gap") >= F.col("x.low")) & (F.col("gap") <= F.col("x.high")))
    return joined.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.first("correlation"), 6).alias("correlation"))


def stratified_candidates(chunks: DataFrame, quota: int = 5, per_document: int = 1, least: int = 400, seed: str = "13") -> DataFrame:
    """Seeded choice of source chunks: not a document's first, long enough, no reference list; a bounded number
    of each document; ``quota`` of each stratum (by hash order), a chunk in one stratum only."""
    fit = chunks.where((F.col("chunk_index") > 0) & (F.length("text") >= least) & (F.regexp_count("text", F.lit("\\[[0-9]{1,3}\\]")) < 3))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string")))
    one = fit.withColumn("h", order).withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("h"))).where(F.col("k") <= per_document)
    placed = one.withColumn("stratum", F.col("document_id") % 3)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("h")).cast("long")).where(F.col("place") <= quota).select("stratum", "place", "chunk_id", "document_id")


def question_filters(questions: DataFrame, leak_words: Sequence[str], limits: dict[int, tuple[int, int]]) -> DataFrame:
    """First reason to reject a generated question (leak words, word limits of its stratum, overlap with its chunk), or ``ok``; counts by reason."""
    words = F.filter(F.split(F.lower("question"), "[^\\p{L}0-9]+"), lambda w: w != "")
    body = F.filter(F.split(F.lower("text"), "[^\\p{L}0-9]+"), lambda w: w != "")
    q = questions.withColumns({"w": F.array_distinct(words), "n": F.size(words), "b": F.array_distinct(body)})
    low, high = F.lit(1), F.lit(10_000)
    for stratum, (a, b) in limits.items():
        low, high = F.when(F.col("stratum") == stratum, a).otherwise(low), F.when(F.col("stratum") == stratum, b).otherwise(high)
    overlap = F.size(F.array_intersect("w", "b")) / F.greatest(F.size("w"), F.lit(1))
    reason = F.when(F.arrays_overlap("w", F.array(*map(F.lit, leak_words))), "leak").when((F.col("n") < low) | (F.col("n") > high), "length").when(overlap > 0.5, "overlap").otherwise("ok")
    return q.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def check_summary(results: DataFrame) -> DataFrame:
    passed = _ones(F.col("pass"))
    return results.groupBy("run_label", "check_name", "check_type").agg(F.count("*").alias("total"), passed.alias("passed"), F.round(100.0 * passed / F.count("*"), 2).alias("percent"))


def failure_summary(failures: DataFrame) -> DataFrame:
    failed = _ones(~F.col("pass"))
    return failures.groupBy("category").agg(F.count("*").alias("total"), failed.alias("failures"), F.round(failed / F.count("*"), 4).alias("failure_rate"))


def failure_priority(summary: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Failing count times severity weight, ranked (equal scores share a rank).  One row per category, so one window partition is small."""
    weight = F.lit(None).cast("int")
    for name, w in weights.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    scored = summary.withColumn("priority_score", F.col("failures") * weight)
    return scored.withColumn("priority_rank", F.rank().over(Window.orderBy(F.col("priority_score").desc())).cast("long"))


def ship_decision(results: DataFrame, ship: float = 0.95, mitigate: float = 0.85) -> DataFrame:
    """Per run: share of traces that pass every check (4 places) and what follows."""
    traces = results.groupBy("run_label", "trace_id").agg(F.min("pass").alias("all_pass"))
    rate = F.round(_ones(F.col("all_pass")) / F.count("*"), 4)
    decided = traces.groupBy("run_label").agg(F.count("*").alias("total"), _ones(F.col("all_pass")).alias("passed"), rate.alias("rate"))
    return decided.withColumn("decision", F.when(F.col("rate") >= ship, "SHIP").when(F.col("rate") >= mitigate, "MITIGATE").otherwise("BLOCK"))


def run_delta(results: DataFrame, before: str, after: str) -> DataFrame:
    """Percent of each check in two runs and the difference, over checks of either run."""
    s = check_summary(results).groupBy("run_label", "check_name").agg(F.round(100.0 * F.sum("passed") / F.sum("total"), 2).alias("p"))
    a, b = (s.where(F.col("run_label") == r).select("check_name", F.col("p").alias(n)) for r, n in ((before, "before"), (after, "after")))
    return a.join(b, "check_name", "full_outer").select("check_name", "before", "after", F.round(F.col("after") - F.col("before"), 2).alias("delta"))


def trace_flips(results: DataFrame, before: str, after: str) -> DataFrame:
    """Traces of both runs: fixed, regressed, still failing or passing."""
    t = results.groupBy("run_label", "trace_id").agg(F.min("pass").alias("ok"))
    a, b = (t.where(F.col("run_label") == r).select("trace_id", F.col("ok").alias(n)) for r, n in ((before, "was"), (after, "now")))
    kind = F.when(~F.col("was") & F.col("now"), "fixed").when(F.col("was") & ~F.col("now"), "regressed").when(~F.col("was"), "still_failing").otherwise("passing")
    return a.join(b, "trace_id").select("trace_id", kind.alias("flip"))


def field_accuracy(predictions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field, overall (slice null) and per slice: hits among rows where a value is expected; recall of P1 as a field of its own."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"expected_{f}").cast("string").alias("expected"), F.col(f).cast("string").alias("got")) for f in fields],
                    F.struct(F.lit("p1_recall").alias("field"), F.when(F.col("expected_priority") == "P1", "P1").alias("expected"), F.col("priority").alias("got")))
    long = predictions.select("slice", F.explode(pairs).alias("p")).select("slice", "p.*").where("expected IS NOT NULL")
    hits = _ones(F.col("expected").eqNullSafe(F.col("got")))
    return long.rollup("field", "slice").agg(hits.alias("hits"), F.count("*").alias("total"), F.round(hits / F.count("*"), 4).alias("accuracy")).where("field IS NOT NULL")


def accuracy_misses(predictions: DataFrame, fields: Sequence[str], key: str = "message_id") -> DataFrame:
    """(key, field, expected, got) of each expected value that was not predicted."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"expected_{f}").cast("string").alias("expected"), F.col(f).cast("string").alias("got")) for f in fields])
    return predictions.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where("expected IS NOT NULL AND NOT (expected <=> got)")


def nearest_rank_percentile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The value at index round-half-even(p * (n - 1)) of each group, found by refinement of intervals."""
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(by).agg(F.count("*").alias("n"))
    ranks = counts.select(by, "n", F.bround(p * (F.col("n") - 1), 0).cast("long").alias("rank"))
    found = values_at(rows, [by], value, ranks).select(F.col(by).alias("_by"), F.col("x").alias("percentile"))
    return ranks.join(found, F.col(by).eqNullSafe(F.col("_by"))).select(by, "percentile", "n")


def _any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def triage_rules(tickets: DataFrame, table: Sequence[tuple[Sequence[str], str]], urgent: Sequence[str], downplayed: Sequence[str], irreversible: Sequence[str], certain: Sequence[str] = ("bug", "billing", "account"), confidence: float = 0.4, least: float = 0.6) -> DataFrame:
    """First matching keyword row gives the category; urgency is guarded by negations; low confidence or an
    irreversible action needs a human."""
    text = F.lower(F.concat_ws(" ", "subject", "body"))
    category = F.lit(None).cast("string")
    for words, label in reversed(table):
        category = F.when(_any(text, words), label).otherwise(category)
    t = tickets.withColumns({"category": F.coalesce(category, F.lit("other")), "irreversible": _any(text, irreversible)})
    priority = F.when(~_any(text, downplayed) & _any(text, urgent), "P1").when(F.col("category").isin(*certain), "P2").otherwise("P3")
    return t.withColumns({"priority": priority, "needs_human": F.lit(confidence < least) | F.col("irreversible")})


def route_category(messages: DataFrame, technical: Sequence[str], billing: Sequence[str]) -> DataFrame:
    text = F.lower("text")
    return messages.withColumn("category", F.when(_any(text, technical), "technical").when(_any(text, billing), "billing").otherwise("general"))


def kb_keyword_lookup(messages: DataFrame, articles: DataFrame, hours: dict[str, int]) -> DataFrame:
    """First article (by position) whose keyword the text contains, else the general one; answer time by priority.

    ``articles`` is a hand-kept table: up to 10,000 rows it is broadcast, a longer one meets the messages in blocks.
    """
    if articles.limit(10_001).count() <= 10_000:
        articles = F.broadcast(articles)
    hit = messages.select("message_id", "text").join(articles, F.lower("text").contains(F.col("keyword")))
    first = hit.groupBy("message_id").agg(F.min_by("title", "position").alias("title"))
    sla = F.lit(24)
    for name, h in hours.items():
        sla = F.when(F.col("priority") == name, h).otherwise(sla)
    return messages.join(first, "message_id", "left").select("message_id", F.coalesce("title", F.lit("General Support")).alias("title"), sla.cast("long").alias("hours"))
