"""Vector search, lexical search, percentiles, vector sums and paired tests against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.functions.tails import normal_two_sided
from tracelode.operators import evaluation, lexical, operations, ranking, selection


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e6, 1e150])
def test_exact_search_far_from_the_origin(spark, scale):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=8) * scale
    v = centre + rng.normal(size=(300, 8)) * (1 if scale < 1e100 else scale)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.chunk_id for r in ranking.knn_exact(queries, vectors, 10).collect()}
    for q in range(20):
        d = ((v - v[q]) ** 2).sum(1)
        assert [got[q, k + 1] for k in range(10)] == np.lexsort((np.arange(300), d))[:10].tolist()


def test_squares_that_overflow_lose_no_neighbour(spark):
    rows = [(i, [1e200 * (i % 3), float(i)]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    found = ranking.knn_exact(vectors.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), "embedding"), vectors, 5).collect()
    assert sorted((r.chunk_id for r in found if r.query_id == 0)) == [0, 3, 6, 9, 12] and len(found) == 15


def test_vectors_that_are_no_vectors_take_no_part(spark):
    good = [(i, [float(i), 0.0]) for i in range(6)]
    bad = [(90, None), (91, [1.0]), (92, [1.0, 2.0, 3.0]), (93, [float("nan"), 0.0]), (94, [float("inf"), 0.0]), (95, [None, 0.0]), (96, [])]
    kind = "chunk_id long, document_id long, embedding array<double>"
    vectors = spark.createDataFrame([(i, i % 2 if i < 90 else 7, v) for i, v in good + bad], kind)
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 0.0]), (3, None), (4, [1.0])], "query_id long, embedding array<double>")
    want = {(1, 0), (1, 1), (1, 2), (2, 5), (2, 4), (2, 3)}
    assert {(r.query_id, r.chunk_id) for r in ranking.knn_exact(queries, vectors, 3).collect()} == want
    assert {(r.query_id, r.chunk_id) for r in ranking.knn_filtered(queries, vectors, "chunk_id <> 0", 3).collect()} == want - {(1, 0)} | {(1, 3)}
    assert {(r.query_id, r.chunk_id) for r in ranking.knn_approx(queries, vectors, 3).collect()} == want
    assert {r.chunk_id for r in ranking.cosine_topk(queries, vectors, 3).collect()} <= set(range(6))
    assert ranking.similarity_matrix(queries, vectors).count() == 12
    assert {r.document_id: list(r.embedding) for r in ranking.vector_means(vectors).collect()} == {0: [2.0, 0.0], 1: [3.0, 0.0]}
    assert {(r.document_id, r.similar_id) for r in ranking.similar_documents(vectors.select("document_id", "embedding"), spark.createDataFrame([(0,)], "document_id long"), 9).collect()} == {(0, 1)}
    assert ranking.vector_means(vectors.where("chunk_id = 90")).count() == 0


def test_vector_sums_over_many_small_tasks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d), x.tolist()) for d, x in zip(rng.integers(0, 12, 500), rng.normal(size=(500, 3)))] + [(3, [1.0, 1.0, 1.0])] * 400
    df = spark.createDataFrame(rows, "document_id long, embedding array<double>").repartition(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.document_id: r.embedding for r in ranking.vector_means(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d in range(12):
        assert np.allclose(got[d], np.mean([x for k, x in rows if k == d], 0), atol=1e-12)


def plain_bm25(questions, chunks, k):
    docs = {i: (t or "").lower().split() for i, t in chunks}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for ws in docs.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    out = {}
    for q, text in questions:
        asked = Counter(text.lower().split())
        score = {i: round(sum(c * idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w, c in asked.items() if w in ws), 9) for i, ws in docs.items()}
        out[q] = [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:k]]
    return out


def plain_cosine(questions, chunks, k):
    docs = {i: Counter((t or "").lower().split()) for i, t in chunks}
    out = {}
    for q, text in questions:
        asked = Counter(text.lower().split())
        score = {i: round(sum(c * ws[w] for w, c in asked.items()) / math.sqrt(sum(c * c for c in asked.values()) * sum(c * c for c in ws.values())), 9) for i, ws in docs.items() if asked.keys() & ws.keys()}
        out[q] = [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:k]]
    return out


@pytest.mark.parametrize("shard, run, common", [(10_000, 32, 5), (7, 2, 5), (20, 3, 40)])
def test_block_max_search_equals_all_scores(spark, monkeypatch, shard, run, common):
    for name, value in (("SHARD", shard), ("RUN", run), ("QUERY_BLOCK", 3), ("BROADCAST_BYTES", 0 if run == 2 else 1 << 20)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(common)
    vocabulary = [f"W{i}" for i in range(30)] + ["the"] * common  # with 40, most weights are negative before the floor
    chunks = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 25)))) for i in range(120)] + [(500, None), (501, ""), (502, "the " * 60), (503, "w1 w2"), (504, "w1 w2")]
    questions = [(q, " ".join(rng.choice(vocabulary, rng.integers(1, 9)))) for q in range(8)] + [(20, "w1 W1 unknown"), (21, "nothing here")]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3), spark.createDataFrame(questions, "query_id long, question string")
    for found, want in ((ranking.bm25_topk(q, c, 6), plain_bm25(questions, chunks, 6)), (ranking.bag_of_words_search(q, c, 6), plain_cosine(questions, chunks, 6))):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        for i, rows in want.items():
            have = got.get(i, [])
            assert [x[0] for x in have] == [x[0] for x in rows] and np.allclose([x[1] for x in have], [x[1] for x in rows], atol=2e-9)


def test_bm25_where_the_mean_weight_is_negative(spark):
    chunks, questions = [(1, "a b c"), (2, "a b c"), (3, "a b c"), (4, "x")], [(1, "a b"), (2, "x")]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(questions, "query_id long, question string")
    want = plain_bm25(questions, chunks, 2)
    assert any(s < 0 for s in (plain_bm25(questions, chunks, 4)[1][-1][1],))
    assert {(r.query_id, r.rank): r.chunk_id for r in ranking.bm25_topk(q, c, 2).collect()} == {(i, k + 1): x[0] for i, rows in want.items() for k, x in enumerate(rows)}


def test_bounds_leave_most_pairs_unscored(spark):
    rng = np.random.default_rng(2)
    share = {}
    for n in (2_000, 8_000):
        zipf = lambda k: [f"w{int(x)}" for x in rng.zipf(1.3, k) % 50_000]
        chunks = spark.createDataFrame([(i, " ".join(zipf(60))) for i in range(n)], "chunk_id long, text string")
        queries = spark.createDataFrame([(i, " ".join(zipf(12))) for i in range(n // 100)], "query_id long, question string")
        work = ranking.lexical_work(queries, chunks, 5).first()
        share[n] = work.scored / work.pairs
    assert share[8_000] < 0.9 * share[2_000] < 0.9


@pytest.mark.parametrize("bins", [4096, 3])
def test_percentiles_equal_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    rng = np.random.default_rng(5)
    groups = {"one": [3.0], "same": [2.5] * 50, "two": [1.0, -1.0], "ints": rng.integers(0, 9, 300).astype(float), "wide": np.exp(rng.normal(0, 30, 400)) * rng.choice([-1, 1], 400), "ends": [-1.7e308, 0.0, 1.7e308], None: rng.normal(size=70)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("one", None), ("one", float("nan")), ("none", None)]
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: r for r in selection.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        with np.errstate(over="ignore"):
            assert got[g].n == len(v) and (g == "ends" or np.allclose(got[g].q, np.quantile(v, shares), rtol=1e-12))
    assert got["ends"].q[2] == 0.0
    assert selection.percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", shares).count() == 0


def test_one_group_of_distinct_values_stays_spread(spark):
    """No exchange of the plan that finds a rank carries the rows: partial aggregation comes before each one."""
    rows = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 7 % 200_003).cast("double").alias("x")).repartition(16)
    q = selection.percentiles(rows, ["g"], "x", (0.5,))
    assert q.first().q == [float(np.quantile(np.arange(200_000) * 7 % 200_003, 0.5))]
    ranks = spark.createDataFrame([(1, 5)], "g long, rank long")
    plan = selection.values_at(rows, ["g"], "x", ranks)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "percentile" not in plan  # what is returned is read from the table of intervals


def test_thin_rates_are_not_published(spark):
    made = [("/agent", 1.0, 200, False, "not_applicable" if i < 3 else "supported", 0.1) for i in range(12)] + [("/ask", 2.0, 500, True, None, None)] * 4
    requests = spark.createDataFrame([(*r, "2024-02-01 00:00:00") for r in made], "path string, latency_ms double, http_status int, error boolean, status string, cost_usd double, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    got = {r.path: r.asDict() for r in operations.stats_summary(requests, "2024-01-01 00:00:00", ("/agent", "/ask")).collect()}
    assert got["/agent"] == {"path": "/agent", "n": 12, "p50": 1.0, "p95": 1.0, "errors": 0, "error_rate": 0.0, "hit_rate": 0.75, "found_nothing_rate": 0.25, "cost_total": 1.2, "cost_per_ask": 0.1}
    assert got["/ask"] == {"path": "/ask", "n": 4, "p50": None, "p95": None, "errors": 4, "error_rate": None, "hit_rate": None, "found_nothing_rate": None, "cost_total": None, "cost_per_ask": None}
    cells = spark.createDataFrame([("a", 50, False), ("b", 50, True)], "name string, n long, hidden boolean")
    rates = spark.createDataFrame([("x", 5, 50, "a"), ("y", 5, 50, "b"), ("z", 5, 9, "a"), ("w", 5, 10, "none")], "name string, part long, whole long, cell string")
    assert {r.name: r.rate for r in operations.published_rates(rates, cells).collect()} == {"x": 0.1, "y": None, "z": None, "w": 0.5}


def test_sign_flips_are_the_bits_of_the_digests(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "FLIP_ROWS", 4)
    rng = np.random.default_rng(0)
    rows = [(i, float(x)) for i, x in enumerate(rng.normal(size=11))]
    got = {r.permutation: r.s for r in evaluation.sign_flip_sums(spark.createDataFrame(rows, "query_id long, difference double").repartition(3), 300, "s").collect()}
    assert sorted(got) == list(range(1, 301))
    for p in (1, 2, 128, 129, 300):
        k, bit = divmod(p - 1, 128)
        want = sum(-x if int.from_bytes(hashlib.md5(f"s:{k}:{i}".encode()).digest(), "big") >> (127 - bit) & 1 else x for i, x in rows)
        assert math.isclose(got[p], want, abs_tol=1e-12)


def test_paired_tests_give_both_p_values(spark):
    rows = [(i, 0.1 + (i % 3) * 0.05) for i in range(20)]
    row = evaluation.paired_tests(spark.createDataFrame([*rows, (99, None)], "query_id long, difference double"), 2_000).first()
    d = np.array([x for _, x in rows])
    t = d.mean() / (d.std(ddof=1) / math.sqrt(20))
    assert row.n == 20 and math.isclose(row.t, t, abs_tol=1e-5) and row.p_t == 0.0 and row.p < 0.01
    same = evaluation.paired_tests(spark.createDataFrame([(1, 0.0), (2, 0.0)], "query_id long, difference double"), 50).first()
    assert same.p == 1.0 and same.t is None and same.p_t is None


def test_normal_tail(spark):
    x = [0.0, 1e-9, 0.01, 0.5, 1.0, 1.959963984540054, 2.5758293035489004, 4.0, 6.5, 7.99, 8.5, 40.0]
    got = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").select(normal_two_sided(F.col("x")).alias("p"), normal_two_sided(-F.col("x")).alias("m")).collect()
    assert all(abs(r.p - math.erfc(v / math.sqrt(2))) < 1e-13 and r.p == r.m for r, v in zip(got, x)) and got[-1].p is None


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e4])
def test_approximate_search_follows_the_scale_of_the_data(spark, monkeypatch, scale):
    monkeypatch.setattr(ranking, "CELL_BLOCK", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * scale
    v = np.concatenate([centres[rng.integers(0, 30, 1_200)] + rng.normal(size=(1_200, 16)) * scale * 0.3, np.repeat(centres[:1], 500, 0)])  # the last ones fill hot buckets
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.chunk_id) for r in ranking.knn_exact(queries, vectors, 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in ranking.knn_approx(queries, vectors, 10).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.95 * len(exact)
