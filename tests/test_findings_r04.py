"""Findings of the fourth round, on small inputs."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelode.operators import lexical, ranking
from tracelode.plans.registry import Tables


@pytest.mark.parametrize("kinds", [1, 4, 400])
def test_approximate_search_compares_few_pairs_of_crowded_buckets(monkeypatch, kinds):
    """however many vectors share a bucket with a query, only those that can be among its nearest are compared."""
    rng, k = np.random.default_rng(kinds), 5
    q, v = rng.normal(size=(40, 16)), rng.normal(size=(3_000, 16))
    cells = lambda m: (np.floor(m[:, :2] * 1e6).astype(np.int64) % kinds) * 2 + np.arange(2)
    pairs, exact = [], ranking._exact
    monkeypatch.setattr(ranking, "_exact", lambda q, v, i, j, cosine: pairs.append(len(i)) or exact(q, v, i, j, cosine))

    def batches():
        for a in range(0, 3_000, 1_000):
            bodies = [np.arange(40), np.full(40, np.inf), q, np.arange(a, a + 1_000), np.zeros(1_000, np.int64), v[a : a + 1_000]]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in bodies], ["q_ids", "q_own", "q_m", "v_ids", "v_own", "v_m"])

    got = [[] for _ in q]
    for found in ranking._nearest(k, False, False, 0.0, cells)(batches()):
        for i, j, d in zip(*(c.to_pylist() for c in found.columns)):
            got[i].append((d, j))
    assert sum(pairs) < 0.1 * 40 * 3_000
    for i, asked in enumerate(cells(q)):
        open_ = np.flatnonzero((cells(v) == asked).any(1))
        d = ((v[open_] - q[i]) ** 2).sum(1)
        assert [j for _, j in sorted(got[i])[:k]] == open_[np.lexsort((open_, d))][:k].tolist()


def test_approximate_search_measures_its_reach_without_gathering_vectors(spark, monkeypatch):
    """the vectors of the pilot are told by their ids alone, not sorted into one task."""
    rng, seen, exact = np.random.default_rng(5), [], ranking.knn_exact
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 8)))], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    monkeypatch.setattr(ranking, "PILOT_VECTORS", 100)
    monkeypatch.setattr(ranking, "knn_exact", lambda q, v, k: seen.append((v._jdf.queryExecution().optimizedPlan().toString(), v.count())) or exact(q, v, k))
    assert ranking.knn_approx(queries, vectors, 5).count() == 30 * 5
    assert seen and all("Sort" not in plan and 50 < n < 200 for plan, n in seen)


def _shards(spark, monkeypatch, n):
    monkeypatch.setattr(lexical, "SHARD", 20)
    rng = np.random.default_rng(6)
    chunks = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 30))) for i in range(20 * n)]
    return lexical.index(spark.createDataFrame(chunks, "chunk_id long, text string").coalesce(1))


def test_shards_that_are_searched_first_are_dealt_out(spark, monkeypatch):
    """F3 to F5, F7 to F11: one task had all of them, and their number grows with the table."""
    shards = _shards(spark, monkeypatch, 48)
    pilot = lexical._pilot(shards, 16)
    sizes = [r["count"] for r in pilot.groupBy(F.spark_partition_id()).count().collect()]
    assert shards.count() == 48 and sum(sizes) == 16 and max(sizes) <= 8


def test_groups_of_rows_end_with_their_size_where_rows_are_large(spark, monkeypatch):
    """F3 to F5, F7 to F11: a hundred shards lay in one group of rows, which writers and readers hold as a whole."""
    monkeypatch.setitem(lexical.LARGE_ROWS, "parquet.block.size", "8192")
    shards = _shards(spark, monkeypatch, 48)
    files = glob.glob(f"{shards.inputFiles()[0].removeprefix('file://').rsplit('/', 1)[0]}/*.parquet")
    metadata = [pq.ParquetFile(f).metadata for f in files]
    assert max(m.row_group(i).num_rows for m in metadata for i in range(m.num_row_groups)) <= 8


@pytest.mark.parametrize("name", ["fused_pool", "all_rankings"])
def test_only_found_chunks_are_made(spark, sf_dir, name):
    """every text was cut, joined with vectors and shuffled for the few chunks that were found."""
    t = Tables(spark, sf_dir)
    t(name)
    assert "chunks" not in t._made


def test_centroids_shuffle_no_texts(spark, sf_dir):
    """texts and vectors went through several exchanges together, again for each reading of the centroids."""
    t = Tables(spark, sf_dir)
    found = t("centroids")
    assert "chunks" not in t._made and found.inputFiles()
    texts = t("chunk_texts").withColumn("document_id", F.expr("chunk_id div 1000000"))
    plan = ranking.chunk_quality(texts, "document_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_centroids_with_vectors_from_elsewhere(spark):
    """chunks that repeat an id count alike whether vectors stand beside the texts or are looked up."""
    good, bad = "A whole sentence that stands for a chunk of text. " * 3, "short"
    rows = [(1, 10, good, [1.0, 0.0]), (1, 11, "More. " + good, [0.0, 1.0]), (1, 12, bad, [9.0, 9.0]), (2, 20, bad, [2.0, 2.0]), (3, 30, good, [1.0, 1.0]), (3, 30, "Again. " + good, [1.0, 1.0]), (3, 31, "Other. " + good, [4.0, 4.0])]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_id long, text string, embedding array<double>")
    lookup = chunks.select("chunk_id", "embedding").distinct()
    beside = {r.document_id: r.embedding for r in ranking.document_centroids(chunks).collect()}
    apart = {r.document_id: r.embedding for r in ranking.document_centroids(chunks.drop("embedding"), lambda used: used.join(lookup, "chunk_id")).collect()}
    assert beside == apart == {1: [0.5, 0.5], 2: [2.0, 2.0], 3: [1.6, 1.6]}
