"""Findings of round 3: small cases that failed before."""

import itertools

import duckdb
import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from tracelode.llm import bpe, neardup, queries
from tracelode.operators import grounding, lexical, ranking, safety, selection
from tracelode.operators.text import chunk_fixed, chunk_places, chunks_at, edged
from tracelode.plans import evaluation as plans
from tracelode.plans import registry
from tracelode.sources import store


def test_percentiles_round_once_as_the_sql_engine_does(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g in range(60) for x in np.round(rng.normal(100, 30, 10 + g), 3 if g % 2 else 12)]
    got = {r["g"]: list(r["q"]) for r in selection.percentiles(spark.createDataFrame(rows, "g long, x double"), ["g"], "x", (0.1, 0.7, 0.95)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(g BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert got == dict(con.execute("SELECT g, quantile_cont(x, [0.1, 0.7, 0.95]) FROM t GROUP BY g").fetchall())


def test_queries_with_the_same_words_are_searched_once(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"red {'blue ' * (i % 4)} w{i % 7}") for i in range(60)], "chunk_id long, text string")
    texts = ["red blue", "blue  Red", "w3", None, "", "absent"]
    queries = spark.createDataFrame([(i, texts[i % 6]) for i in range(30)], "query_id long, question string")
    seen, search = [], lexical.search
    monkeypatch.setattr(lexical, "search", lambda shards, weights, *rest: seen.append(weights.select("query_id").distinct().count()) or search(shards, weights, *rest))
    bm25 = ranking.bm25_topk(queries, chunks, 5).collect()
    bag = ranking.bag_of_words_search(queries, chunks, 5).collect()
    assert max(seen) <= 3
    for found, answered in ((bm25, 30), (bag, 15)):
        lists = {}
        for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
            lists.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
        assert len(lists) == answered and all(len(x) == 5 for x in lists.values())
        assert all(lists[i] == lists[i % 6] for i in lists) and lists[0] == lists[1]


def test_near_pairs_of_blocks_are_few_and_miss_none():
    rng = np.random.default_rng(2)
    for scale, shift in ((1.0, 0.0), (1e-25, 0.0), (1e3, 1e6), (1e200, 0.0)):
        v, q = (rng.normal(size=(n, 16)) * scale + shift for n in (2_000, 20))
        for cosine in (False, True):
            a, b = ranking._unit(q, cosine), ranking._unit(v, cosine)
            block = ranking._Vectors(b, cosine)
            i, j = (x.ravel() for x in np.indices((20, 2_000)))
            d = ranking._exact(a, b, i, j, cosine).reshape(20, -1)
            kth = np.sort(d, axis=1)[:, 9]
            for bound in (kth, np.full(20, np.inf)):
                found = set(zip(*(x.tolist() for x in block.possible(a, bound, 10))))
                assert {(x, y) for x, y in zip(*(z.tolist() for z in np.nonzero(d <= kth[:, None])))} <= found
                assert scale != 1.0 or len(found) < 20 * 15


def test_similar_documents_that_tie_at_nine_digits_come_in_order_of_id(spark):
    rows = [(100, [0.0, 0.0]), *[(i, [1.0 + (10 - i) * 1e-13, 0.0]) for i in range(1, 10)]]  # the smaller the id, the farther by less than nine digits
    centroids = spark.createDataFrame(rows, "document_id long, embedding array<double>").coalesce(1)
    found = ranking.similar_documents(centroids, spark.createDataFrame([(100,)], "document_id long"), 3).collect()
    assert sorted((r["rank"], r.similar_id) for r in found) == [(1, 1), (2, 2), (3, 3)]


def test_approximate_search_moves_no_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    text = []
    seen, ranking.written = ranking.written, lambda df, name, **o: text.append(df._jdf.queryExecution().toString()) or store.written(df, name, **o)
    try:
        assert ranking.knn_approx(queries, vectors, 5).count() == 100
    finally:
        ranking.written = seen
    assert text and not any("cogroup" in t.lower() for t in text)


def test_reports_read_written_inputs(spark, sf_dir, monkeypatch):
    given = []
    for name in ("eval_report", "signal_quartile_gain"):
        monkeypatch.setattr(plans.E, name, lambda df, *rest, name=name: given.append((name, df.inputFiles())) or df)
        getattr(plans, name)(registry.Tables(spark, sf_dir))
    assert all(files and all(part in f for f in files) for (_, files), part in zip(given, ("/records-", "/signals-")))


def test_words_end_where_the_sql_engine_ends_them(spark):
    replies = spark.createDataFrame([(1, "Yesñjaco es la regla. Bueno.", "Max 2 pets, dogs under 50 lbs.", "I have 3 dogs of 80 lbs"), (2, "El señor no. Ñgym es bueno.", "", "")], "trace_id long, response string, evidence string, user_text string")
    got = {r.trace_id: r.grounded for r in grounding.ground_responses(replies).collect()}
    assert got == {1: "Bueno. Our policy: at most 2 pets, dogs under 50 lbs.", 2: f"El señor no. {grounding.HEDGE}"}
    con = duckdb.connect()
    for pattern, text in ((r"\byes\b", "yesñjaco"), (r"\bgym\b", "ñgym"), (r"\byes\b", "yesno yes_ 1yes"), (r"\bno\b", "el no.")):
        engine = con.execute("SELECT regexp_matches(?, ?)", [text, pattern]).fetchone()[0]
        assert engine == spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(edged(pattern))).first()[0]


def test_components_are_looked_up_for_open_buckets_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for size in (2, 2, 3, 12):
        base = rng.integers(0, 10_000, 400)
        for k in range(size):
            words = base.copy()
            words[rng.integers(0, 400, 4)] = rng.integers(0, 10_000, 4)
            rows.append((n, " ".join(map(str, words.tolist()))))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, neardup.groups(docs).collect()))
    looked_up, relabel = [], neardup._relabel

    def seen(given, labels):
        looked_up.append((given.count(), given.groupBy("band").agg(F.count_distinct("comp").alias("n")).where("n < 2").count() if "comp" in given.columns else None))
        return relabel(given, labels)

    monkeypatch.setattr(neardup, "OPEN_PER_ROW", 0)
    monkeypatch.setattr(neardup, "_relabel", seen)
    assert sorted(map(tuple, neardup.groups(docs).collect())) == want
    assert {r[2] for r in want} == {0, 2, 4, 7}
    assert looked_up and all(settled == 0 for _, settled in looked_up) and looked_up == sorted(looked_up, reverse=True)


def test_names_are_looked_for_only_where_their_words_stand():
    texts = ["Released under the MIT License. For research use only", "licensed under 2-clause BSD, new BSD", "License: GNU General Public License v3", "licensed under CC BY-NC 4.0", "nothing here", "All  Rights Reserved", "licenſed under ISC", "SPDX-License-Identifier: mit"]
    calls = []
    for text in texts:
        full = [m for *_, name, _, _ in safety._NAMES for m in name.findall(text)]
        used = [m for (*_, name, _, _), word in zip(safety._NAMES, safety._NAMES_NEEDED) if word in text.lower() for m in name.findall(text)]
        assert full == used
        calls.append(sum(word in text.lower() for word in safety._NAMES_NEEDED))
    assert calls[4] == 0 and all(safety._NAMES_NEEDED)
    assert [c[0] for c in safety.licence_claims(texts[6])] == ["ISC"]


def test_rules_of_use_are_tried_only_where_their_words_stand(spark):
    docs = [(i, f"x {a} {b} y") for i, (a, b) in enumerate([("Not for any CLASSROOM use.", ""), ("Teaching use ​is prohibited", "classroom use is permitted"), ("Paid‐only", ""), ("é A fee is required", ""), ("You may not adapt this work", ""), ("No educational use restrictions apply", "")])]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, safety.use_restrictions(rows).collect()))
    assert got == sorted(map(tuple, safety.use_restrictions(rows, list(safety.USE_RESTRICTIONS)).collect())) and len(got) == 5


def test_a_task_of_the_matrix_has_a_bounded_share_of_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], "chunk_id long, embedding array<double>").coalesce(1)
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(ranking, "TASK_PAIRS", 500)
    found = ranking.similarity_matrix(queries, vectors)
    shares = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(shares) == 8_000 == found.distinct().count() and max(shares) <= 1_000


def test_blocks_that_are_searched_first_are_dealt_over_tasks(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    want = sorted(map(tuple, ranking.knn_exact(queries, vectors, 5).collect()))
    folder, search, write, first = str(tmp_path), ranking._nearest, ranking.written, []

    def seen(*args):
        run = search(*args)

        def best(batches):
            rows = iter(batches)
            for row in itertools.islice(rows, 1):
                open(f"{folder}/{TaskContext.get().stageId()}-{TaskContext.get().partitionId()}", "w").close()
                yield from run(itertools.chain([row], rows))

        return best

    def kept(df, name, **options):
        found = write(df, name, **options)
        if name == "bounds":
            first.append(len(list(tmp_path.iterdir())))
        return found

    for name, value in (("VECTOR_BLOCK", 4), ("_nearest", seen), ("written", kept)):
        monkeypatch.setattr(ranking, name, value)
    assert sorted(map(tuple, ranking.knn_exact(queries, vectors, 5).collect())) == want
    assert len(first) == 1 and first[0] > 1


def test_pairs_with_equal_ids_are_left_out_and_do_not_bound_others():
    rng = np.random.default_rng(8)
    v, q = rng.normal(size=(2_003, 16)), rng.normal(size=(20, 16))
    v[:20] = q
    for cosine in (False, True):
        a, b = ranking._unit(q, cosine), ranking._unit(v, cosine)
        d = ranking._exact(a, b, *(x.ravel() for x in np.indices((20, 2_003))), cosine).reshape(20, -1)
        d[np.arange(20), np.arange(20)] = np.inf
        kth = np.sort(d, axis=1)[:, 9]
        for bound in (kth, np.full(20, np.inf), np.where(np.arange(20) % 2, kth, np.inf)):
            found = set(zip(*(x.tolist() for x in ranking._Vectors(b, cosine).possible(a, bound, 10, (np.arange(20), np.arange(2_003))))))
            assert {(x, y) for x, y in zip(*(z.tolist() for z in np.nonzero(d <= kth[:, None])))} <= found
            assert all(x != y for x, y in found) and len(found) < 20 * 15


def test_only_chunks_that_are_asked_for_are_cut(spark, sf_dir):
    docs = spark.createDataFrame([(1, "añ𝄞b" * 700, "x"), (2, "", "x"), (3, None, "x"), (4, "short", None), (5, "y" * 1600, "z")], "doc_id long, text string, lang string")
    every = {(r.doc_id, r.chunk_index): r.text for r in chunk_fixed(docs, 800).collect()}
    assert sorted(every) == sorted((r.doc_id, r.chunk_index) for r in chunk_places(docs, 800, "lang").collect()) and len(every) == 7
    asked = [(1, 0), (1, 3), (1, 3), (1, 4), (2, 0), (3, 0), (4, 0), (4, -1), (5, 1), (5, 2), (9, 0)]
    places = spark.createDataFrame(asked, "doc_id long, chunk_index long")
    for most in (100, 0):
        found = [(r.doc_id, r.chunk_index, r.text) for r in chunks_at(docs, places, 800, most).collect()]
        assert sorted(found) == sorted((*x, every[x]) for x in set(asked) & set(every))
    t = registry.Tables(spark, sf_dir)
    assert t("chunk_vectors").exceptAll(t("chunks").select(*t("chunk_vectors").columns)).isEmpty() and t("chunk_vectors").count() == t("chunks").count()


def least_reached(links):
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent if root(x) != x}


def test_components_of_odd_graphs(spark):
    rng = np.random.default_rng(8)
    chain, zigzag = [(i, i + 1) for i in range(30)], [(100 + (i if i % 2 else 60 - i), 100 + (i + 1 if i % 2 == 0 else 60 - i - 1)) for i in range(40)]
    star = [(300, 299 - i if i % 2 else 301 + i) for i in range(60)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (220, 2))]
    links = [*chain, *zigzag, *star, *star[:5], *[(b, a) for a, b in loose[:50]], *loose, (7, 7), (5000, 5000), (-3, 2000)]
    found = neardup.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(found) == len({r.id for r in found})
    assert {r.id: r.label for r in found if r.id != r.label} == least_reached(links)
    assert neardup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_take_few_stages(spark):
    """What a round of near-duplicates links (each id with one leader below it) is joined in one turn."""
    rng = np.random.default_rng(9)
    links = neardup.written(spark.createDataFrame([(i, int(rng.integers(0, i))) for i in range(1, 60)], "u long, v long"), "links")
    context = spark.sparkContext
    context.setJobGroup("components-test", "")
    try:
        found = {r.id: r.label for r in neardup.components(links).collect()}
        tracker = context.statusTracker()
        jobs = map(tracker.getJobInfo, tracker.getJobIdsForGroup("components-test"))
        stages = {s for j in jobs for s in j.stageIds}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {i: label for i, label in found.items() if i} == dict.fromkeys(range(1, 60), 0)
    assert len(stages) <= 40


def junk_words(n, seed):
    letters = np.array(list("bcdfghjklmnpqrstvwxz"))
    return ["".join(w) for w in letters[np.random.default_rng(seed).integers(0, len(letters), (n, 10))].tolist()]


def test_frequent_words_are_merged_once(monkeypatch):
    merged, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, *rest: merged.append(piece) or merge(piece, *rest))
    encoder, frequent, rare = bpe.Encoder(queries.vocabulary()), junk_words(1000, 1), junk_words(180_000, 2)
    for _ in range(2):
        want = encoder.encode([" " + " ".join(frequent)])[0].tolist()
    for i in range(0, len(rare), 22_000):
        encoder.encode([" " + " ".join(rare[i : i + 22_000])])
    merged.clear()
    assert encoder.encode([" " + " ".join(frequent)])[0].tolist() == want
    assert len(merged) < 250


def test_merged_words_equal_those_of_tiktoken():
    import public_tokenizers
    import tiktoken

    v = queries.vocabulary()
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks(), special_tokens={})
    words = junk_words(300, 3)
    texts = [*words, *words, "", "é" * 200, "ñü語😀" * 3, *("".join(words)[:n] for n in (7, 8, 9, 253, 254, 255, 256, 257, 2000)), " ".join(words)]
    encoder = bpe.Encoder(v)
    for _ in range(2):  # the second time from what is remembered
        ids, n = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [coder.encode_ordinary(t) for t in texts]
