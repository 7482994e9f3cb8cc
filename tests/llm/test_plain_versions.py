"""Learned operators against plain versions of what they compute, and their values on awkward rows."""

import itertools
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelode.llm import langid, ngram_lm, quality, queries, rules, text, toxicity

from .test_operators import LOWER, ODD, WORD, plain_numbers


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, score string")


def plain_buckets(t):
    s = re.sub("\0+", "\0", "".join(c if c.isalpha() else "\0" for c in f"\n{t}\n".lower()))
    out = []
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if (n == 1 and g != "\0") or (n == 2 and g != "\0\0") or (n == 3 and g[1] != "\0"):
                h = 0
                for c in g:
                    h = (h * 0x10FFFF + (0 if c == "\0" else ord(c))) % 2**64
                out.append(int(text.mix(np.array([(h + (n << 60)) % 2**64], np.uint64))[0] % np.uint64(langid.BUCKETS)))
    return out


def test_naive_bayes_equals_plain_counts(spark, docs):
    rows = docs.where("length(text) < 1500").orderBy("doc_id").limit(40).collect()
    learn, ask = rows[::2], rows[1::2]
    counts, n = {}, Counter(r.lang for r in learn)
    for r in learn:
        counts.setdefault(r.lang, Counter()).update(plain_buckets(r.text))
    total = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    model = langid.fit(spark.createDataFrame([(r.text, r.lang) for r in learn], "text string, lang string"))
    got = langid.identify(spark.createDataFrame([(r.doc_id, r.text) for r in ask], "doc_id long, text string"), model).collect()
    for r, t in zip(sorted(got, key=lambda r: r.doc_id), ask):
        logs = {x: math.log(n[x] / len(learn)) + sum(math.log((c[b] + 0.5) / total[x]) for b in plain_buckets(t.text)) for x, c in counts.items()}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best and math.isclose(r.lang_score, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-6)


def test_random_indexing_equals_plain_sums(spark):
    texts = ["The cat sat on the Mat. 12%", "a", "", "The dog, the dog and the cat"]
    index, total, pooled = quality._index_matrix().astype(float), np.zeros((quality.ROWS, quality.DIM)), []
    tokens = []
    for t in texts:
        w, word, shape = quality._tokens(pa.array([t]))
        tokens.append((word, shape))
        assert len(word) == len(WORD.findall(t))
        for i in range(len(word)):
            for j in range(max(0, i - quality.WINDOW), min(len(word), i + quality.WINDOW + 1)):
                if i != j:
                    for key in (word[i], shape[i]):
                        total[key] += index[word[j]] + index[shape[j]]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"))
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-5)
    for word, shape in tokens:
        parts = [f(want[k], axis=0) if len(k) else np.zeros(quality.DIM) for k in (word, shape) for f in (np.mean, np.std)]
        pooled.append(np.concatenate([*parts, [len(set(word.tolist())) / max(len(word), 1), math.log1p(len(word))]]))
    assert np.allclose(quality.pooled(pa.array(texts), got), np.array(pooled), atol=1e-4)


def test_temperature_lowers_the_loss_of_rows_left_out():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 6)), rng.integers(0, 2, 400).astype(float)  # labels at random: a fitted net is too sure
    model = quality.train(x, y, np.zeros((1, 1)))
    z, t = model.logits(x[::5]), y[::5]
    loss = lambda c: np.logaddexp(0, np.where(t > 0, -z, z) / c).mean()
    assert model.temperature > 1 and loss(model.temperature) < loss(1.0)


def test_machine_equals_sum_over_pairs(spark):
    rng = np.random.default_rng(4)
    model = toxicity.Machine(np.sort(rng.integers(0, 2**63, 6).astype(np.uint64)), 0.3, rng.normal(size=6), rng.normal(size=(6, toxicity.FACTORS)))
    for chosen in ([], [2], [0, 3, 5], list(range(6))):
        at = np.array(chosen, np.int64)
        pairs = sum(float(model.v[i] @ model.v[j]) for i, j in itertools.combinations(chosen, 2))
        want = 0.3 + sum(model.w[i] for i in chosen) + pairs / math.sqrt(max(len(chosen), 1))
        assert math.isclose(model.logits(at, np.zeros(len(at), np.int64), 1)[0], want, rel_tol=1e-9)


def test_terms_are_those_of_the_highest_chi_squared(spark):
    rng, rows = np.random.default_rng(6), []
    for i in range(300):
        y = int(rng.random() < 0.3)
        rows.append((sorted({int(k) for k in rng.integers(0, 40, 8)} | ({100} if y and rng.random() < 0.9 else set()) | ({101} if rng.random() < (0.1 if y else 0.6) else set())), y))
    pos, n = sum(y for _, y in rows) / len(rows), len(rows)
    got = toxicity.strong_terms(spark.createDataFrame(rows, "terms array<long>, label int"), n, pos)
    want = []
    for t in {t for ts, _ in rows for t in ts}:
        have = [y for ts, y in rows if t in ts]
        e = len(have) * pos
        if len(have) >= toxicity.MIN_DOCS and (sum(have) - e) ** 2 / (e * (1 - pos) * max(1 - len(have) / n, 1 / n)) >= toxicity.MIN_CHI2:
            want.append(t)
    assert got.tolist() == sorted(want) and {100, 101} <= set(want)


def test_quality_verdict_equals_plain_estimation(spark, sf_dir, docs):
    """Votes by another engine, expectation-maximisation over single documents in numpy."""
    rows = []
    for r in docs.collect():
        t = r.text or ""
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = plain_numbers(t)
        rows.append((r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, sum(bool(WORD.search(x)) for x in t.split("\n")), len(re.findall("[A-Z]", t)), len(set(WORD.findall(t))), t.count("|"), t.count("!")))
    con = duckdb.connect()
    con.execute("CREATE TABLE m (doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, n_lines BIGINT, n_capitals BIGINT, n_distinct_words BIGINT, n_bars BIGINT, n_bangs BIGINT)")
    con.executemany(f"INSERT INTO m VALUES ({', '.join('?' * 11)})", rows)
    cases = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in rules.RULES)
    found = con.sql(f"SELECT doc_id, n_words < 50 OR 100 * n_repeat_words > 50 * n_words, {cases} FROM m").fetchall()
    votes = np.array([r[2:] for r in found])
    good, a, b = 0.8, np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.8)

    def posterior():
        z = math.log(good / (1 - good)) + np.where(votes == 1, np.log(a / (1 - b)), np.where(votes == -1, np.log((1 - a) / b), 0.0)).sum(1)
        return 1 / (1 + np.exp(-z))

    for _ in range(rules.ITERATIONS):
        p, before = posterior(), np.concatenate([[good], a, b])
        good = min(max(p.mean(), 0.05), 0.95)
        a = np.clip((((votes == 1) * p[:, None]).sum(0) + 8) / (((votes != 0) * p[:, None]).sum(0) + 10), *rules.ACCURACY)
        b = np.clip((((votes == -1) * (1 - p)[:, None]).sum(0) + 8) / (((votes != 0) * (1 - p)[:, None]).sum(0) + 10), *rules.ACCURACY)
        if np.abs(np.concatenate([[good], a, b]) - before).max() < 1e-4:
            break
    want = {r[0]: not r[1] and bool(p >= 0.5) for r, p in zip(found, posterior())}
    assert {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, sf_dir).collect()} == want and len(set(want.values())) == 2


def _by_text(rows, column):
    out = {}
    for r in rows:
        out.setdefault(r.text or "", set()).add(r[column])
    return out


def test_values_on_awkward_rows(spark, sf_dir, docs, odd):
    """Null texts are as empty ones, repeated texts get one value, and every row comes back with a value in its range."""
    machine = queries.toxicity_model(spark, docs, sf_dir)
    toxic = toxicity.score(odd, machine, out_col="p").collect()
    vectors = quality.word_vectors(docs)
    sample = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(["Good plain words, in a sentence.", "$$ BUY !!! $$ NOW"] * 40)], "doc_id long, text string, label int")
    good = quality.score(odd, quality.fit(sample, vectors), out_col="p").collect()
    for rows in (toxic, good):
        by = _by_text(rows, "p")
        assert len(rows) == len(ODD) and all(len(v) == 1 and 0 <= min(v) <= 1 for v in by.values())
        assert {r.score for r in rows} == {"clash"}
    assert _by_text(toxic, "p")[""] == {1 / (1 + math.exp(-machine.w0))}
    scored = ngram_lm.score(odd, F.lit(ngram_lm.COUNTING)).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    tokens = {t or "": [*WORD.findall((t or "").translate(LOWER)), None] for _, t in ODD}
    n = sum(len(tokens[t or ""]) for _, t in ODD)
    assert all(r.train_tokens == n and r.n_tokens == len(tokens[r.text or ""]) == r.n_known and r.score < 0 for r in scored)
    assert all(len(v) == 1 for v in _by_text(scored, "score").values()) and _by_text(scored, "n_tokens")[""] == {1}
    judged = rules.judge(odd).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in judged) == sorted((len(WORD.findall(t or "")), True, False) for _, t in ODD)
