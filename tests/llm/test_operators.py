"""The training-data operators against brute force, round trips, held-out accuracy and awkward rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelode.llm import bpe, decontaminate, langid, neardup, ngram_lm, pii, quality, queries, rules, toxicity, urls
from tracelode.llm.samples import labelled

ODD = [(1, "plain words here"), (2, ""), (3, None), (4, " \n\t "), (5, "x" * 200_000), (6, "plain words here"), (6, "plain words here"), (None, "no id")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(*r, "clash", 1.0, [1]) for r in ODD], "doc_id long, text string, score string, kept double, token_ids array<int>")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_bpe_equals_tiktoken_and_round_trips(spark, sf_dir, texts, odd, empty):
    import public_tokenizers
    import tiktoken

    v = queries.vocabulary()
    assert sorted(v.perfect.slots.tolist()) == list(range(len(v.tokens)))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks(), special_tokens={})
    for r in queries.op1_bpe_round_trip(spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    found = bpe.decode(bpe.encode(odd, v), v).collect()
    assert Counter((r.decoded or b"").decode() for r in found) == Counter(t or "" for _, t in ODD)
    both = bpe.round_trip(odd, v)
    assert both.columns == ["doc_id", "text", "score", "kept", "token_ids", "decoded"]
    assert sorted(((r.doc_id is None, r.doc_id), list(r.token_ids), bytes(r.decoded)) for r in both.collect()) == sorted(((r.doc_id is None, r.doc_id), list(r.token_ids), bytes(r.decoded)) for r in found)
    assert bpe.encode(empty, v).count() == 0 and bpe.round_trip(empty, v).count() == 0


def test_quality_is_learned(spark, sf_dir, odd, empty):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = [r for r in queries.op2_quality_classifier(spark, sf_dir).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.8 * len(held)
    vectors = quality.word_vectors(empty)
    none = labelled(empty, spark.createDataFrame([], "doc_id long, quality int"), "quality", F.lit(True), 10, 1)
    model = quality.fit(none, vectors)
    assert quality.score(odd, model, out_col="q").count() == len(ODD) and quality.score(empty, model).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(t):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out[kind].append(m.span())
    return out


def test_pii_base_equals_the_patterns(spark, sf_dir, texts, odd, empty):
    anchors, rng = pii.automaton(), np.random.default_rng(3)
    noise = ["".join(rng.choice(list("0123.+- ()@a4b_%\n"), rng.integers(1, 40))) for _ in range(20_000)]
    for t in [*texts.values(), *noise, "4111 1111 1111 1111", "7.1.1.1 begins"]:
        found = pii.find(t, anchors)
        assert {k: found[k] for k in pii.BASE_KINDS} == plain_pii(t)
    row = next(r for r in queries.op3_pii(spark, sf_dir).collect() if r.n_email)
    assert row.n_email == len(plain_pii(texts[row.doc_id])["email"])
    extra = pii.find("see https://bob:pw@host.example/ IBAN DE89370400440532013000 account no: 123456789 token = \"abcdefabcdefabcdef\"", anchors)
    assert [len(extra[k]) for k in ("userinfo", "iban", "account", "secret")] == [1, 1, 1, 1]
    assert pii.find("https://" + "u" * 300 + ":p@h.example/", anchors)["userinfo"] == [(8, 310)]
    assert pii.find("h://a/b@c.d and h://x y@c.d", anchors)["userinfo"] == []
    assert not any(pii.find(t, anchors)["account"] for t in ("accountable 12345678", "subaccount 12345678", "accountant: 12345678")) and pii.find("Account: 12345678", anchors)["account"] == [(9, 17)]
    assert [(r.doc_id, r.pii_spans, r.score) for r in pii.find_spans(odd).collect()] == [(i, [], "clash") for i, _ in ODD] and pii.find_spans(empty).count() == 0
    clean = pii.redact(pii.find_spans(spark.createDataFrame([("é a@b.cd and 7.1.1.1",), (None,)], "text string"))).select("text").collect()
    assert [r.text for r in clean] == ["é <EMAIL> and <IP>", None]


def test_language_model_against_plain_counts(spark, sf_dir, texts, odd, empty):
    found = {r.doc_id: r for r in queries.op4_ngram_lm(spark, sf_dir).collect()}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if fold[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, fold[i] == 0)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [i for i in tokens if fold[i] == 0]
    assert sum(found[i].score for i in held) > sum(found[i].base_score for i in held)
    kind = F.lit(ngram_lm.COUNTING)
    assert ngram_lm.score(odd, kind).count() == len(ODD) and ngram_lm.score(empty, kind).count() == 0


def plain_mixture(tokens, kind):
    """Log10 probabilities of texts by deleted interpolation with expectation-maximisation on each tuning token, without histograms."""
    c_all = Counter(w for i, ws in tokens.items() if kind[i] >= ngram_lm.TUNING for w in ws)
    counting = [ws for i, ws in tokens.items() if kind[i] == ngram_lm.COUNTING]
    c1, c2 = Counter(w for ws in counting for w in ws), Counter((a, b) for ws in counting for a, b in zip([0, *ws], ws))
    before, n = Counter(a for ws in counting for a in [0, *ws[:-1]]), sum(c1.values())
    uniform = 1 / (len(c_all) + 1)

    def weight(ratios):
        w = 0.5
        for _ in range(40):
            w = min(max(sum(w * r / (w * r + 1 - w) for r in ratios) / len(ratios), 1e-4), 1 - 1e-4)
        return w

    tuning = [ws for i, ws in tokens.items() if kind[i] == ngram_lm.TUNING]
    u = weight([c1[w] / n / uniform for ws in tuning for w in ws])
    lower = lambda w: u * c1[w] / n + (1 - u) * uniform
    ratios = {}
    for ws in tuning:
        for a, b in zip([0, *ws], ws):
            if before[a]:
                ratios.setdefault(int(math.log2(before[a] + 1)), []).append(c2[a, b] / before[a] / lower(b))
    weights = {k: weight(v) for k, v in ratios.items()}

    def p(a, b):
        w = weights.get(int(math.log2(before[a] + 1)), 0.0) if before[a] else 0.0
        return w * c2[a, b] / max(before[a], 1) + (1 - w) * lower(b)

    return {i: sum(math.log10(p(a, b)) for a, b in zip([0, *ws], ws)) for i, ws in tokens.items()}


def test_language_model_equals_plain_mixture(spark, sf_dir, texts):
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in tokens}
    want = plain_mixture(tokens, {i: min(f, 2) for i, f in fold.items()})
    got = {r.doc_id: r.score for r in queries.op4_ngram_lm(spark, sf_dir).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=2e-3) for i in texts)


def test_language_model_is_alike_for_all_chunks_and_levels(spark, docs, monkeypatch):
    kind = F.when(F.col("doc_id") % 5 == 1, ngram_lm.TUNING).when(F.col("doc_id") % 5 == 2, ngram_lm.HELD_OUT).otherwise(ngram_lm.COUNTING)

    def scores(chunk_bytes, one_level):
        monkeypatch.setattr(ngram_lm, "ONE_LEVEL", one_level)
        return {r.doc_id: (r.score, r.base_score, r.n_known) for r in ngram_lm.score(docs, kind, chunk_bytes=chunk_bytes).collect()}

    whole = scores(10**9, 1_000)
    for other in (scores(40_000, 1_000), scores(40_000, 1)):
        assert other.keys() == whole.keys() and all(np.allclose(other[i], whole[i], rtol=1e-9) for i in whole)


def test_language_model_counts_beyond_32_bits():
    w, p = np.array([3, 5], np.uint64), np.array([7], np.uint64)
    rows = pa.concat_tables([ngram_lm._dealt_rows(k, range(1), w, None, np.array([2_500_000_000, 1]), p, np.array([2_500_000_000])) for k in (11, 12)])
    got = ngram_lm._add_up(rows).to_pylist()
    assert [(r["owner"], ngram_lm._unpacked(r["word_all"], 2).tolist(), ngram_lm._unpacked(r["pair_ml"], 1).tolist()) for r in got[:2]] == [(k, [5_000_000_000, 2], [5_000_000_000]) for k in (11, 12)]
    assert (got[2]["n_all"], got[2]["v_all"], got[2]["n_ml"]) == (5_000_000_002, 2, 5_000_000_002)


def test_language_model_exchanges_fewer_rows_than_chunks_squared(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "ONE_LEVEL", 10)
    rows = docs.select("doc_id", "text").withColumn("chunk", ngram_lm.COUNTING * ngram_lm._KIND + F.pmod("doc_id", F.lit(64)))
    for n in (16, 64):
        counts, totals, parts = ngram_lm._exchange(rows.withColumn("chunk", ngram_lm.COUNTING * ngram_lm._KIND + F.pmod("doc_id", F.lit(n))), n)
        assert parts == math.isqrt(n) and counts.count() == n * parts and totals.count() == n


def test_language_identification_is_learned(spark, sf_dir, odd, empty):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in queries.op5_language_id(spark, sf_dir).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    model = langid.fit(empty)
    got = langid.identify(odd, model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} == {"und"}
    model = langid.fit(spark.createDataFrame([("the cat", "en"), ("die Katze", "de"), ("x", None)], "text string, lang string"))
    rows = langid.identify(spark.createDataFrame([("the cat sat",), ("123 !!",), (None,)], "text string"), model).collect()
    assert [r.lang_pred for r in rows] == ["en", "und", "und"]


def test_decontamination_tolerates_substitutions(spark, sf_dir, texts, odd, empty):
    rng = np.random.default_rng(5)
    item = [f"w{i}" for i in range(40)]
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    filler = [f"f{i}" for i in rng.integers(0, 10**6, 300)]
    rows = [(1, " ".join([*filler[:50], *item, *filler[50:]])), (2, " ".join([*filler, *changed])), (3, " ".join(filler)), (4, " ".join([*filler[:9], *item[:9], *filler[9:40]])), (5, ", ".join(item).upper())]
    marks = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), marks, block_bytes=20).collect()}
    assert set(found) == {(1, 7), (2, 7), (5, 7)}
    assert (found[1, 7].word_start, found[1, 7].word_end, found[1, 7].n_equal) == (50, 90, 40) and found[2, 7].n_equal >= 34
    assert decontaminate.contaminated(odd, marks).count() == 0 and decontaminate.contaminated(empty, marks).count() == 0 and decontaminate.contaminated(odd, marks.limit(0)).count() == 0
    whole = {i for i, t in texts.items() for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if " ".join(words(b.text)) in " ".join(words(t))}
    assert whole and whole <= {r.doc_id for r in queries.op6_decontaminate(spark, sf_dir).collect()}


def test_decontamination_of_repeated_words_is_quick():
    block = decontaminate._block(np.array([1, 2, 3]), pa.array(["a " * 400, "a b " * 200, " ".join(f"w{i}" for i in range(7))]))
    start = time.perf_counter()
    found = decontaminate._search([5], pa.array(["a " * 20_000]), block)
    assert [(i, k, e) for i, k, _, _, e, _ in found] == [(5, 1, 400)] and time.perf_counter() - start < 1
    start = time.perf_counter()
    found = decontaminate._search([6], pa.array(["a b " * 10_000 + " ".join(f"w{i}" for i in range(7))]), block)
    assert [(i, k, e) for i, k, _, _, e, _ in found] == [(6, 2, 400), (6, 3, 7)] and time.perf_counter() - start < 10


@pytest.mark.parametrize("piece", [50, 1_000_000])
def test_decontamination_of_poor_vocabularies_equals_all_windows(monkeypatch, piece):
    """Texts of two or three words, whose hits are many, against all windows; also an item that only fits one mask."""
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rng = np.random.default_rng(2)
    items = [" ".join(rng.choice(list("ab"), 30)), " ".join(rng.choice(list("abc"), 20)), "a a a a a a a a", "a a a a a a a b c", "a a a a a a a"]
    texts = [" ".join(rng.choice(list("ab"), n)) for n in (3, 8, 13, 40, 90)] + ["a " * 25, " ".join(rng.choice(list("abc"), 60)), ""]
    found = {(i, k): e for i, k, _, _, e, _ in decontaminate._search(list(range(len(texts))), pa.array(texts), decontaminate._block(np.arange(5), pa.array(items)))}
    assert found == {(i, k): n for i, t in enumerate(texts) for k, m in enumerate(items) if (n := plain_overlap(t.split(), m.split()))}


def plain_overlap(got, whole):
    """Equal words of the best window on any diagonal that holds a hit of a mask."""
    best, least = 0, min(13, len(whole))
    for shift in range(-len(whole) + 1, len(got)):
        lo, hi = max(0, shift), min(len(got), shift + len(whole))
        same = np.array([got[x] == whole[x - shift] for x in range(lo, hi)])
        masks = decontaminate.MASKS if len(whole) >= 8 else ("1" * len(whole),)
        spots = [(x, x + len(m)) for m in masks for x in range(hi - lo - len(m) + 1) if all(same[x + y] for y, c in enumerate(m) if c == "1")]
        for a in range(hi - lo) if spots else ():
            for b in range(a + least, hi - lo + 1):
                if 5 * same[a:b].sum() >= 4 * (b - a) and any(a <= x and y <= b for x, y in spots):
                    best = max(best, int(same[a:b].sum()))
    return best


def test_decontamination_finds_each_window_with_a_seed():
    """Against all windows on all diagonals: random copies with a fifth of their words substituted, and runs after a partly copied one."""
    rng = np.random.default_rng(8)
    item = [f"w{i}" for i in range(40)]
    copies = [[w if rng.random() > 0.2 else f"o{rng.integers(10**6)}" for w in item] for _ in range(600)]
    copies += [[w if i > 12 or i in (0, 2, 5, 8, 9, 10, 12, 1) else f"o{i}" for i, w in enumerate(item)], ["x", *item[1:12]], ["x", *item[1:11], "y", "z"]]
    block = decontaminate._block(np.array([7, 8]), pa.array([" ".join(item), " ".join(item[:13])]))
    texts = [" ".join(["a b c", *c, "d e f"]) for c in copies]
    found = {(i, k): (a, b, e) for i, k, a, b, e, _ in decontaminate._search(list(range(len(texts))), pa.array(texts), block)}
    expected = {(i, k): n for i, t in enumerate(texts) for k, whole in ((7, item), (8, item[:13])) if (n := plain_overlap(t.split(), whole))}
    assert {key: e for key, (_, _, e) in found.items()} == expected
    assert all(b - a >= 13 and 5 * e >= 4 * (b - a) for a, b, e in found.values())


def test_toxicity_learns_terms_and_pairs(spark, odd, empty):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(["insult"] * insult + ["group"] * group + [f"n{k}" for k in rng.integers(0, 4000, 30)]), int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.where("doc_id < 900"))
    held = toxicity.score(df.where("doc_id >= 900"), model, out_col="p").collect()
    assert sum((r.p >= 0.5) == r.label for r in held) >= 0.97 * len(held)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(df.limit(0))).count() == len(ODD)


def test_toxicity_query(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in queries.op7_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def plain_numbers(t):
    t = t or ""
    ws = WORD.findall(t)
    seen = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {j for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_against_plain_counts(spark, sf_dir, texts, odd, empty):
    found = queries.op8_quality_rules(spark, sf_dir).collect()
    for r in found:
        want = plain_numbers(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r for r in found if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.95 * len(good)
    small = spark.createDataFrame([(1, "a b c a b c"), (2, "a a a a"), (3, "é\x0bé x"), (4, "l 1\nl 1\n \n \nl 1")], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.measures(small).collect()}
    for i, t in ((1, "a b c a b c"), (2, "a a a a"), (3, "é\x0bé x"), (4, "l 1\nl 1\n \n \nl 1")):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_numbers(t)
    assert rules.judge(odd).count() == len(ODD) and rules.judge(empty).count() == 0


def test_estimation_finds_the_bad_rule(spark):
    rng, rows = np.random.default_rng(2), Counter()
    for _ in range(4000):
        y = rng.random() < 0.7
        rows[tuple(int(v) for v in (np.where(rng.random(len(rules.RULES)) < np.array([0.6] + [0.9] * (len(rules.RULES) - 1)), 1, -1) * (1 if y else -1)))] += 1
    names = ", ".join(f"vote_{n} int" for n, _, _ in rules.RULES)
    model = rules.estimate(spark.createDataFrame([(*k, n) for k, n in rows.items()], f"{names}, n long"))
    assert abs(model.good - 0.7) < 0.05 and model.on_good[0] < 0.75 and min(model.on_good[1:]) > 0.8


def test_url_rules(spark):
    rows = [(1, "http://A.Example.org/es/x"), (1, "http://A.Example.org/es/x"), (2, "https://example.org/en/12?q"), (3, "x://org"), (4, None), (5, "nothing"), (6, "http://b.com/de/"), (7, "http://com/fr/a#b"), (8, "http://notexample.org/es/"), (9, "http://org./")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark)).collect())
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "example.org/es/", "block"), (1, "example.org/es/", "block"), (2, "example.org/en/1", "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, "com/de/", "block"), (7, "com/fr/", "allow"), (8, "org/", "allow"), (9, None, "allow")]
    assert got[3][1:3] == ("org", "") and got[4][1:3] == ("", "") and got[0][1:3] == ("a.example.org", "/es/x")
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0 and urls.judge(pages, urls.rule_table(spark).limit(0)).count() == len(rows)


def test_salted_rules_give_the_same(spark, sf_dir, monkeypatch):
    pages, book = spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.rule_table(spark)
    plain = sorted(map(str, urls.judge(pages, book).collect()))
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert sorted(map(str, urls.judge(pages, book).collect())) == plain


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_url_join_is_on_the_short_prefix_alone(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_RULES", broadcast)
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = urls.judge(pages, urls.rule_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join LeftOuter" in line]
    assert len(joins) == 1 and "short" in joins[0] and "digest" not in joins[0]


def test_url_ties_nulls_and_long_urls(spark):
    book = spark.createDataFrame([("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("allow", "a.org", "/x/y"), (None, "a.org", "/x/y/z"), ("block", None, "/"), ("block", "b.org", "")], "action string, rule_host string, rule_path string")
    long = "/" + "p" * 200_000
    pages = spark.createDataFrame([(1, "h://a.org/x"), (None, "h://a.org/x/y/z"), (3, f"h://{'s.' * 300}a.org{long}"), (4, "h://b.org?q"), (None, None), (5, "")], "page_id long, url string")
    got = sorted(((r.page_id or 0, r.host[-5:], len(r.path), r.rule, r.verdict) for r in urls.judge(pages, book).collect()), key=str)
    assert got == sorted([(1, "a.org", 2, "a.org/x", "block"), (0, "a.org", 6, "a.org/x/y", "allow"), (3, "a.org", len(long), None, "allow"), (4, "b.org", 0, "b.org", "block"), (0, "", 0, None, "allow"), (5, "", 0, None, "allow")], key=str)


def test_url_rows_repeated_often_come_back(spark):
    pages = spark.range(0, 30_000, 1, 6).select(F.lit(1).alias("page_id"), F.lit("h://example.org/es/").alias("url"))
    assert [tuple(r) for r in urls.judge(pages, urls.rule_table(spark)).groupBy("page_id", "rule", "verdict").count().collect()] == [(1, "example.org/es/", "block", 30_000)]


def plain_groups(rows, percent, size):
    sets = {}
    for i, t in rows:
        ws = words(t)
        sets[i] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(a), root(b)
            label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(n, seed, edits):
    """A group of near copies whose links form chains, beside exact copies and other texts."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(n):
        ws = list(base)
        for k in rng.integers(0, len(ws), rng.integers(0, edits)):
            ws[k] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(ws)))
    rows += [(n + i, rows[0][1].upper()) for i in range(5)] + [(n + 5 + i, f"other text {i} " + " ".join(f"o{x}" for x in rng.integers(0, 10**6, 30))) for i in range(20)]
    return rows + [(n + 30, "two words"), (n + 31, "Two  words"), (n + 32, ""), (n + 33, None)]


@pytest.mark.parametrize("small, docs_in_block", [(64, 400), (3, 25), (10**9, 400)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, small, docs_in_block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "DEAL", 10)
    monkeypatch.setattr(neardup, "TILE_DOCS", docs_in_block)
    monkeypatch.setattr(neardup, "MOST_ROUNDS", 1)
    rows = near_copies(120, 4, 14)
    want = plain_groups(rows, 85, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_on_the_tables(spark, sf_dir, texts):
    want = plain_groups(list(texts.items()), 85, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_near_duplicates(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df, found = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    place = [found.columns.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in place) for r in found.fetchall()), key=str)


def test_near_duplicates_on_odd_rows(odd, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(odd).collect())
    assert got[(6, 1, 1, False)] == 2 and got[(1, 1, 1, True)] == 1 and got[(2, 0, 2, True)] == 1 and sum(got.values()) == len(ODD)
    assert neardup.groups(empty).count() == 0


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    far = []
    for keep in (950, 850, 500):
        both = np.concatenate([np.sort(h), np.sort(np.concatenate([h[:keep], rng.integers(0, 2**64, 1000 - keep, dtype=np.uint64)]))])
        a, b = neardup.odd_sketches(neardup.minhashes(both, np.array([0, 1000, 2000])))
        far.append(int(np.bitwise_count(a ^ b).sum()))
    assert far == sorted(far) and far[0] < neardup.sketch_limit(85) < far[2]


def test_url_rules_of_all_path_lengths_match(spark):
    path = "/" + "".join(f"{i:04d}" for i in range(300))
    rules_ = spark.createDataFrame([("block", f"h{n}.org", path[:n]) for n in range(1, 1201)], "action string, rule_host string, rule_path string")
    pages = spark.createDataFrame([(n, f"https://h{n}.org{path}") for n in range(1, 1201, 50)] + [(0, "https://h1200.org/0")], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages, rules_).collect()}
    assert verdicts == {0: "allow"} | {n: "block" for n in range(1, 1201, 50)}


def test_items_below_eight_words_are_found_whole(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "lone"), (3, "Seven words that stand here for it"), (4, ""), (5, None), (6, "the quick brown fox jumped")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see The quick, brown fox jumps over"), (2, "the quick brown cat jumps"), (3, "a lone wolf, lone"), (4, "seven words that stand here for it"), (5, "seven words that stand there for it"), (6, "lonely"), (7, None)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.word_end - r.word_start, r.n_equal) for r in decontaminate.overlaps(docs, items).collect()}
    assert found == {(1, 1): (5, 5), (3, 2): (1, 1), (4, 3): (7, 7)}


def test_labelled_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, t) for t in "cab"] * 50 + [(2, None), (2, "x"), (3, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 5)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in labelled(docs, labels, "quality", F.lit(True), 10, 1).collect()) == [(1, "a", 1), (2, "", 0)]
