"""The registered queries of this subpackage: each applies one operator to its whole table.

``QUERIES`` holds callables of (spark, sf_dir); ``ORACLES`` holds DuckDB SQL where SQL can say the same.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, langid, merkle, neardup, ngram_lm, packing, pii, quality, rules, tokens, toxicity, urls
from .frames import id_remainder, narrow
from .samples import labelled

#: Where the public vocabulary lies is a parameter: the file's name, found by the tokenizers package.
VOCABULARY = "byte_bpe_50k.tiktoken"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.load_vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(narrow(_table(spark, sf_dir, "documents"), "doc_id", "text"), vocabulary()).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(_table(spark, sf_dir, "documents"), "doc_id", "text")
    vectors = quality.word_vectors(docs)
    sample = labelled(docs, _table(spark, sf_dir, "labels"), "quality", id_remainder(F.col("doc_id"), 3) != 1, quality.PER_CLASS, 2)
    scored = quality.score(docs, quality.fit(sample, vectors), out_col="score")
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(narrow(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    spans = F.col("pii_spans")
    counts = [pii.count(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(spans, pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"), pii.digest(spans).alias("spans"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = id_remainder(F.col("doc_id"), 10)
    kind = F.when(fold == 0, ngram_lm.HELD_OUT).when(fold == 1, ngram_lm.TUNING).otherwise(ngram_lm.COUNTING)
    scored = ngram_lm.score(_table(spark, sf_dir, "documents"), kind)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    found = langid.identify(narrow(docs, "doc_id", "text"), model)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Machine:
    usable = id_remainder(F.col("doc_id"), 5) != 0
    return toxicity.fit(labelled(docs, _table(spark, sf_dir, "labels"), "toxic", usable, toxicity.PER_CLASS, 7))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(_table(spark, sf_dir, "documents"), "doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), out_col="score")
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"), percent=85, size=3)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    plain = [F.col(c) for c in merkle.COLUMNS]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.row_digest([*plain[:-1], lower]))
    found = merkle.manifest(docs.select("doc_id", "source", merkle.row_digest(plain).alias("digest"), tampered.alias("tampered")))
    folded = merkle.fold(F.coalesce("tampered", "digest"), F.col("path"))
    texts = {"leaf": F.col("digest"), "subroot": F.col("subroot"), "root": F.col("root"), "folded_root": folded}
    proof = F.sha2(merkle.proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256")
    return found.select("doc_id", *(merkle.text_of(c).alias(n) for n, c in texts.items()), proof, (folded == F.col("root")).alias("verified"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    used = alignment.Tokenizers.load(public_tokenizers.path(BYTE_LEVEL), public_tokenizers.PATTERN, public_tokenizers.path(PIECES))
    return alignment.measures(_table(spark, sf_dir, "documents"), used)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokens.ByteLevel.load(public_tokenizers.path(BYTE_LEVEL), public_tokenizers.PATTERN)
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_pii": op3_pii,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filters": op9_url_filters,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_best_fit_packing": op13_best_fit_packing,
}

#: Words of a text, and the rules' numbers from them; votes are lists in the order of the rules.
_RULE_NUMBERS = r"""
        texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS l FROM texts),
        windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM words WHERE len(w) >= 3),
        found AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows),
        repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM found, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY r),
        numbers AS (
            SELECT doc_id, r, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_distinct(w)) AS n_distinct_words, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[|]')) AS n_bars, len(regexp_extract_all(text, '!')) AS n_bangs
            FROM words LEFT JOIN repeats USING (r)),
"""
_VOTES = "[" + ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in rules.RULES) + "]"
_N_RULES = len(rules.RULES)
#: The model is a list: the share of good texts, then each rule's accuracy on good and on bad ones.
_POSTERIOR = "1 / (1 + exp(-(ln(m[1] / (1 - m[1])) + " + " + ".join(
    f"CASE v[{k}] WHEN 1 THEN ln(m[{1 + k}] / (1 - m[{1 + _N_RULES + k}])) WHEN -1 THEN ln((1 - m[{1 + k}]) / m[{1 + _N_RULES + k}]) ELSE 0 END" for k in range(1, _N_RULES + 1)) + ")))"
_SHARE = f"least(greatest((coalesce(sum({{x}}) FILTER (v[{{k}}] = {{y}}), 0) + 8) / (coalesce(sum({{x}}) FILTER (v[{{k}}] <> 0), 0) + 10), {rules.ACCURACY[0]}), {rules.ACCURACY[1]})"
_NEXT = ", ".join(
    ["least(greatest(sum(n * p) / sum(n), 0.05), 0.95)"]
    + [_SHARE.format(x=x, y=y, k=k) for x, y in (("n * p", 1), ("n * (1 - p)", -1)) for k in range(1, _N_RULES + 1)])

ORACLES: dict[str, str] = {
    "op8_quality_rules": f"""
        WITH RECURSIVE {_RULE_NUMBERS}
        votes AS (SELECT *, {_VOTES} AS v FROM numbers),
        patterns AS (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM votes GROUP BY v),
        steps(step, m, done) AS (
            SELECT 0, list_transform(range({1 + 2 * _N_RULES}), lambda x: CAST(0.8 AS DOUBLE)), FALSE
            UNION ALL SELECT step + 1, now, list_max(list_transform(list_zip(now, m), lambda z: abs(z[1] - z[2]))) < 1e-4 FROM (
                SELECT step, m, [{_NEXT}] AS now FROM (SELECT step, m, v, n, {_POSTERIOR} AS p FROM steps, patterns WHERE step < {rules.ITERATIONS} AND NOT done) GROUP BY step, m)),
        last AS (SELECT m FROM steps ORDER BY step DESC LIMIT 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND p >= 0.5 AS kept
        FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed, {_POSTERIOR} AS p FROM votes, last)
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE crcs AS (
            SELECT DISTINCT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, byte:
                list_reduce(range(8), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295), 4294967295) AS crc FROM documents WHERE doc_id IS NOT NULL),
        fields AS (
            SELECT doc_id, source, text, list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda a, b: a || b) AS head FROM documents),
        leaves AS (
            SELECT f.doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
            FROM fields f LEFT JOIN crcs c ON c.doc_id = f.doc_id),
        ranked AS (
            SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
        nodes(level, g, idx, n, digest) AS (
            SELECT 0, g, idx, n, leaf FROM ranked
            UNION ALL SELECT level + 1, g, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, g, idx // 16, n),
        tops AS (SELECT level, g, digest AS subroot FROM nodes WHERE n = 1),
        over(level, idx, n, digest) AS (
            SELECT 0, g, (SELECT count(*) FROM tops), subroot FROM tops
            UNION ALL SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM over WHERE n > 1 GROUP BY level, idx // 16, n),
        steps AS (
            SELECT level, g, idx, n, digest FROM nodes WHERE n > 1
            UNION ALL SELECT t.level + o.level, t.g, o.idx, o.n, o.digest FROM tops t, over o WHERE o.n > 1 AND o.idx // 16 = t.g // CAST(16 ** (o.level + 1) AS BIGINT)),
        path AS (
            SELECT r.g, r.idx AS leaf_idx, s.level, s.idx % 16 AS slot, CASE WHEN s.level < t.level THEN (r.idx // CAST(16 ** s.level AS BIGINT)) % 16 ELSE (r.g // CAST(16 ** (s.level - t.level) AS BIGINT)) % 16 END AS own, s.digest
            FROM ranked r JOIN tops t USING (g) JOIN steps s ON s.g = r.g AND (s.level >= t.level OR s.idx // 16 = r.idx // CAST(16 ** (s.level + 1) AS BIGINT))),
        proofs AS (
            SELECT g, leaf_idx, level, min(own) AS own, coalesce(string_agg(digest, '' ORDER BY slot) FILTER (slot < own), '') AS low, coalesce(string_agg(digest, '' ORDER BY slot) FILTER (slot > own), '') AS high
            FROM path GROUP BY g, leaf_idx, level),
        folded(g, idx, level, digest) AS (
            SELECT g, idx, 0, coalesce(tampered, leaf) FROM ranked
            UNION ALL SELECT f.g, f.idx, f.level + 1, sha256(low || digest || high) FROM folded f JOIN proofs p ON p.g = f.g AND p.leaf_idx = f.idx AND p.level = f.level),
        ends AS (SELECT g, idx, arg_max(digest, level) AS folded_root FROM folded GROUP BY g, idx),
        said AS (SELECT g, leaf_idx AS idx, sha256(string_agg(low || high, '' ORDER BY level)) AS proof_sha256 FROM proofs GROUP BY ALL),
        top AS (SELECT digest AS root FROM over WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM ranked JOIN tops USING (g) JOIN ends USING (g, idx) LEFT JOIN said USING (g, idx), top
    """,
    "op10_near_duplicates": r"""
        WITH RECURSIVE split_words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle
            FROM split_words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, root) AS (SELECT a, a FROM edges UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.doc_id),
        labels AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
    """,
    "op9_url_filters": r"""
        WITH rules(action, rule_host, rule_path) AS (VALUES
            ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        cut AS (
            SELECT page_id, row_number() OVER () AS row_id,
                CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id, row_id,
                translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut),
        fits AS (
            SELECT row_id, action, rule_host || rule_path AS rule,
                row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC, action DESC) AS k
            FROM parts JOIN rules
                ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
        FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (row_id)
    """,
}
