"""The pipeline's stages on the smallest tables, each held against its operator or a plain version."""

import pytest

import corpus_pipeline
from tracelode.llm import pii

from .test_operators import plain_groups, plain_pii, words


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The rows after each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def test_columns_and_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_do_what_they_say(spark, sf_dir, kept):
    toxic, near, clean, private, coded = kept
    groups = plain_groups([(i, r.text) for i, r in toxic.items()], 80, 5)
    assert set(near) == {i for i, (_, c) in groups.items() if c == i}
    marks = [" ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = {i for i, r in near.items() if any(m in " ".join(words(r.text)) for m in marks)}
    assert holds and not holds & set(clean) and len(set(near) - set(clean) - holds) <= 3
    assert set(private) == set(clean)
    anchors = pii.automaton()
    for i, r in private.items():
        assert not any(plain_pii(r.text).values()) and r.n_chars == len(r.text)
        if not any(pii.find(clean[i].text, anchors).values()):
            assert r.text == clean[i].text
    assert {i: r.text for i, r in coded.items()} == {i: r.text for i, r in private.items()} and all(r.n_tokens == len(r.token_ids) for r in coded.values())


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text without id", "en", "s", 5), (3, "x" * 100_000, None, "s", 1), (4, "same", "en", "s", 4), (4, "same", "en", "s", 4)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 5
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark, sf_dir):
    long = [" ".join(f"w{i}x{k}" for i in range(60)) for k in range(4)]
    near = long[0].replace("w59x0", "other")
    rows = [(7, long[0]), (7, long[1]), (7, long[1]), (3, near), (None, long[2]), (None, long[3]), (None, long[1] + " end"), (9, None), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stay = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert stay.columns == list(corpus_pipeline.COLUMNS)
    want = [(3, near), (7, long[1]), (9, None), (9, ""), (None, None), (None, long[2]), (None, long[3])]
    assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=str) == sorted(want, key=str)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()} == set(rows)


def test_leaks_without_an_id_are_dropped_alone(spark, sf_dir):
    mark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, mark), (None, "a clean text without id"), (1, mark), (1, "a clean text with the same id"), (2, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stay = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert {(r.doc_id, r.text) for r in stay.collect()} == {rows[1], rows[3], rows[4]}
