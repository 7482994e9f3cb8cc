"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import bpe, decontaminate, neardup, pii, toxicity
from tracelode.llm.frames import written
from tracelode.llm.queries import toxicity_model, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half."""
    docs = docs.select(*COLUMNS)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), out_col="_toxicity")
    return scored.where("_toxicity < 0.5").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``_row``, a hash of id and text, so that rows are told apart whatever ids repeat or are null."""
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("_row"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the smallest id.

    Rows are documents of their own even if they share an id or have none (null ids come last); of rows that repeat both id
    and text one stays.
    """
    keyed = _keyed(docs)
    found = neardup.groups(keyed.select(F.col("_row").alias("doc_id"), "text"), percent=80, size=5)
    found = written(found.select(F.col("doc_id").alias("_row"), "component_id").distinct(), "groups")
    ids = keyed.groupBy("_row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    met = written(found.join(ids, "_row"), "group-ids")
    best = met.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("best")).select("best._row")
    gone = met.join(best, "_row", "left_anti").select("_row")  # by row, so that no large group meets in one task
    marks = written(gone.withColumn("repeated", F.lit(False)).union(met.where("n > 1").join(gone, "_row", "left_anti").select("_row", F.lit(True))), "near-copies")
    alone = keyed.join(marks.select("_row"), "_row", "left_anti")
    repeated = keyed.join(marks.where("repeated").select("_row"), "_row", "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.select(*COLUMNS).union(repeated.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed.select(F.col("_row").alias("doc_id"), "text"), benchmark)
    found = written(found.select(F.col("doc_id").alias("_row")), "contaminated")
    return keyed.join(found, "_row", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark such as ``<EMAIL>`` for each span of personal data."""
    clean = pii.redact(pii.find_spans(docs.select(*COLUMNS), out_col="_spans"), spans_col="_spans")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids; ``text`` is what the ids decode to."""
    coded = bpe.round_trip(docs.select(*COLUMNS), vocabulary())
    return coded.select("doc_id", F.col("decoded").cast("string").alias("text"), "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", tokenise),
]

#: SQL cannot express the learned and hashed stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
