"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, per_class: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class.

    The rows are the first by a hash of their id, so the choice is the same on every run.  Labels
    other than 0 and 1, and null ids, teach nothing; an id that is labelled twice counts once, with
    the larger label, and of rows that repeat an id the smallest text counts, so that rows are bounded as ids
    are.  ``usable`` is a condition on ``doc_id``.
    """
    one = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable)
    one = one.groupBy("doc_id").agg(F.max("label").alias("label"))
    pick = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = reduce(DataFrame.union, pick)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
