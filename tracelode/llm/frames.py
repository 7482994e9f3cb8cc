"""Small DataFrame helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import removed, written

__all__ = ["bounded_batches", "id_remainder", "narrow", "removed", "written"]

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows, with Arrow batches to Python of at most 8 MB.

    Spark's 64 MB are held several times over (JVM, pipe, worker, result) by each of an executor's tasks, and reused
    workers keep what they once had; a smaller size that the session already has is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH).rstrip("b") == str(64 << 20):
        conf.set(_BATCH, str(8 << 20))
    return df


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with null texts as empty ones; all other columns are left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
