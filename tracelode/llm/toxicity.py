"""Operator 7: toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased letter and digit runs of a text, hashed to 64 bits.  The machine
is ``w0 + sum w_i + sum_{i<j} <v_i, v_j>``: its factors carry pairs such as an insult with a group
mention, which linear weights miss.  It is fitted with numpy on a bounded sample of labelled rows
(``PER_CLASS`` documents of each class).  Terms in fewer than ``MIN_DOCS`` of them get no weight, and
of the others the ``MAX_TERMS`` that depend most on the label (by chi-squared, ``MIN_CHI2`` or more) do.
The pairwise sum is averaged over the pairs' share of the text by ``1 / sqrt(terms)`` inputs, so a
long text is not toxic for its length alone.

Scale: the sample's term lists are written once; Spark counts and picks the terms, and only those (at most
MAX_TERMS) and each sampled text's share of them come to the driver.  The model is broadcast, scoring is
one map over whole texts.

Defined results: null and empty texts get the score of a text without known terms; without labels
of both classes the score is the share of toxic labels (0 without any).  Repeated rows repeat.
Columns with the output name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, removed, written
from .text import NOT_ALNUM, chunks, split, tidy

PER_CLASS = 4_000
MIN_DOCS = 3
MAX_TERMS = 20_000
MIN_CHI2 = 8.0
FACTORS = 6
EPOCHS = 12


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text (flat), and the first of each text."""
    w = split(texts, space=NOT_ALNUM)
    row, h = w.row, w.hashes()
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.searchsorted(row[fresh], np.arange(len(texts) + 1))


@dataclass
class Machine:
    keys: np.ndarray  # sorted hashes of the known terms
    w0: float
    w: np.ndarray
    v: np.ndarray

    def known(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of known terms (flat) and the text of each."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        return at[hit], row[hit]

    def logits(self, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(row, self.w[at], n)
        size = np.maximum(np.bincount(row, minlength=n), 1)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            pairs += np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n)
        return self.w0 + linear + 0.5 * pairs / np.sqrt(size)

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.logits(*self.known(*terms(texts)), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def strong_terms(lists: DataFrame, n: int, pos: float) -> np.ndarray:
    """Sorted hashes of the terms that depend most on the label, of (terms, label) rows of which ``pos`` have label 1."""
    counts = lists.select(F.explode("terms").alias("term"), "label").groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("both"))
    expected = F.col("n") * pos
    chi2 = (F.col("both") - expected) * (F.col("both") - expected) / (expected * (1 - pos) * F.greatest(1 - F.col("n") / n, F.lit(1 / n)))
    found = counts.where(F.col("n") >= min(MIN_DOCS, max(1, n // 20))).select("term", chi2.alias("chi2")).where(F.col("chi2") >= MIN_CHI2)
    return np.sort(found.orderBy(F.desc("chi2"), "term").limit(MAX_TERMS).toArrow()["term"].to_numpy().view(np.uint64))


def train(keys: np.ndarray, at: np.ndarray, ptr: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Fit on the places of documents' known terms among ``keys`` by AdaGrad on the logistic loss; classes weigh the same."""
    n = len(y)
    pos = float(y.mean()) if n else 0.0
    prior = float(np.log(max(pos, 1e-6) / max(1 - pos, 1e-6))) if n else -30.0
    if not len(keys) or pos in (0.0, 1.0):
        return Machine(np.zeros(0, np.uint64), prior, np.zeros(0), np.zeros((0, FACTORS)))
    m, rng = len(keys), np.random.default_rng(seed)
    model = Machine(keys, 0.0, np.zeros(m), rng.normal(0, 0.02, (m, FACTORS)))
    gw, gv, g0, rate, decay = np.full(m, 1e-2), np.full((m, FACTORS), 1e-1), 1e-2, 0.15, 2e-3
    weight = np.where(y > 0, 0.5 / pos, 0.5 / (1 - pos))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for batch in np.array_split(order, max(1, n // 128)):
            size = np.diff(ptr)[batch]
            r = np.repeat(np.arange(len(batch)), size)
            a = at[np.repeat(ptr[batch] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            z = model.logits(a, r, len(batch))
            d = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            g = np.bincount(a, d[r], m)
            used = np.flatnonzero(np.bincount(a, minlength=m))
            g = g[used] + decay * model.w[used] / len(order)
            gw[used] += g * g
            model.w[used] -= rate * g / np.sqrt(gw[used])
            share = (d / np.sqrt(np.maximum(size, 1)))[r]
            for f in range(FACTORS):
                x = model.v[a, f]
                s = np.bincount(r, x, len(batch))
                g = np.bincount(a, share * (s[r] - x), m)[used] + decay * model.v[used, f]
                gv[used, f] += g * g
                model.v[used, f] -= 0.3 * rate * g / np.sqrt(gv[used, f])
            g0 += d.sum() ** 2
            model.w0 -= rate * d.sum() / np.sqrt(g0)
    return model


def fit(sample: DataFrame, seed: int = 7) -> Machine:
    """Fit on (text, label) rows; the caller bounds their number (see ``samples.labelled``)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for part in chunks(batch, 0):
                h, first = terms(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64))), part.column(1), part.column(2)], ["terms", "label", "doc_id"])

    lists = written(sample.select("text", "label", "doc_id").mapInArrow(collect, "terms array<long>, label int, doc_id long"), "toxicity-terms")
    n, pos = lists.agg(F.count("*"), F.avg("label")).first()
    keys = strong_terms(lists, n, pos) if n and 0 < pos < 1 else np.zeros(0, np.uint64)
    sent = sample.sparkSession.sparkContext.broadcast(Machine(keys, 0.0, np.zeros(0), np.zeros((0, FACTORS))))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            size = np.asarray(batch.column(0).value_lengths()).astype(np.int64)
            at, row = sent.value.known(np.asarray(batch.column(0).flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(size)]))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at, pa.int32())), batch.column(1), batch.column(2)], ["known", "label", "doc_id"])

    found = lists.mapInArrow(known, "known array<int>, label int, doc_id long").toArrow().combine_chunks().sort_by("doc_id")
    removed(lists)
    places = found["known"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    size = np.asarray(places.value_lengths()).astype(np.int64)
    return train(keys, np.asarray(places.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(size)]), found["label"].to_numpy().astype(float), seed)


def score(df: DataFrame, model: Machine, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Add ``out_col``, the probability that the whole text is toxic."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidy(batches):
            parts = [sent.value.score(part.column(0)) for part in chunks(pa.RecordBatch.from_arrays([texts], ["t"]), 0)]
            yield pa.array(np.concatenate([*parts, np.zeros(0)]))

    return bounded_batches(df).withColumn(out_col, toxic(F.col(text_col)))
