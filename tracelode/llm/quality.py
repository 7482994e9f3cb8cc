"""Operator 2: a quality classifier on random-indexing word vectors.

Every word has a sparse ternary index vector, drawn from its hash.  A word's own vector is the sum of
the index vectors of its neighbours (``WINDOW`` words on each side) over the whole corpus; words are
hashed into ``ROWS`` rows.  Each word stands once for itself and once for its shape (character
classes with runs folded, such as ``Aa.`` or ``a%``), which has a vector of its own.  A document is
the mean and the spread of its word vectors, the same of its shape vectors, its share of
distinct words and the log of its length.  A two-layer numpy network is fitted on a bounded sample of labelled rows (``PER_CLASS``
of each class), and its temperature is fitted on the part of that sample that training left out.

Scale: one map that adds up vectors inside each task and one small shuffle that sums them by block
of rows (ROWS x DIM numbers a task, whatever its input), then one map that scores.  The vectors are
broadcast: 2 MB.

Defined results: null and empty texts are scored as texts without words; without labels of both
classes the score is the share of label 1 (0.5 without any).  Repeated rows repeat.  A column with
the output name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches
from .text import LOWER, Words, chunks, mix, split, tidy

ROWS, DIM, NONZERO, WINDOW = 1 << 15, 16, 4, 2
PER_CLASS = 6_000
HIDDEN, EPOCHS = 24, 60
_BLOCK = 1 << 11

#: Class of each byte: lower, upper, digit, beyond ASCII, then punctuation marks, each its own.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[:128] = np.arange(128) + 8
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_FEATURES = 4 * DIM + 2


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    seed = mix(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(0x51ED270B))
    return (seed % np.uint64(DIM)).astype(np.int64).reshape(ROWS, NONZERO), np.where(seed >> np.uint64(63), 1.0, -1.0).astype(np.float32).reshape(ROWS, NONZERO)


def _index_matrix() -> np.ndarray:
    place, sign = _index()
    out = np.zeros((ROWS, DIM), np.float32)
    np.add.at(out, (np.arange(ROWS)[:, None], place), sign)
    return out


def _tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, and the vector rows of each word and of its shape."""
    w = split(texts, lower=False)
    cls = _CLASS[w.data]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[w.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = Words(cls[keep], at[w.start], at[w.end], w.first)
    low = Words(LOWER[w.data], w.start, w.end, w.first)
    return w, (low.hashes() % np.uint64(ROWS)).astype(np.int64), (mix(shape.hashes()) % np.uint64(ROWS)).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ROWS x DIM unit vectors, learned from the texts of every row."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, some = _index_matrix(), np.zeros((ROWS, DIM), np.float32), False
        for batch in tidy(batches):
            for part in chunks(batch, 0):
                w, word, shape = _tokens(part.column(0))
                if not len(word):
                    continue
                some, row = True, w.row
                near, around = index[word] + index[shape], np.zeros((len(word), DIM), np.float32)
                for k in range(1, WINDOW + 1):
                    apart = np.flatnonzero(row[k:] != row[:-k])
                    for to, of in ((around[k:], near[:-k]), (around[:-k], near[k:])):
                        to += of
                        to[apart] -= of[apart]
                for key in (word, shape):
                    order = np.argsort(key.astype(np.uint16), kind="stable")
                    sorted_key = key[order]
                    first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
                    total[sorted_key[first]] += np.add.reduceat(around[order], first, axis=0)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(ROWS // _BLOCK), pa.int32()), pa.array([total[i : i + _BLOCK].tobytes() for i in range(0, ROWS, _BLOCK)], pa.binary())], ["block", "vectors"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in tidy(batches):
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(body.as_buffer(), np.float32)
                sums[block] = sums[block] + x if block in sums else x.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["block", "vectors"])

    schema = "block int, vectors binary"
    found = bounded_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(gather, schema).repartition(ROWS // _BLOCK, "block").mapInArrow(add, schema).toArrow()
    out = np.zeros((ROWS, DIM), np.float32)
    for block, body in zip(found["block"].to_pylist(), found["vectors"].to_pylist()):
        out[block * _BLOCK : (block + 1) * _BLOCK] += np.frombuffer(body, np.float32).reshape(_BLOCK, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and standard deviation of word vectors, and of shape vectors; share of distinct words; log of their number."""
    w, word, shape = _tokens(texts)
    size = np.diff(w.first)
    out = np.zeros((len(texts), _FEATURES), np.float32)
    some = np.flatnonzero(size)
    if len(some):
        for k, key in enumerate((word, shape)):
            x = vectors[key]
            mean = np.add.reduceat(x, w.first[:-1][some], axis=0) / size[some, None]
            square = np.add.reduceat(x * x, w.first[:-1][some], axis=0) / size[some, None]
            out[some, 2 * k * DIM : (2 * k + 2) * DIM] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])
    pairs = np.unique(w.row * np.int64(ROWS) + word)
    out[:, -2] = np.bincount(pairs // ROWS, minlength=len(size)) / np.maximum(size, 1)
    out[:, -1] = np.log1p(size)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.logits(pooled(texts, self.vectors).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 11) -> Model:
    """Two layers by Adam on the logistic loss; every fifth row fits the temperature instead."""
    d, rng = x.shape[1], np.random.default_rng(seed)
    x = x.astype(np.float64)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(y) else (np.zeros(d), np.ones(d))
    p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(share / (1 - share)))]
    if not len(y) or y.min() == y.max():
        return Model(vectors, mean, scale, p[0], p[1], np.zeros(HIDDEN), float(p[3]), 1.0)
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    u, t = ((x - mean) / scale)[~held], y[~held]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for b in np.array_split(rng.permutation(len(t)), max(1, len(t) // 64)):
            h = np.tanh(u[b] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[b]) / len(b)
            back = e[:, None] * p[2] * (1 - h * h)
            grads = [u[b].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], e.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    if held.any():
        z, t = model.logits(x[held]), y[held]
        grid = np.geomspace(0.3, 8, 40)
        loss = [np.logaddexp(0, np.where(t > 0, -z, z) / c).mean() for c in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(sample: DataFrame, vectors: np.ndarray, seed: int = 11) -> Model:
    """Fit on (text, label) rows; the caller bounds their number (see ``samples.labelled``)."""
    sent = sample.sparkSession.sparkContext.broadcast(vectors)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for part in chunks(batch, 0):
                x = pooled(part.column(0), sent.value)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1), part.column(2)], ["x", "label", "doc_id"])

    found = sample.select("text", "label", "doc_id").mapInArrow(collect, "x binary, label int, doc_id long").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, _FEATURES)
    return train(x, found["label"].to_numpy().astype(float), vectors, seed)


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """Add ``out_col``, the calibrated probability of label 1 for the whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidy(batches):
            parts = [sent.value.score(part.column(0)) for part in chunks(pa.RecordBatch.from_arrays([texts], ["t"]), 0)]
            yield pa.array(np.concatenate([*parts, np.zeros(0)]))

    return bounded_batches(df).withColumn(out_col, good(F.col(text_col)))
