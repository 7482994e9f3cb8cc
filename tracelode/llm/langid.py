"""Operator 5: language identification.

Multinomial naive Bayes over hashed character n-grams (1 to 3 code points of lower-cased text,
where every run of non-letters is one boundary mark).  Training counts n-grams per language inside
the tasks and adds the counts up with one small shuffle; the log-probability matrix (BUCKETS x
languages, so of bounded size) is broadcast, and batches are scored sparsely in numpy: rows of the
matrix are gathered by bucket and summed per text.

Scale: two maps over the rows; what is shuffled is at most BUCKETS counts per language and task.

Defined results: a null text, an empty one or one without any letter gives ``und`` and score 0; with
nothing to learn from, every text does.  Rows with a null language teach nothing.  Repeated rows
repeat (and count as often as they stand there).  Columns with the output names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches
from .text import chunks, mix, tidy

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: More languages than these are refused, since the matrix is broadcast.
MAX_LANGUAGES = 500
SLICE_BYTES = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text of each, and whether each text has a letter."""
    lower = [t.lower() for t in pc.fill_null(texts, "").to_pylist()]
    size = np.array([len(t) + 2 for t in lower], np.int64)
    points = np.frombuffer("".join(f"\n{t}\n" for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lower), dtype=np.int32), size)
    letter = _letters()[points]
    has = np.zeros(len(lower), bool)
    has[row[letter]] = True
    first = np.zeros(len(points), bool)
    first[np.cumsum(size) - size] = True
    keep = letter | first
    keep[1:] |= letter[:-1]
    c = np.where(letter, points, 0)[keep].astype(np.uint64)
    row, on = row[keep], letter[keep]
    out, rows = [], []
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        good = on[:m].copy() if n == 1 else on[1 : m + 1] | (on[:m] if n == 2 else False)
        for k in range(1, n - 1):
            good &= on[k : k + m]
        at = np.flatnonzero(good)
        h = c[at]
        for k in range(1, n):
            h = h * np.uint64(0x10FFFF) + c[at + k]
        out.append((mix(h + np.uint64(n << 60)) % np.uint64(BUCKETS)).astype(np.int64))
        rows.append(row[at])
    return np.concatenate([*out, np.zeros(0, np.int64)]), np.concatenate([*rows, np.zeros(0, np.int32)]), has


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # BUCKETS x languages: log P(bucket | language)
    prior: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Learn from every row with a language."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in tidy(batches):
            for part in chunks(batch, 0, SLICE_BYTES):
                bucket, row, _ = grams(part.column(0))
                names = part.column(1).dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    own = seen.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    own[:BUCKETS] += np.bincount(bucket[code[row] == k], minlength=BUCKETS)
                    own[BUCKETS] += int((code == k).sum())
                if len(seen) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for name, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = bounded_batches(docs).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    found = rows.mapInArrow(tally, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    count = np.zeros((BUCKETS + 1, len(names)))
    place = {x: k for k, x in enumerate(names)}
    count[found["bucket"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    body = count[:BUCKETS] + smoothing
    return Model(names, np.log(body / body.sum(0)), np.log(np.maximum(count[BUCKETS], 1) / max(count[BUCKETS].sum(), 1)))


def score(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    bucket, row, has = grams(texts)
    n, k = len(texts), len(model.languages)
    if not k:
        return ["und"] * n, np.zeros(n)
    total = np.stack([np.bincount(row, model.weight[:, j][bucket], n) for j in range(k)], 1) + model.prior
    best = total.argmax(1)
    p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())], np.where(has, p, 0.0)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``lang_score``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidy(batches):
            names, p = [], []
            for part in chunks(pa.RecordBatch.from_arrays([texts], ["t"]), 0, SLICE_BYTES):
                a, b = score(part.column(0), sent.value)
                names += a
                p.append(b)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([*p, np.zeros(0)]))], ["lang", "score"])

    at = "_langid"
    while at in df.columns:
        at += "_"
    return bounded_batches(df).withColumn(at, predict(F.col(text_col))).withColumn("lang_pred", F.col(f"{at}.lang")).withColumn("lang_score", F.col(f"{at}.score")).drop(at)
