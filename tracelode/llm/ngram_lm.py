"""Operator 4: language-model scoring by deleted interpolation.

The probability of a token is a mixture of its maximum-likelihood bigram estimate, its unigram estimate
and the uniform one.  The bigram's weight depends on how often the context was seen (buckets by powers
of two).  Learning documents are split: counts come from most of them ("counting" documents), and the
weights are learned by expectation-maximisation on counts of the others ("tuning" documents).

Tokens are the lower-cased (A-Z) words of a text and one end mark; a start mark is the first context.
Unigrams are told apart by 64-bit hashes, bigrams by 48-bit ones.

Scale: nothing global is broadcast.  Documents are dealt into chunks of about ``CHUNK_BYTES`` of text by
a hash, as many as the corpus needs.  Each chunk sends its distinct n-grams once, packed by part of the
hash space; each part adds up its n-grams over all chunks and sends every chunk the counts of just
those n-grams that it has.  So what moves is the text twice and each chunk's distinct n-grams once.
Up to ``ONE_LEVEL`` chunks there are as many parts as chunks.  Beyond, chunks are put together to about
the square root of their number of bundles, and parts likewise to coarse parts; a bundle's n-grams of a
coarse part are first added up and then dealt to its fine parts, so n chunks exchange about 2 n sqrt(n)
packed rows and not n * n.  Only totals and histograms of fixed size reach the driver.

Defined results: null and empty texts are one end mark; a null id is as the empty text in the split;
repeated rows count, and repeat (rows that repeat both id and text share a chunk); without learning
documents every probability is 1 over the vocabulary's size plus one; extra columns are left behind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, removed, written
from .text import chunks, mix, split

CHUNK_BYTES = 12_000_000
ONE_LEVEL = 1_000  # chunks
HELD_OUT, TUNING, COUNTING = 0, 1, 2
_KIND = 1 << 40  # a chunk's number is kind * _KIND + its number among that kind
_END, _START = np.uint64(0x3C79AC492BA7B653), np.uint64(0x1C69B3F74AC4AE35)
BUCKETS = 48  # of context frequency, by powers of two
_STEP, _LOW, _BINS = 8, -64, 1024  # histogram bins: log2 in steps of 1/8; bin 0 is zero


def _bins(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        at = np.floor((np.log2(x) - _LOW) * _STEP)
    return np.where(x > 0, np.clip(at, 1, _BINS - 1), 0).astype(np.int64)


def _centres() -> np.ndarray:
    out = 2.0 ** ((np.arange(_BINS) + 0.5) / _STEP + _LOW)
    out[0] = 0.0
    return out


def _tokens(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, the context of each, and the first token of each text."""
    parts = []
    batch = pa.RecordBatch.from_arrays([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], ["t"])
    for part in chunks(batch, 0):
        w = split(part.column(0))
        n = len(w.first) - 1
        seq = np.full(len(w.start) + n, _END, np.uint64)
        seq[np.arange(len(w.start)) + w.row] = w.hashes()
        parts.append((seq, np.diff(w.first) + 1))
    seq = np.concatenate([*(p[0] for p in parts), np.zeros(0, np.uint64)])
    size = np.concatenate([*(p[1] for p in parts), np.zeros(0, np.int64)])
    first = np.concatenate([[0], np.cumsum(size)])
    context = np.empty_like(seq)
    context[1:] = seq[:-1]
    context[first[:-1]] = _START
    return seq, context, first


def _pairs(seq: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0xD1342543DE82EF95) + seq) >> np.uint64(16)


def _dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted hashes by (part, hash), and where each part starts in it."""
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _six(h: np.ndarray) -> bytes:
    """48-bit hashes in six bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _packed(n: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight if one needs more."""
    return n.astype("<u8" if len(n) and n.max() >= 2**32 else "<u4").tobytes()


def _unpacked(body: bytes | None, size: int) -> np.ndarray:
    """``size`` packed counts; nothing stands for zeros."""
    if body is None:
        return np.zeros(size, np.int64)
    return np.frombuffer(body, "<u8" if len(body) == 8 * size else "<u4").astype(np.int64)


#: Grams of an owner (a chunk or a bundle) in a part: hashes, counts in tuning and in counting documents.
_GRAMS = "owner long, part int, words binary, word_tun binary, word_ml binary, pairs binary, pair_ml binary"
#: What a part sends back: for the grams of an owner, in their order, counts over the whole corpus; or totals.
_COUNTS = "owner long, part int, word_all binary, word_ml binary, pair_ml binary, n_all long, v_all long, n_ml long, tuning binary"


def _dealt_rows(owner: int, parts: range, words: np.ndarray, word_tun: np.ndarray | None, word_ml: np.ndarray | None, pairs: np.ndarray, pair_ml: np.ndarray | None) -> pa.Table:
    """One row of _GRAMS for each part; grams are sorted within a part."""
    w, at = _dealt(words, len(parts))
    p, pair_at = _dealt(pairs, len(parts))
    words, pairs = words[w], pairs[p]

    def column(n: np.ndarray | None, order: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.array([None if n is None else _packed(n[order[at[k] : at[k + 1]]]) for k in range(len(parts))], pa.binary())

    return pa.table(
        [
            pa.array([owner] * len(parts), pa.int64()), pa.array(parts, pa.int32()),
            pa.array([words[at[k] : at[k + 1]].tobytes() for k in range(len(parts))], pa.binary()), column(word_tun, w, at), column(word_ml, w, at),
            pa.array([_six(pairs[pair_at[k] : pair_at[k + 1]]) for k in range(len(parts))], pa.binary()), column(pair_ml, p, pair_at),
        ],
        ["owner", "part", "words", "word_tun", "word_ml", "pairs", "pair_ml"],
    )


def _extract(parts: int):
    """Distinct n-grams of a chunk; held-out chunks send no counts, others the one count that their kind has."""

    def extract(table: pa.Table) -> pa.Table:
        seq, context, _ = _tokens(table["text"])
        chunk = table["chunk"][0].as_py()
        words, word_n = np.unique(seq, return_counts=True)
        pairs, pair_n = np.unique(_pairs(seq, context), return_counts=True)
        tuning, counting = chunk // _KIND == TUNING, chunk // _KIND == COUNTING
        return _dealt_rows(chunk, range(parts), words, word_n if tuning else None, word_n if counting else None, pairs, pair_n if counting else None)

    return extract


class _Sums:
    """Grams of several owners, each distinct one once, and where each owner's grams are among them."""

    def __init__(self, hashes: list[np.ndarray]):
        self.size = [len(h) for h in hashes]
        self.at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.keys, self.inverse = np.unique(np.concatenate(hashes), return_inverse=True)

    def of(self, k: int) -> np.ndarray:
        return self.inverse[self.at[k] : self.at[k + 1]]

    def add(self, bodies: list[bytes | None]) -> np.ndarray:
        total = np.zeros(len(self.keys), np.int64)
        for k, body in enumerate(bodies):
            if body is not None:
                total[self.of(k)] += _unpacked(body, self.size[k])  # an owner has each gram once
        return total


def _grams(table: pa.Table) -> tuple[_Sums, _Sums]:
    return _Sums([np.frombuffer(x, "<u8") for x in table["words"].to_pylist()]), _Sums([_of_six(x) for x in table["pairs"].to_pylist()])


def _add_up(table: pa.Table) -> pa.Table:
    """Counts of one part: for each owner those of its n-grams, in its order; and one row of totals."""
    owners, part = table["owner"].to_pylist(), table["part"][0].as_py()
    words, pairs = _grams(table)
    tuning_n, ml_n, pair_n = words.add(table["word_tun"].to_pylist()), words.add(table["word_ml"].to_pylist()), pairs.add(table["pair_ml"].to_pylist())
    all_n = tuning_n + ml_n
    tuning = np.bincount(_bins(ml_n), tuning_n, _BINS)

    def send(n: np.ndarray, of: _Sums) -> pa.Array:
        return pa.array([*(_packed(n[of.of(k)]) for k in range(len(owners))), b""], pa.binary())

    last = lambda value, kind: pa.array([*[None] * len(owners), value], kind)
    return pa.table(
        [
            pa.array([*owners, -1], pa.int64()), pa.array([part] * (len(owners) + 1), pa.int32()), send(all_n, words), send(ml_n, words), send(pair_n, pairs),
            last(int(all_n.sum()), pa.int64()), last(int((all_n > 0).sum()), pa.int64()), last(int(ml_n.sum()), pa.int64()), last(tuning.tobytes(), pa.binary()),
        ],
        ["owner", "part", "word_all", "word_ml", "pair_ml", "n_all", "v_all", "n_ml", "tuning"],
    )


def _bundle(coarse: int, fine: int, bundles: int):
    """Adds up the chunks of a bundle in one coarse part, and deals the sums to the fine parts of it."""

    def bundle(table: pa.Table) -> pa.Table:
        g, b = table["part"][0].as_py(), table["owner"][0].as_py() % bundles
        words, pairs = _grams(table)
        tun, ml, pair = words.add(table["word_tun"].to_pylist()), words.add(table["word_ml"].to_pylist()), pairs.add(table["pair_ml"].to_pylist())
        fold = np.uint64(coarse)  # all hashes of a coarse part have one remainder, so the quotients tell them apart
        return _dealt_rows(b, range(g * fine, (g + 1) * fine), words.keys // fold, tun, ml, pairs.keys // fold, pair)

    return bundle


def _unbundle(coarse: int, fine: int):
    """Gives the counts that a bundle got from the fine parts to the chunks of the bundle."""

    def unbundle(left: pa.Table, right: pa.Table) -> pa.Table:
        right, (words, pairs) = right.sort_by("part"), _grams(left)

        def counts(keys: np.ndarray, column: str) -> np.ndarray:
            order, at = _dealt(keys // np.uint64(coarse), fine)
            out = np.empty(len(keys), np.int64)
            out[order] = np.concatenate([_unpacked(x, n) for x, n in zip(right[column].to_pylist(), np.diff(at).tolist())])
            return out

        rows = range(left.num_rows)
        all_n, ml_n, pair_n = counts(words.keys, "word_all"), counts(words.keys, "word_ml"), counts(pairs.keys, "pair_ml")
        sent = [pa.array([_packed(n[of.of(k)]) for k in rows], pa.binary()) for n, of in ((all_n, words), (ml_n, words), (pair_n, pairs))]
        none = [pa.nulls(left.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.table([left["owner"].combine_chunks(), left["part"].combine_chunks(), *sent, *none], ["owner", "part", "word_all", "word_ml", "pair_ml", "n_all", "v_all", "n_ml", "tuning"])

    return unbundle


def _exchange(dealt: DataFrame, chunks_: int) -> tuple[DataFrame, DataFrame, int]:
    """Counts for each chunk, totals (owner -1), and into how many parts a chunk's counts are dealt."""
    texts = dealt.select("chunk", "text").groupBy("chunk")
    if chunks_ <= ONE_LEVEL:
        counts = written(texts.applyInArrow(_extract(chunks_), _GRAMS).groupBy("part").applyInArrow(_add_up, _COUNTS), "lm-counts", compression="zstd")
        return counts.where("owner >= 0"), counts.where("owner = -1"), chunks_
    root = math.isqrt(chunks_ - 1) + 1
    grams = written(texts.applyInArrow(_extract(root), _GRAMS), "lm-grams", compression="zstd").withColumn("bundle", F.pmod("owner", F.lit(root)))
    sums = grams.groupBy("part", "bundle").applyInArrow(_bundle(root, root, root), _GRAMS)
    fine = written(sums.groupBy("part").applyInArrow(_add_up, _COUNTS), "lm-fine", compression="zstd")
    back = fine.where("owner >= 0").withColumn("coarse", F.expr(f"part DIV {root}"))
    counts = grams.groupBy("part", "bundle").cogroup(back.withColumn("bundle", F.col("owner")).groupBy("coarse", "bundle")).applyInArrow(_unbundle(root, root), _COUNTS)
    counts = written(counts, "lm-counts", compression="zstd")
    removed(grams)
    return counts, fine.where("owner = -1"), root


@dataclass
class Weights:
    """Totals of the counts, and mixture weights: of the unigram, and of the bigram by context bucket."""

    n_all: int
    v_all: int
    n_ml: int
    unigram: float
    bigram: np.ndarray

    def lower(self, c1: np.ndarray) -> np.ndarray:
        return self.unigram * c1 / max(self.n_ml, 1) + (1 - self.unigram) / (self.v_all + 1)


def learn_weight(ratios: np.ndarray, n: np.ndarray, steps: int = 40) -> float:
    """Expectation-maximisation for the weight w of ``w * r + (1 - w)`` over a histogram of ratios r."""
    w, total = 0.5, float(n.sum())
    if not total:
        return 0.5
    for _ in range(steps):
        w = float((n * (w * ratios / (w * ratios + 1 - w))).sum() / total)
        w = min(max(w, 1e-4), 1 - 1e-4)
    return w


def _lookup(left: pa.Table, right: pa.Table, parts: int) -> tuple[np.ndarray, ...]:
    """For each token of a chunk: count among all, counting count, of its context, of the pair; first tokens."""
    seq, context, first = _tokens(left["text"])
    right = right.sort_by("part")

    def counts(keys: np.ndarray, *columns: str) -> list[np.ndarray]:
        distinct, inverse = np.unique(keys, return_inverse=True)
        order, at = _dealt(distinct, parts)
        out = []
        for c in columns:
            by_hash = np.empty(len(distinct))
            by_hash[order] = np.concatenate([_unpacked(x, n) for x, n in zip(right[c].to_pylist(), np.diff(at).tolist())])
            out.append(by_hash[inverse])
        return out

    c_all, c_ml = counts(seq, "word_all", "word_ml")
    (pair,) = counts(_pairs(seq, context), "pair_ml")
    of_context = np.empty(len(seq))
    of_context[1:] = c_ml[:-1]
    of_context[first[:-1]] = c_ml[first[1:] - 1]  # as many starts as ends
    return c_all, c_ml, of_context, pair, first


def _bucket(of_context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(of_context + 1).astype(np.int64), BUCKETS - 1)


def score(docs: DataFrame, kind: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row.

    ``kind`` says of each row (in terms of ``doc_id``) whether it is held out (0), tunes the weights (1) or is counted (2).
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("kind", kind.cast("long"))
    sizes = {r[0]: r[1] for r in rows.groupBy("kind").agg(F.sum(F.octet_length("text") + 16)).collect()}
    n_chunks = {k: 1 + int(v // chunk_bytes) for k, v in sizes.items()}
    deal = F.lit(1)
    for k, n in n_chunks.items():
        deal = F.when(F.col("kind") == k, F.lit(n)).otherwise(deal)
    dealt = rows.select("doc_id", "text", (F.col("kind") * _KIND + F.pmod(F.xxhash64("doc_id", "text"), deal)).alias("chunk"))
    counts, totals, parts = _exchange(dealt, max(1, sum(n_chunks.values())))
    counts = counts.select(F.col("owner").alias("chunk"), "part", "word_all", "word_ml", "pair_ml")
    n_all, v_all, n_ml = (int(x or 0) for x in totals.agg(F.sum("n_all"), F.sum("v_all"), F.sum("n_ml")).first())

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.float64) for x in table["tuning"]], axis=0)
        return pa.table([pa.array([total.tobytes()], pa.binary())], ["tuning"])

    some = totals.groupBy(F.pmod("part", F.lit(64)).alias("g")).applyInArrow(add, "tuning binary").collect()
    tuning = np.sum([np.frombuffer(bytes(r[0]), np.float64) for r in some], axis=0) if some else np.zeros(_BINS)
    unigram = learn_weight(_centres() / max(n_ml, 1) * (v_all + 1), tuning) if n_ml else 1e-4
    plain = Weights(n_all, v_all, n_ml, unigram, np.zeros(BUCKETS))

    def tune(left: pa.Table, right: pa.Table) -> pa.Table:
        _, c1, of_context, pair, _ = _lookup(left, right, parts)
        seen = of_context > 0
        ratio = pair[seen] / of_context[seen] / plain.lower(c1[seen])
        n = np.bincount(_bucket(of_context[seen]) * _BINS + _bins(ratio), minlength=BUCKETS * _BINS)
        at = np.flatnonzero(n)
        return pa.table([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["cell", "n"])

    own = F.col("chunk").between(TUNING * _KIND, (TUNING + 1) * _KIND - 1)
    cells = dealt.where(own).groupBy("chunk").cogroup(counts.where(own).groupBy("chunk")).applyInArrow(tune, "cell long, n long")
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros(BUCKETS * _BINS)
    grid[found["cell"].to_numpy()] = found["n"].to_numpy()
    bigram = np.array([learn_weight(_centres(), g) if g.any() else 0.0 for g in grid.reshape(BUCKETS, _BINS)])
    model = Weights(n_all, v_all, n_ml, unigram, bigram)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        c_all, c1, of_context, pair, first = _lookup(left, right, parts)
        base = np.log10((c_all + 0.1) / (model.n_all + 0.1 * (model.v_all + 1)))
        w = np.where(of_context > 0, model.bigram[_bucket(of_context)], 0.0)
        p = w * pair / np.maximum(of_context, 1) + (1 - w) * model.lower(c1)
        sums = [np.add.reduceat(x, first[:-1]) for x in (base, np.log10(p), (c_all > 0).astype(np.int64))]
        return pa.table(
            [left["doc_id"].combine_chunks(), pa.array(np.diff(first), pa.int64()), pa.array(sums[2], pa.int64()), pa.array([model.n_all] * left.num_rows, pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(judge, schema)
