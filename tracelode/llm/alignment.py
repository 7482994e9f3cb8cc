"""Operator 12: alignment of two tokenizers over exactly deduplicated texts.

Rows are shuffled by their full text, so that each distinct text is tokenised and aligned once; its pair counts are
weighted by how many rows hold it, and its measures are joined back to all of them.

A text with a space before it is cut into tokens by a byte-level BPE (A) and by a sentencepiece model (B, which adds that
space).  Where tokens of both end, a group ends.  An A and a B token are linked if their bytes overlap; as each link's
overlap lies between two neighbouring token ends of either side, the links of a batch are the stretches between its sorted ends.

Scale: texts are shuffled once, as aggregation keys (copies are folded before the exchange); after it only token ids move.
Pair counts are added up within tasks, then by pair.  Scoring needs every pair's count at every text: counts above a power
of two, chosen so that at most ``MOST_SENT`` pairs reach it, are broadcast as sorted arrays (about 17 bytes a pair); rarer pairs
go by a join from the texts that hold them, so no pair is lost and the broadcast is bounded.  Measures are joined by
the text's SHA-256; texts with over a thousandth of all rows, at most a thousand of them, are joined by broadcast.

Defined results: null and empty texts, and texts whose tokens' bytes are not those of the text, have zeros everywhere and
an empty ``groups_sha256``, and no pair counts; repeated rows count as often as they are there and get equal results;
null ids are like others; extra columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .frames import bounded_batches, written
from .text import chunks, tidy

#: Pairs whose counts are broadcast, at most.
MOST_SENT = 1_000_000
#: Token ids of A that are aligned at once.
SLICE_TOKENS = 400_000
#: Words, and characters in them, that a worker remembers before it begins anew; its memory does not grow with the input.
MEMO, MEMO_CHARS = 200_000, 10_000_000
#: A single space between two characters that no tokenizer takes for white space.
_INK = re.compile("[^\\s\u180e]")
_CUT = re.compile(f"(?<={_INK.pattern}) (?={_INK.pattern})")
#: A text is joined by broadcast if more than one row in so many holds it.
HOT_SHARE = 1_000

_CODED = "digest binary, m long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"
_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@dataclass(frozen=True)
class Tokenizers:
    """The two vocabularies; ``model`` is the bytes of a sentencepiece file."""

    a: tokens.ByteLevel
    model: bytes

    @staticmethod
    def load(a_path: str, pattern: str, b_path: str) -> Tokenizers:
        return Tokenizers(tokens.ByteLevel.load(a_path, pattern), tokens.read_model(b_path))


@dataclass(frozen=True)
class Ends:
    """Tokens of several texts one after the other: ids, where each token's bytes end, and where each text's tokens begin."""

    ids: np.ndarray
    end: np.ndarray
    first: np.ndarray


def _laid_out(ids: list[np.ndarray], size: np.ndarray) -> Ends:
    flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    return Ends(flat, np.cumsum(size[flat]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]))


def linked(a: Ends, b: Ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the A token and of the B token of each link, in order, and where each text's links begin."""
    ends = np.union1d(a.end, b.end)
    total = np.concatenate([[0], a.end])[a.first]
    return np.searchsorted(a.end, ends), np.searchsorted(b.end, ends), np.searchsorted(ends, total, "right")


def _group_texts(a: Ends, b: Ends, name: list[str], base: int) -> tuple[list[str], np.ndarray]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``, and their number."""
    common = np.intersect1d(a.end, b.end, assume_unique=True)
    ga, gb = np.searchsorted(common, a.end), np.searchsorted(common, b.end)
    last_a, last_b = np.isin(a.end, common, assume_unique=True), np.isin(b.end, common, assume_unique=True)
    until_b = np.searchsorted(gb, np.arange(len(common) + 1))  # B tokens in earlier groups
    until_a = np.searchsorted(ga, np.arange(len(common) + 1))
    code = np.empty(len(ga) + len(gb), np.int64)
    code[np.arange(len(ga)) + until_b[ga]] = 2 * a.ids + last_a
    code[np.arange(len(gb)) + until_a[gb + 1]] = base + 2 * b.ids + last_b
    said = list(map(name.__getitem__, code.tolist()))
    first = (a.first + b.first).tolist()
    total = np.concatenate([[0], a.end])[a.first]
    return ["".join(said[i:j])[:-1] for i, j in zip(first, first[1:])], np.diff(np.searchsorted(common, total, "right"))


class Aligner:
    """Aligns texts word by word, and remembers words: in a large text most are seen again.

    A text is cut at each single space between two characters that are not white space.  Both tokenizers begin a token
    there whatever stands around it: the pattern of A begins a match at such a space, and no piece of B has a space after another
    character (``load`` of a model with such pieces is refused).  So ids, groups and links of a text are those of its words.
    """

    def __init__(self, used: Tokenizers):
        self.a, self.b = tokens.byte_encoder(used.a), tokens.piece_encoder(used.model)
        self.a_token, self.b_token = used.a.tokens, tokens.piece_bytes(used.model)
        if any(b" " in t.lstrip(b" ") for t in self.b_token):
            raise ValueError("pieces with a space after another character")
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_token, self.b_token))
        self.name = [f"{i}{c}" for i in range(len(self.a_token)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b_token)) for c in ",;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.text: list[str] = []
        self.ids = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        self.count = [[np.zeros(0, np.int64)] for _ in range(5)]  # A and B tokens, groups, links, and whether both give back the word

    def _a_ids(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of words, each after a space, and how many: ``plain`` ones, without white space at their ends, are encoded together."""
        together, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if plain:
            together = tokens.encode(self.a, " " + " ".join(plain), specials=False).astype(np.int64)
            ends = np.cumsum(np.fromiter((len(w.encode()) for w in plain), np.int64, len(plain)) + 1)
            n = np.diff(np.searchsorted(np.cumsum(self.a_size[together]), ends) + 1, prepend=0)
        alone = [tokens.encode(self.a, f" {w}", specials=False).astype(np.int64) for w in odd]
        return np.concatenate([together, *alone]), np.concatenate([n, np.array([len(x) for x in alone], np.int64)])

    def _gives_back(self, fresh: list[str], b_lists: list[list[int]], b_ids: np.ndarray) -> np.ndarray:
        """Whether B's tokens of each word are the bytes of a space and the word; mostly all are, which one comparison says."""
        if b"".join(map(self.b_token.__getitem__, b_ids.tolist())) == f" {' '.join(fresh)}".encode():
            sizes = np.add.reduceat(self.b_size[b_ids], np.cumsum([0] + [len(y) for y in b_lists[:-1]])) if all(b_lists) else None
            if sizes is not None and np.array_equal(sizes, np.fromiter((len(w.encode()) + 1 for w in fresh), np.int64, len(fresh))):
                return np.ones(len(fresh), bool)
        return np.array([b"".join(map(self.b_token.__getitem__, y)) == b" " + w.encode() for y, w in zip(b_lists, fresh)], bool)

    def learn(self, plain: list[str], odd: list[str]) -> None:
        """Tokenise and align words that are not known yet."""
        fresh = [*plain, *odd]
        a_ids, n_a = self._a_ids(plain, odd)
        b_lists = self.b.encode(fresh, num_threads=1)
        b_ids = np.fromiter(chain.from_iterable(b_lists), np.int64)
        same = self._gives_back(fresh, b_lists, b_ids)
        n_b = np.fromiter(map(len, b_lists), np.int64, len(b_lists))
        ends = lambda ids, n, size: Ends(x := ids[np.repeat(same, n)], np.cumsum(size[x]), np.concatenate([[0], np.cumsum(n[same])]))
        a, b = ends(a_ids, n_a, self.a_size), ends(b_ids, n_b, self.b_size)  # of the words that can be aligned
        said, groups = _group_texts(a, b, self.name, 2 * len(self.a_token))
        n_groups, n_links, text = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64), [""] * len(fresh)
        n_groups[same], n_links[same] = groups, np.diff(linked(a, b)[2])
        for i, t in zip(np.flatnonzero(same).tolist(), said):
            text[i] = t
        self.known.update(zip(fresh, range(len(self.text), len(self.text) + len(fresh))))
        self.text += text
        self.chars += sum(map(len, fresh))
        for held, new in zip((*self.ids, *self.count), (a_ids, b_ids, n_a, n_b, n_groups, n_links, same.astype(np.int64))):
            held[:] = [np.concatenate([*held, new])]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]], list[str]]:
        """Texts that both give back (their places), their counts (A, B, groups, links), ids of A and of B, and digests of their groups."""
        parts = [_CUT.split(t) for t in texts]
        flat = [w for p in parts for w in p]
        if len(self.known) > MEMO or self.chars > MEMO_CHARS:
            self.forget()
        if fresh := [w for w in dict.fromkeys(flat) if w not in self.known]:
            # only where a text begins or ends can a word have white space at its ends
            edges = {p[0] for t, p in zip(texts, parts) if not _INK.match(t[0])} | {p[-1] for t, p in zip(texts, parts) if not _INK.match(t[-1])}
            self.learn([w for w in fresh if w not in edges], [w for w in fresh if w in edges])
        word = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        n_a, n_b, n_groups, n_links, same = (c[0] for c in self.count)
        keep = np.flatnonzero(np.minimum.reduceat(same[word], first[:-1])) if len(texts) else np.zeros(0, np.int64)
        counts = [np.add.reduceat(c[word], first[:-1])[keep] if len(texts) else c[:0] for c in (n_a, n_b, n_groups, n_links)]
        ids = []
        for held, n in zip(self.ids, (n_a, n_b)):
            start, size = np.cumsum(n) - n, n[word]
            all_ = held[0][np.repeat(start[word] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            at = np.concatenate([[0], np.cumsum(size)])[first]
            ids.append([all_[at[i] : at[i + 1]] for i in keep.tolist()])
        code = word.tolist()
        digest = [hashlib.sha256(";".join(map(self.text.__getitem__, code[first[i] : first[i + 1]])).encode()).hexdigest() for i in keep.tolist()]
        return keep, counts, ids, digest


@lru_cache(maxsize=1)
def aligner(used: Tokenizers) -> Aligner:
    """One for each worker, which keeps its words for later tasks."""
    return Aligner(used)


def code(texts: DataFrame, used: Tokenizers) -> DataFrame:
    """Token ids (little-endian, 16 or 32 bits), group text's digest and counts of each (digest, m, text); texts without tokens are left out."""
    sent = texts.sparkSession.sparkContext.broadcast(used)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = aligner(sent.value)
        for batch in tidy(batches):
            for part in chunks(batch, 2):
                keep, counts, ids, digest = mine.align(part.column("text").to_pylist())
                stay = part.take(pa.array(keep))
                packed = [pa.array([x.astype(t).tobytes() for x in side], pa.binary()) for side, t in zip(ids, _id_types(mine.a_size, mine.b_size))]
                yield pa.RecordBatch.from_arrays(
                    [stay.column("digest"), stay.column("m"), *(pa.array(c) for c in counts), pa.array(digest, pa.string()), *packed],
                    ["digest", "m", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"],
                )

    return bounded_batches(texts).select("digest", "m", "text").mapInArrow(align, _CODED)


def _id_types(a_size: np.ndarray, b_size: np.ndarray) -> tuple[str, str]:
    return tuple("<u2" if len(x) <= 1 << 16 else "<u4" for x in (a_size, b_size))


def _slices(batch: pa.RecordBatch, a_size: np.ndarray, b_size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of coded texts, with the (A id, B id) of each link as one number, and where each text's links begin."""
    n = np.asarray(batch.column("n_a"))
    at, i = np.concatenate([[0], np.cumsum(n)]), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_TOKENS, "right")) - 1)
        a, b = (_laid_out([np.frombuffer(x.as_buffer(), t) for x in batch.column(c).slice(i, j - i)], size) for c, size, t in zip("ab", (a_size, b_size), _id_types(a_size, b_size)))
        x, y, first = linked(a, b)
        yield i, j, a.ids[x] * len(b_size) + b.ids[y], first
        i = j


def _sizes(used: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(t) for t in x], np.int64) for x in (used.a.tokens, tokens.piece_bytes(used.model)))


def pair_counts(coded: DataFrame, used: Tokenizers) -> DataFrame:
    """(pair, a_id, b_id, count, best): how many links of all rows hold each id pair, and whether it is its B id's most frequent."""
    sizes = coded.sparkSession.sparkContext.broadcast(_sizes(used))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            m = np.asarray(batch.column("m"))
            for i, j, key, first in _slices(batch, *sizes.value):
                order = np.argsort(key, kind="stable")
                ordered = key[order]
                begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                weight = np.repeat(m[i:j], np.diff(first))[order]
                yield pa.RecordBatch.from_arrays([pa.array(ordered[begin]), pa.array(np.add.reduceat(weight, begin))], ["pair", "c"])

    n_b = len(_sizes(used)[1])
    summed = coded.select("m", "n_a", "a", "b").mapInArrow(tally, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("count"))
    named = summed.select("pair", F.expr(f"cast(pair div {n_b} AS int)").alias("a_id"), (F.col("pair") % n_b).cast("int").alias("b_id"), "count")
    return named.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def _sent_from(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs' counts reach."""
    size = {r.e: r.n for r in pairs.groupBy((F.length(F.bin("count")) - 1).alias("e")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    left, e = 0, 64
    while e > 0 and left + size.get(e - 1, 0) <= most:
        e -= 1
        left += size.get(e, 0)
    return 1 << e


def scored(coded: DataFrame, pairs: DataFrame, used: Tokenizers, most_sent: int = MOST_SENT) -> DataFrame:
    """Measures of each coded text; ``pairs`` is a written table of ``pair_counts``."""
    context = coded.sparkSession.sparkContext
    least = _sent_from(pairs, most_sent)
    known = pairs.where(F.col("count") >= F.lit(min(least, 2**63 - 1))).select("pair", "count", "best").toArrow()
    order = np.argsort(np.asarray(known["pair"]), kind="stable")
    heavy = tuple(np.asarray(known[c])[order] for c in ("pair", "count", "best"))
    sent = context.broadcast((*_sizes(used), *heavy))
    all_sent = least == 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size, pair, count, best = sent.value
        pair, count, best = np.append(pair, -1), np.append(count, 0), np.append(best, False)  # the last row stands for all others
        for batch in tidy(batches):
            sums, bests, rare = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for i, j, key, first in _slices(batch, a_size, b_size):
                at = np.searchsorted(pair[:-1], key)
                at[pair[at] != key] = len(pair) - 1
                sums.append(np.add.reduceat(count[at], first[:-1]))
                bests.append(np.add.reduceat(best[at].astype(np.int64), first[:-1]))
                if not all_sent:
                    other = np.flatnonzero(at == len(pair) - 1)
                    cut = np.searchsorted(other, first)
                    rare.extend(key[other[p:q]] for p, q in zip(cut, cut[1:]))
            left = pa.array([x.tolist() for x in rare] if rare else [[]] * batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("digest", "m", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), pa.array(np.concatenate(bests)), pa.array(np.concatenate(sums)), left], schema=out)

    kinds = "digest binary, m long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>"
    out = pa.schema([(c.split()[0], {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}.get(c.split()[1], pa.list_(pa.int64()))) for c in kinds.split(", ")])
    found = coded.mapInArrow(measure, kinds)
    if all_sent:
        return found.drop("rare")
    found = written(found, "measures")
    rare = found.select("digest", F.explode("rare").alias("pair")).groupBy("digest", "pair").agg(F.count("*").alias("k"))
    rest = rare.join(pairs.where(F.col("count") < F.lit(least)).select("pair", "count", "best"), "pair").groupBy("digest").agg(F.sum(F.col("k") * F.col("count")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("_best"))
    more = found.drop("rare").join(rest, "digest", "left")
    return more.withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0))}).drop("_sum", "_best")


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, m, text) of each distinct text that is not empty; the exchange is by the full text."""
    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("m"))
    return texts.select(_digest(F.col("text")).alias("digest"), "m", "text")


def _digest(text: Column) -> F.Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def measures(docs: DataFrame, used: Tokenizers, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    coded = written(code(distinct_texts(docs, text_col), used), "coded")
    pairs = written(pair_counts(coded, used), "pairs")
    found = written(scored(coded, pairs, used, most_sent), "aligned")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col) != "", _digest(F.col(text_col))).alias("digest"))
    total = found.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    values = F.struct(*_MEASURES, "groups_sha256")
    is_hot = F.col("m") * HOT_SHARE > total
    hot = F.broadcast(found.where(is_hot).select(F.col("digest").alias("_hot"), values.alias("_h")))  # fewer than HOT_SHARE rows
    cold = found.where(~is_hot).select(F.col("digest").alias("_cold"), values.alias("_c"))
    # rows that need no join, or have had it, go to places of their own
    alone = F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    met = rows.join(hot, F.col("digest") == F.col("_hot"), "left").withColumn("_key", F.when(F.col("_h").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(alone))
    met = met.join(cold, F.col("_key") == F.col("_cold"), "left").withColumn("_v", F.coalesce("_h", "_c"))
    return met.select("doc_id", *(F.coalesce(F.col(f"_v.{c}"), F.lit(0)).cast("long").alias(c) for c in _MEASURES), F.coalesce("_v.groups_sha256", F.lit("")).alias("groups_sha256"))
