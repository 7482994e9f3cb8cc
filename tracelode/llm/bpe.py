"""Operator 1: byte-level BPE encoding and decoding.

Two tiers.  A pre-token (one match of the vocabulary's split pattern) is first looked up whole in
a minimal perfect hash of the vocabulary: one array probe and one comparison, for all distinct
pre-tokens of a slice at once.  A pre-token that is not in the vocabulary is merged by rank with a
heap over a linked list of its bytes, O(n log n) also for very long pre-tokens.

Scale: one map over the rows, no shuffle.  The tables are broadcast; their size is that of the
vocabulary file, which ``load_vocabulary`` checks.  Tasks work on slices of about a million characters of text.

Defined results: a null text counts as empty and gives an empty id list; null id lists decode to
empty bytes; repeated rows give repeated results; a column that already has the output name is
replaced, all other columns stay.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches
from .text import tidy

#: Vocabularies above this many tokens are refused, because they are broadcast.
MAX_VOCABULARY = 2_000_000
#: Places for merged pre-tokens that a worker remembers (of up to ``MEMO_IDS`` ids); its memory does not grow with its input.
MEMO, MEMO_IDS = 1 << 18, 8
#: Pre-tokens of fewer bytes get their first heaps all at once.
SHORT = 256
_AFTER, _BEFORE = tuple(range(1, SHORT + 1)), tuple(range(-1, SHORT - 1))
SLICE_CHARS = 1_000_000


def _h64(keys: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array([k.decode("latin-1") for k in keys] + [""], dtype=object), categorize=False)[:-1]


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(n)).astype(np.int64)


@dataclass
class PerfectHash:
    """A minimal perfect hash by displacement: n keys fill exactly n slots."""

    displacement: np.ndarray
    slots: np.ndarray  # of each slot, the index of its key

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        n = len(h)
        assert len(np.unique(h)) == n, "keys must have distinct 64-bit hashes"
        buckets = max(1, n // 4)
        home = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        groups = np.split(order, np.cumsum(np.bincount(home, minlength=buckets))[:-1])
        shift, slots = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
        for b in sorted(range(buckets), key=lambda b: -len(groups[b])):
            keys, d = groups[b], 1
            if len(keys) < 2:
                break
            while shift[b] == 0:
                tries = np.arange(d, d + 64)
                at = _slot(h[keys][None, :], tries[:, None], n)
                for row in np.flatnonzero((slots[at] < 0).all(1)):
                    if len(set(at[row].tolist())) == len(keys):
                        shift[b], slots[at[row]] = tries[row], keys
                        break
                d += 64
        singles = [b for b in range(buckets) if len(groups[b]) == 1]
        for b, at in zip(singles, np.flatnonzero(slots < 0)):  # the rest of the slots, named outright
            shift[b], slots[at] = -int(at) - 1, groups[b][0]
        return cls(shift, slots)

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash the index of the only key that it can be."""
        d = self.displacement[(h % np.uint64(len(self.displacement))).astype(np.int64)]
        return self.slots[np.where(d < 0, -d - 1, _slot(h, np.maximum(d, 0), len(self.slots)))]


@dataclass(eq=False)
class Vocabulary:
    """Tokens by rank, their perfect hash and the split pattern."""

    tokens: list[bytes]
    ids: np.ndarray
    perfect: PerfectHash
    pattern: str

    def ranks(self) -> dict[bytes, int]:
        return dict(zip(self.tokens, self.ids.tolist()))


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file (base64 token and rank on each line) and build its perfect hash."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"{len(rows)} tokens; at most {MAX_VOCABULARY} are broadcast")
    tokens = [base64.b64decode(a) for a, _ in rows]
    return Vocabulary(tokens, np.array([int(b) for _, b in rows], np.int32), PerfectHash.build(_h64(tokens)), pattern)


def merge(piece: bytes, ranks: dict[bytes, int], heap: list[int] | None = None, shift: int = 0) -> list[int]:
    """Ids of one pre-token: the lowest-ranked, then leftmost adjacent pair is merged until none is left.

    A heap entry packs (rank, start, end of the pair) into one integer, with ``shift`` bits for each place; ``heap`` has those of
    all pairs of bytes.  An entry is stale, and skipped, unless its start is still a segment whose neighbour ends where the entry says.
    """
    n, get = len(piece), ranks.get
    if heap is None:
        shift = n.bit_length()
        heap = [((r << shift | i) << shift) | (i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
    low = (1 << shift) - 1
    end, before = (list(_AFTER[:n]), list(_BEFORE[:n])) if n <= SHORT else (list(range(1, n + 1)), list(range(-1, n - 1)))
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i = entry >> shift & low
        j = end[i]
        if not j or j >= n or end[j] != entry & low:
            continue
        stop = end[j]
        end[i], end[j] = stop, 0  # an end of 0 marks a segment that is gone
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                push(heap, ((r << shift | i) << shift) | end[stop])
        if i and (r := get(piece[before[i] : stop])) is not None:
            push(heap, ((r << shift | before[i]) << shift) | stop)
    out, i = [], 0
    while i < n:
        j = end[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Encoder:
    """Encodes slices of texts inside a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.ranks, self.split = vocabulary, vocabulary.ranks(), regex.compile(vocabulary.pattern).findall
        self.tokens = np.array([*vocabulary.tokens, b""], dtype=object)[:-1]
        self.pair = np.full(1 << 16, -1, np.int64)  # ranks of tokens of two bytes
        for token, i in zip(vocabulary.tokens, vocabulary.ids.tolist()):
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = i
        self.memo_key, self.memo_n = np.full(MEMO, None, object), np.zeros(MEMO, np.int8)
        self.memo_ids, self.memo_used = np.zeros((MEMO, MEMO_IDS), np.int32), np.zeros(MEMO, bool)

    def _merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens that are not in the vocabulary; first heaps of short ones are sorted lists, made for all at once."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[list[int]] = [[]] * len(pieces)
        for k in np.flatnonzero(size >= SHORT).tolist():
            out[k] = merge(pieces[k], self.ranks)
        short = np.flatnonzero(size < SHORT)
        size, some = size[short], [pieces[k] for k in short.tolist()]
        data = np.frombuffer(b"".join(some), np.uint8).astype(np.int64)
        which = np.repeat(np.arange(len(some)), size)
        place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        rank = np.full(len(data), -1, np.int64)
        rank[:-1] = self.pair[data[:-1] << 8 | data[1:]]
        open_ = np.flatnonzero((rank >= 0) & (place < size[which] - 1))
        which, place, rank = which[open_], place[open_], rank[open_]
        shift = SHORT.bit_length() - 1
        keys = np.sort(which << 40 | rank << 2 * shift | place << shift | (place + 2))  # ranks of MAX_VOCABULARY fit below bit 40
        at = np.searchsorted(keys, np.arange(len(some) + 1) << 40).tolist()
        heaps, ranks = (keys & ((1 << 40) - 1)).tolist(), self.ranks
        for k, piece, i, j in zip(short.tolist(), some, at, at[1:]):
            out[k] = merge(piece, ranks, heaps[i:j], shift)
        return out

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct pre-tokens and the number of ids of each."""
        h, keys = _h64(pieces), np.array([*pieces, b""], dtype=object)[:-1]
        at = self.v.perfect.find(h)
        known = self.tokens[at] == keys
        rest = np.flatnonzero(~known)
        slot = ((h[rest] >> np.uint64(32)) % np.uint64(MEMO)).astype(np.int64)
        hit = self.memo_key[slot] == keys[rest]
        missed = rest[~hit]
        made = self._merged([pieces[k] for k in missed.tolist()])
        count = np.ones(len(pieces), np.int64)
        count[rest[hit]] = self.memo_n[slot[hit]]
        count[missed] = n = np.fromiter(map(len, made), np.int64, len(made))
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        flat[first[known]] = self.v.ids[at[known]]
        flat[np.repeat(first[missed] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = np.fromiter(chain.from_iterable(made), np.int32, int(n.sum()))
        for k in range(MEMO_IDS):
            more = hit & (count[rest] > k)
            flat[first[rest[more]] + k] = self.memo_ids[slot[more], k]
        free = (n <= MEMO_IDS) & ~self.memo_used[slot[~hit]]  # what was found since a place was last wanted stays there
        self.memo_used[slot[~hit]] = False
        self.memo_used[slot[hit]] = True
        keep = np.flatnonzero(free)
        slot, one = np.unique(slot[~hit][keep], return_index=True)  # one for each place
        kept = missed[keep[one]]
        self.memo_key[slot], self.memo_n[slot] = keys[kept], count[kept]
        for k in range(MEMO_IDS):
            more = count[kept] > k
            self.memo_ids[slot[more], k] = flat[first[kept[more]] + k]
        return flat, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the number of ids of each text."""
        found = [self.split(t) for t in texts]
        codes, distinct = pd.factorize(np.array([x for f in found for x in f] + [""], dtype=object)[:-1])
        n_words = np.array([len(f) for f in found], np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        flat, count = self._pieces([x.encode() for x in distinct])
        each = count[codes]
        first = (np.cumsum(count) - count)[codes]
        inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        total = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(n_words)])]
        return flat[np.repeat(first, each) + inside], np.diff(total)


@lru_cache(maxsize=1)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One for all tasks of a worker, so that merged pre-tokens are remembered between them."""
    return Encoder(vocabulary)


class Decoder:
    """Bytes of token ids inside a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.table: list[bytes] = [b""] * (int(vocabulary.ids.max()) + 1 if len(vocabulary.ids) else 0)
        for token, i in zip(vocabulary.tokens, vocabulary.ids.tolist()):
            self.table[i] = token

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


def _encoded(encoder: Encoder, batch: pa.Array) -> pa.ListArray:
    """Id lists of a batch of texts, made slice by slice."""
    batch, flat, size = pc.fill_null(batch, ""), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, j in _slices(pc.utf8_length(batch).to_numpy(zero_copy_only=False), SLICE_CHARS):
        ids, n = encoder.encode(batch.slice(i, j - i).to_pylist())
        flat.append(ids)
        size.append(n)
    at = np.concatenate([[0], np.cumsum(np.concatenate(size))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))


def _decoded(decoder: Decoder, batch: pa.ListArray) -> pa.Array:
    return pa.array([b"" if (x := ids.values) is None else decoder.decode(x.to_numpy(zero_copy_only=False)) for ids in batch], pa.binary())


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """Add ``out_col``, the array of token ids of each whole text."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(sent.value)
        for batch in tidy(batches):
            yield _encoded(encoder, batch)

    return bounded_batches(df).withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the bytes that the token ids stand for (cast to string for the text)."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(sent.value)
        for batch in tidy(batches):
            yield _decoded(decoder, batch)

    return bounded_batches(df).withColumn(out_col, text(F.col(ids_col)))


def round_trip(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of the ids in one pass, so that a task has one Python worker with one vocabulary."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _encoder(sent.value), Decoder(sent.value)
        for batch in tidy(batches):
            ids = _encoded(encoder, batch)
            yield pa.StructArray.from_arrays([ids, _decoded(decoder, ids)], ["ids", "decoded"])

    rest = [c for c in df.columns if c not in (ids_col, decoded_col)]
    coded = bounded_batches(df).select(*(F.col(f"`{c}`") for c in rest), both(F.col(text_col)).alias("_coded"))
    return coded.select(*(F.col(f"`{c}`") for c in rest), F.col("_coded.ids").alias(ids_col), F.col("_coded.decoded").alias(decoded_col))
