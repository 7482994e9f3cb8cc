"""Operator 6: benchmark decontamination by spaced-seed hashing.

Fixed masks over windows of consecutive words ignore some positions, so a window still hashes alike
when a word at an ignored position was substituted.  Test hashes (each mask at each position of each
benchmark item) are joined to training hashes inside the map over documents: a sorted array of test
hashes is broadcast and each window of a text is looked up in it.  Text and item are aligned on each
hit's diagonal and compared word by word; an overlap is any window of ``MIN_WORDS`` words or more (or
the whole item, if that is shorter) that holds a hit and is ``MIN_SHARE`` equal.  Unequal words at its
ends are left out of what is reported, down to that length.

Words are lower-cased (A-Z) and stripped of ASCII punctuation, so that a comma does not hide a copy.

Scale: documents are never shuffled and only overlaps leave the map.  The benchmark is taken in
blocks of at most ``BLOCK_BYTES`` of text (one longer item makes a block of its own); each block is
broadcast and is one pass over the documents, so its size never bounds memory.  Equal seeds at
consecutive places are kept as one run, and runs meet as intervals of diagonals, so that a repeated
word does not multiply; pairs of runs and cells of diagonals are handled in pieces of fixed size.

Defined results: null and empty texts and items overlap with nothing; items below ``MIN_WORDS`` words must
be met whole, and those below ``LEAST_ITEM`` words, which no mask fits, are hashed whole and looked up among
the texts' windows of their length; a repeated document row gives repeated overlaps; ``contaminated`` puts all rows
of an id together, those with a null id too; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches
from .text import NOT_ALNUM, chunks, mix, split, tidy

#: Fixed masks: 1 compares the word, 0 ignores it.  Each has eight compared words.
MASKS = ("11111111", "1101110111", "1110101101001", "101101011011")
LEAST_ITEM = min(map(len, MASKS))
MIN_WORDS, MIN_SHARE = 13, 0.8
BLOCK_BYTES = 6_000_000
PIECE = 1_000_000  # pairs of runs, or cells of diagonals, that are handled at once


@dataclass
class Block:
    """Benchmark items as flat word hashes and sorted seed hashes."""

    items: np.ndarray
    first: np.ndarray
    words: np.ndarray
    seeds: np.ndarray  # sorted
    at: np.ndarray  # flat word position where each seed's run begins
    run: np.ndarray  # at how many consecutive places the seed stands
    small: np.ndarray  # a packed bitmap by the low bits of the seeds, which spares most look-ups
    whole: tuple[str, ...]  # masks of the lengths of items that are shorter than all MASKS

    def may_hold(self, seeds: np.ndarray) -> np.ndarray:
        bit = seeds & np.uint64(8 * len(self.small) - 1)
        return (self.small[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _seeds(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the mask at each position where it fits into a text, and those positions."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, one in enumerate(mask):
        if one == "1":
            out = (out ^ h[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    at = np.flatnonzero(left >= len(mask))
    return mix(out[at]), at


def _runs(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of the mask, each run of equal ones at consecutive places once: seed, first place, length."""
    seeds, at = _seeds(h, first, mask)
    fresh = np.ones(len(seeds), bool)
    fresh[1:] = (seeds[1:] != seeds[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(fresh)
    return seeds[start], at[start], np.diff(np.append(start, len(seeds)))


def _whole(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of the items that are just as long as the mask, in the form of ``_runs``."""
    seeds, at = _seeds(h, first, mask)
    mine = np.isin(at, first[:-1][np.diff(first) == len(mask)])
    return seeds[mine], at[mine], np.ones(int(mine.sum()), np.int64)


def _block(ids: np.ndarray, texts: pa.Array) -> Block:
    w = split(texts, space=NOT_ALNUM)
    h = w.hashes()
    size = np.diff(w.first)
    whole = tuple("1" * n for n in np.unique(size[(size > 0) & (size < LEAST_ITEM)]).tolist())
    seeds, at, run = (np.concatenate(c) for c in zip(*(_runs(h, w.first, m) for m in MASKS), *(_whole(h, w.first, m) for m in whole)))
    order = np.argsort(seeds, kind="stable")
    bits = max(16, int(np.ceil(np.log2(max(1, len(seeds)) * 16))))
    small = np.zeros(1 << bits, bool)
    small[(seeds & np.uint64(len(small) - 1)).astype(np.int64)] = True
    return Block(ids, w.first, h, seeds[order], at[order].astype(np.int32), run[order].astype(np.int32), np.packbits(small, bitorder="little"), whole)


def _overlap(text: np.ndarray, item: np.ndarray, shifts: np.ndarray, beat: int) -> tuple[int, int, int] | None:
    """Start and end in the text, and equal words, of the best overlap on these diagonals, if it has more than ``beat``.

    text[i] stands against item[i - shift]; one row of the arrays below is one diagonal.  Of all windows that hold a hit,
    are long enough and at least MIN_SHARE equal, this is the one with the most equal words.  With a running balance that
    rises by 1 - MIN_SHARE at an equal word and falls by MIN_SHARE at another, a window is good if the balance ends no
    lower than it starts; only starts at a new low, with the farthest end for each, can be best.
    """
    least = min(MIN_WORDS, len(item))
    low = np.maximum(0, -shifts)
    n = np.minimum(len(item), len(text) - shifts) - low
    use = n >= max(least, beat + 1)
    if not use.any():
        return None
    shifts, low, n = shifts[use], low[use], n[use]
    rows, width = len(n), int(n.max())
    column, cells = np.arange(width + 1), low[:, None] + np.arange(width)
    same = item[np.minimum(cells, len(item) - 1)] == text[np.clip(cells + shifts[:, None], 0, len(text) - 1)]
    same &= column[:-1] < n[:, None]
    count = np.zeros((rows, width + 1), np.int64)
    np.cumsum(same, axis=1, out=count[:, 1:])
    balance = 100 * count - round(100 * MIN_SHARE) * column
    nearest = np.full((rows, width), 2 * width)  # the least end of the hits from each place on
    for mask in MASKS if len(item) >= LEAST_ITEM else ("1" * len(item),):
        if (fits := width - len(mask) + 1) > 0:
            hit = np.ones((rows, fits), bool)
            for k, one in enumerate(mask):
                if one == "1":
                    hit &= same[:, k : k + fits]
            nearest[:, :fits] = np.where(hit, np.minimum(nearest[:, :fits], column[:fits] + len(mask)), nearest[:, :fits])
    nearest = np.minimum.accumulate(nearest[:, ::-1], axis=1)[:, ::-1]
    fresh = nearest < 2 * width
    fresh[:, 1:] &= balance[:, 1:-1] < np.minimum.accumulate(balance, axis=1)[:, :-2]
    row, start = np.nonzero(fresh)
    below = -100 * width - 1
    top = np.where(column <= n[:, None], balance, below)
    top = np.maximum.accumulate(top[:, ::-1], axis=1)[:, ::-1]
    apart = 201 * width + 2  # more than balances differ, so that the rows are sorted one after the other
    far = np.searchsorted((np.arange(rows)[:, None] * apart - top).ravel(), row * apart - balance[row, start], "right") - 1 - row * (width + 1)
    equal = count[row, far] - count[row, start]
    good = np.flatnonzero((nearest[row, start] <= far) & (far - start >= least) & (equal > beat))
    if not len(good):
        return None
    k = good[np.lexsort((-row[good], (far - start)[good], equal[good]))[-1]]
    a, b, r = int(start[k]), int(far[k]), int(row[k])
    while b - a > least and not same[r, b - 1]:
        b -= 1
    while b - a > least and not same[r, a]:
        a += 1
    base = int(low[r] + shifts[r])
    return base + a, base + b, int(equal[k])


def _best(text: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
    """The best overlap of a text and an item on any of the diagonals; long diagonals come first, as they can beat the others."""
    n = np.minimum(len(item), len(text) - shifts) - np.maximum(0, -shifts)
    shifts = shifts[np.argsort(-n, kind="stable")]
    best, step = None, max(1, PIECE // len(item))
    for i in range(0, len(shifts), step):
        best = _overlap(text, item, shifts[i : i + step], best[2] if best else 0) or best
        if best and best[2] == len(item):
            break
    return best


def _cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to about a piece."""
    total, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PIECE, "right")) - 1)
        yield i, j
        i = j


def _spread(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _distinct(pair: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((shift, pair))
    pair, shift = pair[order], shift[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (shift[1:] != shift[:-1])
    return pair[fresh], shift[fresh]


def _diagonals(h: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text * items + item, shift) with a hit, sorted."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for mask in (*MASKS, *block.whole):
        seeds, at, run = _runs(h, first, mask)
        near = block.may_hold(seeds)
        seeds, at, run = seeds[near], at[near], run[near]
        lo = np.searchsorted(block.seeds, seeds)
        n = np.searchsorted(block.seeds, seeds, "right") - lo
        for i, j in _cut(n):
            m = n[i:j]
            with_ = np.repeat(lo[i:j], m) + _spread(m)
            p, q = np.repeat(at[i:j], m), block.at[with_].astype(np.int64)
            text, item = np.searchsorted(first, p, "right") - 1, np.searchsorted(block.first, q, "right") - 1
            low = (p - first[text]) - (q - block.first[item]) - (block.run[with_] - 1)
            wide = np.repeat(run[i:j], m) + block.run[with_] - 1
            pair = text * np.int64(len(block.items)) + item
            for x, y in _cut(wide):
                found.append(_distinct(np.repeat(pair[x:y], wide[x:y]), np.repeat(low[x:y], wide[x:y]) + _spread(wide[x:y])))
    return _distinct(*(np.concatenate(c) for c in zip(*found)))


def _search(ids: list, texts: pa.Array, block: Block) -> list[tuple]:
    w = split(texts, space=NOT_ALNUM)
    h = w.hashes()
    pair, shift = _diagonals(h, w.first, block)
    cuts = np.flatnonzero(np.diff(pair)) + 1
    out = []
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pair)]) if len(pair) else ():
        r, k = divmod(int(pair[x]), len(block.items))
        if got := _best(h[w.first[r] : w.first[r + 1]], block.words[block.first[k] : block.first[k + 1]], shift[x:y]):
            a, b, e = got
            out.append((ids[r], block.items[k], a, b, e, e / (b - a)))
    return out


_OVERLAPS = "doc_id long, item_id long, word_start int, word_end int, n_equal int, share double"


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that overlap: the longest overlap's words, and its share of equal words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = min(total[1], (total[0] or 0) // block_bytes + 1)
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col(text_col).alias("text"))

    def one(k: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").toArrow()
        texts = part["text"].combine_chunks() if part.num_rows else pa.array([], pa.string())
        sent = spark.sparkContext.broadcast(_block(part["item_id"].to_numpy(), texts))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tidy(batches):
                for piece in chunks(batch, 1):
                    if found := _search(piece.column(0).to_pylist(), piece.column(1), sent.value):
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["doc_id", "item_id", "word_start", "word_end", "n_equal", "share"])

        return rows.mapInArrow(search, _OVERLAPS)

    if not blocks:
        return spark.createDataFrame([], _OVERLAPS)
    return reduce(DataFrame.union, [one(k) for k in range(blocks)])


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each contaminated document: its items, and the longest overlap."""
    found = overlaps(docs, benchmark, text_col)
    return found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max("n_equal").cast("long").alias("n_equal"),
        F.max("share").alias("share"),
    )
