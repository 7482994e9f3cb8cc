"""Operator 13: packing documents into sequences by best-two-fit.

Every document is its token ids and an end id; documents longer than a sequence are cut into pieces of its length, of
which the first may be shorter.  Only lengths matter to a packing, and there are at most as many as a sequence is long,
so the packing is planned for the counts of all lengths at once: a bin is filled greedily with the largest
documents that fit; then its smallest document is replaced by two unpacked ones that leave less of the gap, as long as there
are such two.  The bin is repeated as often as the counts allow, so the plan is a few thousand kinds of bins at any
size of the corpus.  Then each piece takes the place in the plan that its rank among pieces of its length gives it.

Scale: texts are tokenised in one map and never shuffled.  Ranks come from counts that each task keeps for each length
and a window over tasks for each length; a length with a third of all pieces is ranked like any other.  The driver sees one
count for each length (at most as many as the sequence is long) and plans the bins; the plan is broadcast (a few
places for each kind of bin).  Pieces are a written table, so that ranks hold if a task runs again.

Defined results: a null text is empty, and an empty one is one piece with the end id alone; repeated rows and null ids are
documents of their own; extra columns are left behind; an empty table gives an empty table.  Strings of added tokens
in a text become their ids, as the tokenizers library has it by default.  Numbers of sequences begin at 0 without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .frames import bounded_batches, narrow, written
from .text import chunks, tidy

LENGTH = 2048
END_ID = 0
#: Longer sequences are refused: the plan is made on the driver from one count for each length.
MAX_LENGTH = 65_536


def cut(n: int, length: int) -> np.ndarray:
    """Where the pieces of a document of ``n`` tokens begin, and where the last one ends."""
    first = n % length or length
    return np.concatenate([[0], np.arange(first, n + 1, length)])


def pieces(docs: DataFrame, vocabulary: tokens.ByteLevel, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth, ids) of each piece; ``nth`` numbers pieces of a length within their part (task)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + (", ids array<int>" if with_ids else "")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part = tokens.byte_encoder(sent.value), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in tidy(batches):
            for some in chunks(batch, "text"):
                row, piece, start, size, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(some.column("text").to_pylist()):
                    said = np.concatenate([tokens.encode(coder, text, specials=True), end]).astype("<u4")
                    at = cut(len(said), length).tolist()
                    for k, (p, q) in enumerate(zip(at, at[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(p)
                        size.append(q - p)
                        crc.append(zlib.crc32(said[p:q]))
                        if with_ids:
                            ids.append(said[p:q].astype(np.int32))
                size = np.array(size, np.int64)
                order = np.argsort(size, kind="stable")
                begin = np.searchsorted(size[order], np.arange(length + 2))
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - begin[size[order]] + seen[size[order]]
                seen += np.diff(begin)
                made = [some.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part, np.int64)), pa.array(nth)]
                if with_ids:
                    made.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(made, [c.split()[0] for c in schema.split(", ")])

    return bounded_batches(narrow(docs, id_col, text_col)).select(F.col("doc_id").cast("long"), "text").mapInArrow(make, schema)


def _two(left: np.ndarray, most: int, least: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is at most ``most`` and over ``least``, the largest sum first, then the most unequal two."""
    there = left > 0
    for total in range(min(most, 2 * len(left) - 2), least, -1):
        low = max(1, total - len(left) + 1)
        small = np.flatnonzero(there[low : total // 2 + 1] & there[total - total // 2 : total - low + 1][::-1]) + low
        if len(small) and 2 * small[0] == total and left[small[0]] < 2:
            small = small[1:]
        if len(small):
            return int(total - small[0]), int(small[0])
    return None


def plan(counts: np.ndarray, length: int) -> list[tuple[list[int], int]]:
    """Kinds of bins, each as its pieces' lengths and how many such bins there are, for ``counts[n]`` pieces of each length n."""
    left, bins = counts.astype(np.int64).copy(), []
    while left.any():
        held, gap = [], length
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):  # fill greedily, the largest first
            held.append(int(fits[-1]))
            left[fits[-1]] -= 1
            gap -= held[-1]
        while gap:  # two for the smallest, as long as the gap gets smaller
            smallest = min(held)
            two = _two(left, gap + smallest, smallest)
            if two is None:
                break
            held.remove(smallest)
            left[smallest] += 1
            held += two
            for n in two:
                left[n] -= 1
            gap += smallest - sum(two)
        kinds, uses = np.unique(held, return_counts=True)
        more = int((left[kinds] // uses).min())
        left[kinds] -= more * uses
        bins.append((held, more + 1))
    return bins


@dataclass(frozen=True)
class Places:
    """The plan by length: from rank ``since`` on, pieces of a length take ``width`` places a bin in the bins from ``bin`` on."""

    key: np.ndarray  # length << 40 | since
    bin: np.ndarray
    width: np.ndarray
    first: np.ndarray  # of the entry's offsets in ``offset``
    offset: np.ndarray

    @staticmethod
    def of(bins: list[tuple[list[int], int]], length: int) -> Places:
        used, base, rows, offset = np.zeros(length + 1, np.int64), 0, [], []
        for held, times in bins:
            at = np.concatenate([[0], np.cumsum(held)])[:-1]
            for n in sorted(set(held)):
                mine = [int(o) for o, h in zip(at, held) if h == n]
                rows.append((n << 40 | int(used[n]), base, len(mine), len(offset)))
                offset += mine
                used[n] += times * len(mine)
            base += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return Places(*table.T, np.array(offset, np.int64))

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces by length and rank."""
        k = np.searchsorted(self.key, size << 40 | rank, "right") - 1
        local = rank - (self.key[k] & ((1 << 40) - 1))
        return self.bin[k] + local // self.width[k], self.offset[self.first[k] + local % self.width[k]]


def pack(docs: DataFrame, vocabulary: tokens.ByteLevel, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids) of each piece; ``ids`` only if asked for."""
    if not 0 < length <= MAX_LENGTH:
        raise ValueError(f"sequences of 1 to {MAX_LENGTH} tokens, not {length}")
    cut_up = written(pieces(docs, vocabulary, length, end_id, id_col, text_col, with_ids), "pieces")
    by_part = cut_up.groupBy("length", "part").agg(F.count("*").alias("c"))
    counts = np.zeros(length + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("c").alias("c")).collect():  # at most ``length`` rows
        counts[r.length] = r.c
    sent = docs.sparkSession.sparkContext.broadcast(Places.of(plan(counts, length), length))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(sizes: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for size, rank in sizes:
            bins, offset = sent.value.find(np.asarray(size), np.asarray(rank))
            yield pa.StructArray.from_arrays([pa.array(bins), pa.array(offset)], ["sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    found = cut_up.join(before, ["length", "part"]).withColumn("_at", place("length", F.col("before") + F.col("nth")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"), *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of each sequence of ``pack``'s result with ids; a group is at most one sequence long."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    found = packed.groupBy("sequence_id").agg(held.alias("held"))
    return found.select("sequence_id", F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"), F.transform("held", lambda x: x["doc_id"]).alias("doc_ids"))
