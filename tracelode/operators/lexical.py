"""Exact lexical search over packed posting lists with block-max bounds.

Chunks are packed into shards.  A shard holds, for each of its terms, the chunks that have it with their counts, and is a
row of a written table.  A query is a set of weighted terms, and a chunk's score is the sum of weight times impact over
shared terms.  A task meets one shard and a block of queries: from the greatest impact of each term in each run of
``RUN`` chunks follows a bound on the score of every chunk of the run, and only runs whose bound reaches the k-th score are
scored, the best first.  Within a shard chunks are sorted by which of its most frequent words they have, so
that texts of one language or kind share runs and bounds are close.  A few shards are searched first; the k-th scores there are
what the others' bounds must reach from the start.  A task returns k rows a query, so no row exists for a query, a
chunk and a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import LARGE_ROWS, written

#: Chunks in a shard, chunks in a run with one bound, queries in a block.
SHARD, RUN, QUERY_BLOCK = 10_000, 8, 2_000
#: Words whose presence sorts a shard's chunks, and shards of which one is searched first.
FREQUENT, PILOT = 24, 16
#: Runs are scored in this many steps at most, with a new k-th score after each.
STEPS = 64
#: Up to this many bytes of packed queries are broadcast; more meet the shards block by block.
BROADCAST_BYTES = 64 << 20
#: ``s_n`` (the number of a shard) is put beside these.
_SHARD = "keys binary, length binary, terms array<string>, first binary, chunk binary, tf binary"
_QUERIES = "q_ids binary, q_first binary, q_terms array<string>, q_weights binary, q_least binary"
#: Impact of each posting from its count, its chunk's number of words, and the shard's norms of chunks.
Impact = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def words(text: str) -> Column:
    """Lower-cased words between white space, with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")


def _split(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased texts, as ``words`` has them, and the text of each."""
    listed = pc.ascii_split_whitespace(lowered)
    found, row = listed.flatten(), np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
    some = pc.not_equal(found, "")  # before the first and after the last white space
    return found.filter(some), row[some.to_numpy(zero_copy_only=False)]


def _by_frequent_words(term: np.ndarray, row: np.ndarray, n_terms: int, n_rows: int) -> np.ndarray:
    """The order of chunks by which of the most frequent words they have."""
    frequent = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:FREQUENT]
    bit = np.zeros(n_terms, np.int64)
    bit[frequent] = np.int64(1) << np.arange(FREQUENT - 1, -1, -1)[: len(frequent)]
    mark = np.zeros(n_rows, np.int64)
    np.bitwise_or.at(mark, row, bit[term])
    return np.argsort(mark, kind="stable")


def index(chunks: DataFrame) -> DataFrame:
    """The shards of (chunk_id, text) rows: sorted terms, and for each its chunks (by place in ``keys``) and counts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SHARD):
                part = batch.slice(i, SHARD)
                found, row = _split(part.column(1))
                coded, n = pc.dictionary_encode(found), part.num_rows
                term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                order = _by_frequent_words(term, row, len(coded.dictionary), n)
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                row = place[row]
                pair, tf = np.unique(term * n + row, return_counts=True)
                first = np.searchsorted(pair, np.arange(len(coded.dictionary) + 1) * n)
                made = [
                    part.column(0).to_numpy(zero_copy_only=False)[order].astype("<i8").tobytes(), np.bincount(row, minlength=n).astype("<i8").tobytes(), coded.dictionary.to_pylist(),
                    first.astype("<i8").tobytes(), (pair % max(n, 1)).astype("<i4").tobytes(), tf.astype("<i4").tobytes(),
                ]
                kinds = [pa.list_(pa.string()) if isinstance(x, list) else pa.binary() for x in made]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds)], [c.split()[0] for c in _SHARD.split(", ")])

    packed = chunks.select(F.col("chunk_id").cast("long"), F.lower(F.coalesce("text", F.lit("")))).mapInArrow(pack, _SHARD)
    return written(packed.withColumn("s_n", F.monotonically_increasing_id()), "postings", **LARGE_ROWS)


def size(shards: DataFrame) -> tuple[int, float]:
    """How many chunks there are, and their mean number of words."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = [np.frombuffer(x, "<i8") for x in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in length], pa.int64()), pa.array([int(x.sum()) for x in length], pa.int64())], ["n", "words"])

    n, total = shards.select("length").mapInArrow(tell, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    return n or 0, (total or 0) / n if n else 0.0


def document_frequency(shards: DataFrame) -> DataFrame:
    """(term, df): how many chunks have each term; a shard gives one row a term."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, first in zip(batch.column("terms"), batch.column("first").to_pylist()):
                yield pa.RecordBatch.from_arrays([terms.values, pa.array(np.diff(np.frombuffer(first, "<i8")))], ["term", "c"])

    return shards.select("terms", "first").mapInArrow(tell, "term string, c long").groupBy("term").agg(F.sum("c").alias("df"))


def _packed(weights: DataFrame, least: DataFrame | None) -> DataFrame:
    """(query_id, term, weight) rows, with (query_id, least) where known, as blocks of queries."""
    held = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))  # the words of one question
    held = held.withColumn("least", F.lit(None)) if least is None else held.join(least, "query_id", "left")
    each = lambda c: F.transform("t", lambda x: x[c])
    held = held.select(F.col("query_id").cast("long"), each("term").alias("terms"), each("weight").cast("array<double>").alias("weights"), F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERY_BLOCK):
                ids, terms, weight, low = batch.slice(i, QUERY_BLOCK).columns
                first = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
                plain = lambda x, t: x.to_numpy(zero_copy_only=False).astype(t).tobytes()
                made = [plain(ids, "<i8"), first.astype("<i8").tobytes(), terms.flatten().to_pylist(), plain(weight.flatten(), "<f8"), plain(low, "<f8")]
                kinds = [pa.list_(pa.string()) if isinstance(x, list) else pa.binary() for x in made]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds)], [c.split()[0] for c in _QUERIES.split(", ")])

    return held.repartition(max(1, -(-held.count() // QUERY_BLOCK))).mapInArrow(pack, _QUERIES)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Shard:
    """One shard in memory, with the greatest impact of each term in each run of chunks that has it."""

    def __init__(self, row: dict, impact: Impact):
        take = lambda c, t: np.frombuffer(row[c].as_buffer(), t)
        self.keys, self.first, self.chunk, self.terms = take("keys", "<i8").copy(), take("first", "<i8").copy(), take("chunk", "<i4").astype(np.int64), row["terms"].values
        self.impact = impact(take("tf", "<i4").astype(np.float64), self.chunk, take("length", "<i8"))
        run, term = self.chunk // RUN, np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        begins = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (term[1:] != term[:-1])])) if len(run) else np.zeros(0, np.int64)
        self.part, self.run = np.append(begins, len(run)), run[begins]  # postings of a term in a run
        self.greatest = np.maximum.reduceat(self.impact, begins) if len(begins) else np.zeros(0)
        self.runs_of = np.searchsorted(begins, self.first)
        self.n_runs = -(-len(self.keys) // RUN)

    def top(self, term: np.ndarray, weight: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the chunks that were scored, among which are the k best that share a term.

        Runs are scored in the order of their bounds, until the next bound is below ``least`` (a score that k chunks of the
        whole table are known to reach) or below the k-th score so far.
        """
        begin, end = self.runs_of[term], self.runs_of[term + 1]
        parts, by = _ranges(begin, end), np.repeat(np.arange(len(term)), end - begin)
        bound, seen = np.zeros(self.n_runs), np.zeros(self.n_runs, bool)
        np.add.at(bound, self.run[parts], np.maximum(weight[by] * self.greatest[parts], 0))
        seen[self.run[parts]] = True
        order = np.flatnonzero(seen & (bound >= least))
        order = order[np.argsort(-bound[order], kind="stable")]
        score, has, step = np.zeros(len(self.keys)), np.zeros(len(self.keys), bool), max(-(-k // RUN), self.n_runs // STEPS)
        while len(order):
            chosen = np.zeros(self.n_runs, bool)
            chosen[order[:step]] = True
            mine = np.flatnonzero(chosen[self.run[parts]])
            p = parts[mine]
            size = self.part[p + 1] - self.part[p]
            at = _ranges(self.part[p], self.part[p + 1])
            np.add.at(score, self.chunk[at], np.repeat(weight[by[mine]], size) * self.impact[at])
            has[self.chunk[at]] = True
            order = order[step:]
            found = score[has]
            if len(found) >= k:
                least = max(least, _below(np.partition(found, len(found) - k)[len(found) - k]))
                order = order[bound[order] >= least]
        places = np.flatnonzero(has)
        return places, score[places]


def _below(score: float) -> float:
    """A little less, as scores are compared at nine digits."""
    return score - 2e-9 * (1 + abs(score))


def search(shards: DataFrame, weights: DataFrame, k: int, impact: Impact) -> DataFrame:
    """(query_id, chunk_id, score, shard, scored, chunks): each shard's k best chunks of each query, ties by id; weaker ones than k others may miss.

    ``scored`` is how many of the ``chunks`` of the ``shard`` (named by its first one) were scored for the query.
    ``weights`` is (query_id, term, weight); chunks that share no term with a query are not returned.
    """
    weights = written(weights, "weights")
    n, least = shards.count(), None
    if n > 1:  # any k chunks give a score that the k best reach
        found = _searched(_pilot(shards, -(-n // PILOT)), weights, None, k, impact)
        kth = found.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("i") == k)
        least = kth.select("query_id", (F.col("score") - 2e-9 * (1 + F.abs("score"))).alias("least"))
    return _searched(shards, weights, least, k, impact)


def _pilot(shards: DataFrame, n: int) -> DataFrame:
    """The first ``n`` shards by a hash of their numbers, dealt out over tasks; a limit would put them all into one."""
    first = shards.select("s_n").orderBy(F.xxhash64("s_n"), "s_n").limit(n)  # numbers only
    return shards.join(F.broadcast(first), "s_n", "left_semi").repartition(n, "s_n")


def _searched(shards: DataFrame, weights: DataFrame, least: DataFrame | None, k: int, impact: Impact) -> DataFrame:
    blocks = written(_packed(weights, least), "questions")
    n_bytes = blocks.agg(F.sum(F.length("q_weights") + F.length("q_ids") + F.length(F.array_join("q_terms", ",")))).first()[0]
    blocks = F.broadcast(blocks) if (n_bytes or 0) <= BROADCAST_BYTES else blocks

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            for r in range(batch.num_rows):  # one by one: a row is a whole shard
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                if row["s_n"].as_py() != last[0]:
                    last = (None, None)  # before the next one is made
                    last = (row["s_n"].as_py(), Shard(row, impact))
                shard = last[1]
                ids, first, weight, low = (np.frombuffer(row[f"q_{c}"].as_buffer(), t) for c, t in (("ids", "<i8"), ("first", "<i8"), ("weights", "<f8"), ("least", "<f8")))
                place = pc.index_in(row["q_terms"].values, value_set=shard.terms)
                place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                out = [[], [], [], [], [], []]
                for q, i, j, bound in zip(ids.tolist(), first.tolist(), first[1:].tolist(), low.tolist()):
                    here = np.flatnonzero(place[i:j] >= 0) + i
                    places, score = shard.top(place[here], weight[here], k, bound)
                    keep = np.lexsort((shard.keys[places], -np.round(score, 9)))[:k]
                    for column, x in zip(out, (np.full(len(keep), q), shard.keys[places[keep]], np.round(score[keep], 9), *(np.full(len(keep), y) for y in (shard.keys[0], len(places), len(shard.keys))))):
                        column.append(x)
                made = [np.concatenate([*c, np.zeros(0, t)]).astype(t) for c, t in zip(out, (np.int64, np.int64, np.float64, np.int64, np.int64, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["query_id", "chunk_id", "score", "shard", "scored", "chunks"])

    return shards.crossJoin(blocks).mapInArrow(best, "query_id long, chunk_id long, score double, shard long, scored long, chunks long")
