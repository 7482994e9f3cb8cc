"""Operator 10: near-duplicate groups by MinHash and odd sketches.

Each text is the set of its distinct n-word shingles (64-bit hashes).  Texts with equal sets are folded
into one representative first.  For every representative the task computes ``BANDS * ROWS`` MinHash
values; bands of them are keys of buckets, and all of them are folded into an odd sketch: a bitmap in
which each (index, minimum) pair flips one bit.  The population count of two sketches' XOR estimates
how many MinHash values differ, which is precise at high similarities; candidate pairs whose sketches
are too far apart are dropped, and all others are confirmed on their full shingle sets.

Pairs are not expanded within a group.  In a star round every bucket names one leader, each member is
compared with its nearest leader (by sketch) only, and confirmed links are merged into components.
Rounds name other leaders, and look only at buckets that still hold more than one component, until
no round links much.  Then all pairs of *different* components within a bucket are compared exactly: in
buckets of at most ``SMALL`` members by a join whose condition includes the sketches; larger ones are
put together to families, which are cut into blocks, and every two blocks meet in one task as a tile
that compares all sketches, computes the intersections of what their sketches let pass, and returns links
between components only.  A link between different components is therefore never lost, no pair of a large
group becomes a row, and a group of m copies costs about m comparisons in each round.

Texts with equal sets are told by the size of the set and two independent 64-bit digests of it; this link
alone is not confirmed on the sets (a false one has a chance of about 2^-128 for each two texts).

Recall of the buckets: a pair at similarity 0.85 shares no band with probability below 1e-6 (at 0.80:
below 5e-5 with the settings used there).

Scale: texts are read twice (MinHash, then the sets of candidates only); signatures, buckets and
links are shuffled by key, and sketches travel with bucket rows so that most pairs fail before any set
is moved.  A bucket's rows are dealt to one place for each ``DEAL`` members, and what is known of the
bucket is copied to these places.  Intermediate tables go to the shared folder and are deleted when the
next one is there.  Nothing is collected to the driver but counts.

Defined results: null texts, and texts without words, have an empty set, link with nothing and are
their own component; a repeated id counts as one document whose rows get the same result, with the
sets of all its rows; a null id is left out of the links and is its own component (null);
extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, removed, written
from .text import chunks, mix, signed, split, tidy, windows

ROWS, BANDS = 6, 36
SKETCH_WORDS = 16  # 64-bit words of an odd sketch
#: Star rounds go on while they close a fifth of what is open, and more is open than this many pairs for each bucket row.
OPEN_PER_ROW = 2
MOST_ROUNDS = 3
SMALL = 64  # members of a bucket that is joined by pairs; larger ones go by tiles
TILE_DOCS, TILE_SHINGLES = 400, 250_000  # of a block
DEAL = 500  # members of a bucket that stay together

_rng = np.random.default_rng(909)
_MULTIPLY = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)

_SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text (flat), and the first of each text."""
    w = split(texts)
    h, first = windows(w.hashes(), w.first, size)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.searchsorted(row[fresh], np.arange(len(texts) + 1))


def minhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of each non-empty set: texts x (ROWS * BANDS)."""
    out = np.empty((len(first) - 1, ROWS * BANDS), np.uint64)
    for k in range(ROWS * BANDS):
        out[:, k] = np.minimum.reduceat(h * _MULTIPLY[k] + _ADD[k], first[:-1])
    return out


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each MinHash value, with its index, flips one of 64 * SKETCH_WORDS bits."""
    n, k = values.shape
    bit = mix(values ^ mix(np.arange(k, dtype=np.uint64) + np.uint64(77))[None, :]) % np.uint64(64 * SKETCH_WORDS)
    out = np.zeros(n * SKETCH_WORDS, np.uint64)
    place = (np.arange(n)[:, None] * SKETCH_WORDS + (bit >> np.uint64(6)).astype(np.int64)).ravel()
    np.bitwise_xor.at(out, place, np.uint64(1) << (bit & np.uint64(63)).ravel())
    return out.reshape(n, SKETCH_WORDS)


def sketch_limit(percent: int) -> int:
    """XOR population count that a pair of at least this similarity exceeds with a chance below about 1e-6.

    Five standard deviations above the mean, over both the sampling of MinHash values and collisions in the bitmap.
    """
    k, bits, s = ROWS * BANDS, 64 * SKETCH_WORDS, percent / 100
    differ = 2 * k * (1 - s)
    share = (1 - 2 / bits) ** differ
    sampling = 4 * k * s * (1 - s) * share * share
    collisions = bits / 4 * (1 - share * share) - differ * share * share
    return int(bits / 2 * (1 - share) + 5 * (sampling + max(collisions, 0)) ** 0.5) + 1


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Set size, set digest, band keys and odd sketch of each (doc_id, text) row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for part in chunks(batch, 1, most_rows=1_000):
                h, first = shingle_sets(part.column(1), size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                band_at, sketch_at = np.where(n > 0, BANDS, 0), np.where(n > 0, SKETCH_WORDS, 0)
                bands, sketches = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
                if len(some):
                    start = np.concatenate([first[:-1][some], [len(h)]])
                    a[some] = np.add.reduceat(mix(h), start[:-1])
                    b[some] = np.bitwise_xor.reduceat(mix(h * np.uint64(0x9E3779B97F4A7C15)), start[:-1])
                    values = minhashes(h, start)
                    sketches = odd_sketches(values).ravel()
                    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(some), 0)
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + values[:, r::ROWS])
                    bands = key.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(n, pa.int64()), pa.array(signed(a)), pa.array(signed(b)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(band_at)]), pa.int32()), pa.array(signed(bands))),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sketch_at)]), pa.int32()), pa.array(signed(sketches))),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return docs.mapInArrow(sign, _SIGNATURES)


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): each text's sorted distinct shingle hashes, eight bytes each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for part in chunks(batch, 1):
                h, first = shingle_sets(part.column(1), size)
                body = [h[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(body, pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(pack, "doc_id long, shingles binary")


def _far(x: Column, y: Column) -> Column:
    """Bits that differ between two sketches."""
    return sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, SKETCH_WORDS)), F.bit_count(x[0].bitwiseXOR(y[0])))


def _plausible(a: str, b: str, percent: int) -> Column:
    """Conditions that every pair of at least ``percent`` similarity meets: size ratio and sketches."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (_far(F.col(f"{a}.sketch"), F.col(f"{b}.sketch")) <= sketch_limit(percent))


def confirm(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose (u, v) have 100 * intersection >= percent * union of their full sets."""
    names = pairs.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    x = shingles.select(F.col("doc_id").alias("u"), F.col("shingles").alias("x"))
    y = shingles.select(F.col("doc_id").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(x, "u").join(y, "v").select(*names, "x", "y").mapInArrow(compare, pairs.schema)


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")


def _to_roots(pointers: DataFrame) -> DataFrame:
    """Pointers (each u once, v < u) followed to their ends; a pass follows two steps and sees whether there is a third."""
    now, before = pointers, None
    while True:
        steps = now.select(F.col("u").alias("at"), F.col("v").alias("to"))
        one = now.join(steps, F.col("v") == F.col("at"), "left").select("u", F.coalesce("to", "v").alias("v"))
        two = one.join(steps, F.col("v") == F.col("at"), "left").select("u", F.coalesce("to", "v").alias("v"), F.col("to").isNotNull().alias("moved"))
        now = written(two, "roots")
        if before is not None:
            removed(before)
        if not now.where("moved").limit(1).count():
            return now.select("u", "v")
        before = now


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each linked id reaches, without the smallest ids themselves; ``links`` are read several times.

    Each id points to its least neighbour below it, pointers are followed to their ends, and what links different ends is
    linked anew.  An end that is not alone has a neighbour below it in the next turn, or was pointed to in this one, so the ids
    that are left halve in every two turns at least; a turn is enough where no id has two neighbours below it.
    """
    edges, forest = _oriented(links), []
    before = None
    while True:
        hooks = written(edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("other")), "hooks")
        forest.append(_to_roots(hooks.select("u", "v")))
        forked = hooks.where("v < other").limit(1).count()
        removed(hooks)
        if not forked:
            break
        low = forest[-1].select(F.col("u").alias("v"), F.col("v").alias("low"))
        met = edges.join(forest[-1].withColumnRenamed("v", "high"), "u").join(low, "v", "left").select(F.col("high").alias("u"), F.coalesce("low", "v").alias("v"))
        edges = written(_oriented(met).distinct(), "links")
        if before is not None:
            removed(before)
        before = edges
        if not edges.limit(1).count():
            break
    if before is not None:
        removed(before)
    ends = forest[0]
    if len(forest) > 1:  # an end of one turn may point on in a later one
        ends = _to_roots(reduce(DataFrame.union, forest))
    return ends.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Bucket rows with what is known of their bucket; ``facts`` has one row a band, with its ``deals``."""
    copies = facts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    return rows.join(copies, ["band", "deal"])


def _mixed(rows: DataFrame) -> DataFrame:
    """The bucket rows (with ``comp``) of buckets that hold more than one component."""
    mixed = rows.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("deals").alias("deals")).where("low < high")
    return _with_facts(rows, mixed.select("band", "deals"))


def _relabel(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The bucket rows with their component now; components only grow, so a bucket that holds one is never looked up again."""
    return rows.join(labels, rows["comp"] == labels["old"], "left").withColumn("comp", F.coalesce("label", "comp")).drop("old", "label")


def groups(docs: DataFrame, percent: int = 85, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``; the similarity is ``percent`` or more."""
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed_rows = written(signatures(rows, size), "signatures")
    real = signed_rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    folded = real.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    folded = written(folded, "folded")  # a plain table on each side, so that a hot set's rows can be split in the joins below
    reps = real.join(folded.select(F.col("rep").alias("doc_id"), "set_a", "set_b", "n_shingles"), ["doc_id", "set_a", "set_b", "n_shingles"]).dropDuplicates(["set_a", "set_b", "n_shingles"])
    reps = written(reps.select("doc_id", "n_shingles", "bands", "sketch"), "representatives")

    exploded = reps.select(F.col("doc_id").alias("id"), "n_shingles", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("deals"), F.count("*").alias("m")).where("m > 1").drop("m")
    deal = F.pmod(F.xxhash64("id", F.lit("deal")), F.col("deals")).cast("int")
    buckets = written(exploded.join(shared, "band").withColumn("deal", deal), "buckets")
    crowd = buckets.select(F.col("id").alias("doc_id")).distinct()
    sketches = written(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sketch").join(crowd.withColumnRenamed("doc_id", "id"), "id", "left_semi"), "sketches")
    removed(reps)
    shingles = written(sets(rows.join(crowd, "doc_id", "left_semi"), size).dropDuplicates(["doc_id", "shingles"]), "sets")

    same = real.join(folded.where("copies > 1").drop("copies"), ["set_a", "set_b", "n_shingles"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    links = written(same.union(_links(buckets, sketches, shingles, percent)), "links")
    removed(folded, buckets, sketches, shingles)
    labels = components(links)
    removed(links)
    return (
        signed_rows.select("doc_id", "n_shingles")
        .join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"), F.coalesce(F.col("label").isNull() | (F.col("label") == F.col("doc_id")), F.lit(True)).alias("kept"))
    )


def _tile(percent: int):
    """Compares every document of one block with every document of another (or of its own); returns linked components."""

    def compare(table: pa.Table) -> pa.Table:
        block = np.asarray(table["block"])
        comp = np.asarray(table["comp"])
        sketch = np.asarray(table["sketch"].combine_chunks().flatten()).view(np.uint64).reshape(len(block), SKETCH_WORDS)
        size = np.array([len(x.as_buffer()) // 8 for x in table["shingles"]], np.int64)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        n, m = size[left][:, None], size[right][None, :]
        open_ = (comp[left][:, None] != comp[right][None, :]) & (100 * n >= percent * m) & (100 * m >= percent * n)
        far = np.zeros(open_.shape, np.int32)
        for k in range(SKETCH_WORDS):
            far += np.bitwise_count(sketch[left, k][:, None] ^ sketch[right, k][None, :])
        open_ &= far <= sketch_limit(percent)
        keep_left, keep_right = open_.any(1), open_.any(0)
        left, right, open_ = left[keep_left], right[keep_right], open_[keep_left][:, keep_right]
        if not len(left):
            return pa.table([pa.array([], pa.int64())] * 2, ["u", "v"])

        used = np.union1d(left, right)
        sets = [np.frombuffer(table["shingles"][i].as_buffer(), np.uint64) for i in used.tolist()]
        _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size[used])
        shared = df[col] > 1  # a shingle of one document is in no intersection
        place = np.cumsum(df > 1) - 1
        row, col = row[shared], place[col[shared]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        x, y = np.searchsorted(used, left), np.searchsorted(used, right)
        both = np.zeros((len(left), len(right)), np.int64)
        step = 4096  # counts up to here are exact in the single precision that the product is made in
        for c in range(0, int((df > 1).sum()), step):
            i, j = np.searchsorted(col, [c, c + step])
            part = np.zeros((len(sets), step), np.float32)
            part[row[i:j], col[i:j] - c] = 1
            both += (part[x] @ part[y].T).astype(np.int64)
        union = size[left][:, None] + size[right][None, :] - both
        x, y = np.nonzero(open_ & (100 * both >= percent * union))
        x, y = left[x], right[y]
        _, first = np.unique(np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])]), axis=1, return_index=True)  # one link joins two components
        return pa.table([pa.array(comp[x[first]]), pa.array(comp[y[first]])], ["u", "v"])

    return compare


def _rest(mixed: DataFrame, sketches: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """(u, v): all components that a link joins within a bucket (of large buckets: once for each tile)."""
    sizes = mixed.groupBy("band").agg(F.count("*").alias("m"), F.min("id").alias("least"), F.max("deals").alias("deals"))
    sketch = sketches.select("id", "sketch")
    small = _with_facts(mixed, sizes.where(F.col("m") <= SMALL).select("band", "deals")).join(sketch, "id")
    apart = (F.col("l.id") < F.col("r.id")) & (F.col("l.comp") != F.col("r.comp"))
    near = small.alias("l").join(small.alias("r"), (F.col("l.band") == F.col("r.band")) & apart & _plausible("l", "r", percent))
    near = near.select(F.col("l.id").alias("u"), F.col("r.id").alias("v"), F.col("l.comp").alias("one"), F.col("r.comp").alias("two")).distinct()
    by_pairs = confirm(near, shingles, percent).select(F.col("one").alias("u"), F.col("two").alias("v"))

    large = written(_with_facts(mixed, sizes.where(F.col("m") > SMALL).select("band", "deals", "least")), "large")
    chained = components(large.select(F.col("id").alias("u"), F.col("least").alias("v")))
    members = large.select("id", "comp", "n_shingles").distinct().join(chained, "id", "left").withColumn("family", F.coalesce("label", "id"))
    members = written(members.select("id", "comp", "n_shingles", "family"), "families")
    removed(large)
    cut = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(cut, "family").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    full = placed.join(shingles.withColumnRenamed("doc_id", "id"), "id").join(sketch, "id")
    dealt = full.select("family", "block", "id", "comp", "sketch", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = dealt.groupBy("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return by_pairs.union(tiles.applyInArrow(_tile(percent), "u long, v long"))


def _links(buckets: DataFrame, sketches: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect everything which the buckets connect; later ones are between components of earlier ones."""
    spark = buckets.sparkSession
    found, before = spark.createDataFrame([], "u long, v long"), None
    mixed = written(_mixed(buckets.withColumn("comp", F.col("id"))), "mixed")
    for turn in range(MOST_ROUNDS + 1):
        parts = mixed.groupBy("band", "comp").agg(F.count("*").alias("c")).groupBy("band").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
        n_rows, open_pairs = parts.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2)).first()
        if not open_pairs:
            break
        last = turn == MOST_ROUNDS or open_pairs < OPEN_PER_ROW * n_rows or (before is not None and open_pairs > 0.8 * before)
        before = open_pairs
        if last:
            found = found.union(written(_rest(mixed, sketches, shingles, percent), "rest"))
            break
        order = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")  # ids that point to a smaller one are components in one turn
        leaders = mixed.groupBy("band").agg(F.min_by("id", order).alias("v"), F.min_by("comp", order).alias("two"), F.max("deals").alias("deals"))
        led = _with_facts(mixed, leaders).where("comp <> two").groupBy(F.col("id").alias("u")).agg(F.min("comp").alias("one"), F.collect_set(F.struct("v", "two")).alias("leaders"))
        one, two = (sketches.select(F.col("id").alias(c), F.struct("n_shingles", "sketch").alias(d)) for c, d in (("u", "a"), ("v", "b")))
        near = led.join(one, "u").select("u", "one", "a", F.inline("leaders")).join(two, "v").where(_plausible("a", "b", percent))
        near = near.groupBy("u").agg(F.min_by(F.struct("v", "one", "two"), F.struct(_far(F.col("a.sketch"), F.col("b.sketch")), "v")).alias("best"))
        star = written(confirm(near.select("u", "best.*"), shingles, percent).select(F.col("one").alias("u"), F.col("two").alias("v")), "star")
        merged = components(star)
        removed(star)
        found = found.union(merged)
        before_round, now = mixed, written(_relabel(mixed, merged.withColumnRenamed("id", "old")), "relabelled")  # once for both uses
        mixed = written(_mixed(now), "mixed")
        removed(before_round, now)
    removed(mixed)
    return found
