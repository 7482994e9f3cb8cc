"""Operator 11: Merkle manifests of a dataset by sibling-shift self-joins.

Every row is a leaf: the SHA-256 of its columns.  The leaves of a group (such as a source) ascend by id; every
``fan_out`` consecutive nodes become one node of the next level until one is left, the group's subroot.  The subroots,
in the order of their groups, give the root in the same way.

Each level is one equijoin of the nodes with themselves: a node offers its digest to its siblings, whose indices are
computed from its own (XOR for binary trees, offsets of the slot otherwise), and finds the digests that were offered to
its own index.  These siblings are the node's step of every proof; then the rows of slot zero emit the parents.

Scale: texts are read once and never shuffled.  Ranks within groups come from one range exchange of ids and digests and
from counts for each group and part, so that a group with a third of all rows is spread like any other.  A level costs one
exchange of ``fan_out`` small rows a node; no key has more than ``fan_out`` rows.  Levels are written tables, because
the next one reads them.  The driver sees two counts and the root's digest.  Windows without a key run over parts, not rows.

Defined results: null columns are ``-`` in the leaf; rows that repeat an id are ordered by their digest, and equal rows
are leaves of their own, with one of their places each; null ids come first; a null group is a group of its own, the
first one; an empty table gives an empty table; extra columns count only if they are named, and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import removed, written

FAN_OUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot:int,siblings:binary>>"
_DIGEST = 32  # bytes


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    said = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said)).cast("binary"), 256))


def text_of(digests: Column) -> Column:
    """Lowercase hex text of one or more binary digests."""
    return F.lower(F.hex(digests))


def _parent(digest: Column, slot: Column, siblings: Column) -> Column:
    """Digest (binary) of the node whose members are ``siblings`` with ``digest`` put in at ``slot``."""
    at = slot * _DIGEST
    members = F.concat(F.substring(siblings, F.lit(1), at), digest, F.substring(siblings, at + 1, F.octet_length(siblings)))
    return F.unhex(F.sha2(text_of(members).cast("binary"), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The root's digest that a leaf's digest and its proof lead to."""
    return F.aggregate(path, leaf, lambda digest, step: _parent(digest, step["slot"], step["siblings"]))


def proof_text(path: Column) -> Column:
    """Hex text of all siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: text_of(step["siblings"])), "")


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``g`` (rank of the group, null first), ``idx`` (rank of the row in it) and ``n`` (the group's rows); from 0.

    Rows are range-partitioned and sorted; a row's rank is its place in its part and what earlier parts hold of its group.
    """
    keys = [F.col(group), *(F.col(c) for c in order), F.col("_tie")]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)), "sorted")
    counts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("c"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_part", "_first", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    # groups that begin in one part are ranked within it, and parts by how many groups begin in earlier ones
    begins = counts.where("before = 0").select(F.col(group).alias("_group"), F.col("_part").alias("_begin"))
    begins = begins.withColumn("k", F.row_number().over(Window.partitionBy("_begin").orderBy("_group")) - 1)
    parts = begins.groupBy("_begin").agg(F.count("*").alias("c"))
    parts = parts.select("_begin", F.coalesce(F.sum("c").over(Window.orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = begins.join(parts, "_begin").select("_group", (F.col("base") + F.col("k")).alias("g"))
    facts = counts.join(numbered, F.col(group).eqNullSafe(F.col("_group"))).select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "g", "n", (F.col("before") - F.col("_first")).alias("shift"))
    found = placed.join(facts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    found = written(found.select(*rows.columns, "g", (F.col("_at") + F.col("shift")).alias("idx"), "n"), "ranked")
    removed(placed)
    return found


def _with_siblings(nodes: DataFrame, fan_out: int, payload: Sequence[str]) -> DataFrame:
    """(g, idx, n, digest, slot, siblings) of nodes whose group has several; ``siblings`` are the run's other digests in order."""
    slot = F.col("idx") % fan_out
    indices = F.array(F.col("idx").bitwiseXOR(F.lit(1))) if fan_out == 2 else F.transform(F.sequence(F.lit(1), F.lit(fan_out - 1)), lambda k: F.col("idx") - slot + (slot + k) % fan_out)
    some = nodes.where("n > 1")
    offers = some.select("g", F.explode(F.filter(indices, lambda i: i < F.col("n"))).alias("idx"), F.struct(slot.alias("slot"), "digest").alias("offer"))
    met = some.join(offers, ["g", "idx"], "left").groupBy("g", "idx").agg(*(F.first(c).alias(c) for c in ("n", "digest", *payload)), F.array_sort(F.collect_list("offer")).alias("offers"))
    siblings = F.unhex(F.array_join(F.transform("offers", lambda x: F.hex(x["digest"])), ""))
    return met.select("g", "idx", "n", "digest", *payload, slot.cast("int").alias("slot"), siblings.alias("siblings"))


def _climb(nodes: DataFrame, most: int, fan_out: int, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The levels with siblings, from the leaves up, and the last node of each group: (g, level, digest)."""
    levels, tops = [], None
    while True:
        ends = nodes.where("n = 1").select("g", F.lit(len(levels)).alias("level"), "digest")
        tops = ends if tops is None else tops.union(ends)
        if most <= 1:
            return levels, tops
        found = written(_with_siblings(nodes, fan_out, () if levels else payload), "level")
        levels.append(found)
        up = _parent(F.col("digest"), F.col("slot"), F.col("siblings"))
        nodes = found.where("slot = 0").select("g", F.expr(f"idx div {fan_out}").alias("idx"), F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"), up.alias("digest"))
        most = -(-most // fan_out)


def _descend(levels: list[DataFrame], tops: DataFrame, fan_out: int, payload: Sequence[str] = ()) -> DataFrame | None:
    """(g, idx, digest, payload, path, subroot) of every leaf of a group with several.  ``tops``: (g, level, subroot, path), the proof from a group's last node on."""
    above = None
    for k in reversed(range(len(levels))):
        up = tops.where(F.col("level") == k + 1).select("g", F.lit(0).cast("long").alias("parent"), F.col("path").alias("rest"), "subroot")
        if above is not None:
            up = up.union(above.select("g", F.col("idx").alias("parent"), F.col("path").alias("rest"), "subroot"))
        step = F.array(F.struct("slot", "siblings"))
        here = levels[k].withColumn("parent", F.expr(f"idx div {fan_out}")).join(up, ["g", "parent"])
        above = here.select("g", "idx", "digest", *(payload if k == 0 else ()), F.concat(step, "rest").cast(PATH).alias("path"), "subroot")
    return above


def manifest(leaves: DataFrame, group: str = "source", order: Sequence[str] = ("doc_id",), fan_out: int = FAN_OUT) -> DataFrame:
    """``leaves`` (with their binary ``digest``) and ``path`` (each leaf's proof), ``subroot`` and ``root`` (binary)."""
    payload = [c for c in leaves.columns if c != "digest"]
    plain = [f"_c{i}" for i in range(len(payload))]  # so that no column's name can clash
    named = dict(zip(payload, plain))
    rows = written(leaves.select("digest", *(F.col(f"`{c}`").alias(named[c]) for c in payload)), "leaves")
    nodes = ranked(rows, named[group], [*(named[c] for c in order), "digest"])
    removed(rows)
    most, n_groups = nodes.agg(F.max("n"), F.max("g") + 1).first()
    none = F.array().cast(PATH)
    if most is None:
        return leaves.select("*", none.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"))

    levels, tops = _climb(nodes, most, fan_out, plain)
    tops = written(tops, "subroots")
    over, last = _climb(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "digest"), n_groups, fan_out)
    root = last.first()["digest"]
    end = last.select("g", "level", F.col("digest").alias("subroot"), none.alias("path"))
    proofs = _descend(over, end, fan_out)
    if proofs is None:  # one group: its subroot is the root
        tops = tops.select("g", "level", F.col("digest").alias("subroot"), none.alias("path"))
    else:
        tops = tops.join(proofs.select(F.col("idx").alias("g"), "path"), "g").select("g", "level", F.col("digest").alias("subroot"), "path")
    alone = nodes.where("n = 1").join(tops.where("level = 0"), "g").select("digest", *plain, "path", "subroot")
    below = _descend(levels, tops, fan_out, plain)
    found = alone if below is None else alone.union(below.select("digest", *plain, "path", "subroot"))
    return found.select(*(F.col("digest") if c == "digest" else F.col(named[c]).alias(c) for c in leaves.columns), "path", "subroot", F.lit(bytes(root)).alias("root"))
