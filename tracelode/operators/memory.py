"""Memory and graphs: wiki links, neighbourhoods, last-write state, conversation budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wikilink_edges(notes: DataFrame) -> DataFrame:
    """(src, rel, dst) of ``[[A]] works_at [[B]]`` and ``[[A]] reports_to [[B]]``, each once."""
    hits = F.regexp_extract_all("text", F.lit("\\[\\[[^\\]]+\\]\\] (?:works_at|reports_to) \\[\\[[^\\]]+\\]\\]"), 0)
    rows = notes.select(F.explode(hits).alias("h"))
    part = lambda k: F.regexp_extract("h", "\\[\\[([^\\]]+)\\]\\] (works_at|reports_to) \\[\\[([^\\]]+)\\]\\]", k)
    return rows.select(part(1).alias("src"), part(2).alias("rel"), part(3).alias("dst")).distinct()


def wikilink_nodes(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode(F.regexp_extract_all("text", F.lit("\\[\\[([^\\]]+)\\]\\]"), 1)).alias("node")).groupBy("node").agg(F.count("*").alias("n_mentions"))


def graph_neighbours(edges: DataFrame, entities: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges that touch each entity, whatever the case, of one relation if given."""
    e = edges if relation is None else edges.where(F.col("rel") == relation)
    ends = e.select("src", "rel", "dst", F.explode(F.array_distinct(F.array(F.lower("src"), F.lower("dst")))).alias("key"))
    return entities.withColumn("key", F.lower("entity")).join(ends, "key").select("entity", "src", "rel", "dst")


def one_hop_expand(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Items that share a source or an identifier with a seed, one hop away, without the seeds and without repeats.

    ``links`` has (item, kind, value).  The kept edge is the first by kind, then seed.  Items are joined on the values
    of seeds only, so a value that no seed has never multiplies rows.
    """
    of_seed = links.join(seeds, "item", "left_semi").select(F.col("item").alias("seed"), "kind", "value").distinct()
    first = of_seed.groupBy("kind", "value").agg(F.min("seed").alias("seed"))  # one seed for each value is enough: the edge kept is the first
    reached = links.select("item", "kind", "value").distinct().join(first, ["kind", "value"]).join(seeds, "item", "left_anti")
    return reached.groupBy("item").agg(F.min(F.struct("kind", "seed")).alias("e")).select("item", F.col("e.kind").alias("edge"), F.col("e.seed").alias("seed"))


def memory_state(log: DataFrame) -> DataFrame:
    """Last write of each key, with the number of writes that the full log keeps."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.count("*").alias("n_writes"))


def memory_write_gate(docs: DataFrame, pattern: str = "(?i)\\b(always|never|prefer|remember that|from now on)\\b") -> DataFrame:
    """Preference-like lines that arrive from documents: quarantined, never written to memory."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("doc_id", F.col("n").cast("long").alias("line_no"), F.trim("line").alias("quarantined"))


def compact_history(turns: DataFrame, keep: int = 4) -> DataFrame:
    """The last ``keep`` turns and all pinned system turns of a conversation, and how many others were dropped."""
    w = Window.partitionBy("conv_id")
    ranked = turns.withColumn("pinned", F.col("role") == "system").withColumn("back", F.row_number().over(w.partitionBy("conv_id", "pinned").orderBy(F.col("turn").desc())))
    stays = F.col("pinned") | (F.col("back") <= keep)
    return ranked.withColumn("n_dropped", F.sum((~stays).cast("long")).over(w)).where(stays).select("conv_id", "turn", "role", "n_dropped")


def context_budget(turns: DataFrame, window: int = 4_000) -> DataFrame:
    """Tokens (a quarter of the characters, rounded up) of each role in a conversation, its share, and percent of the window."""
    parts = turns.groupBy("conv_id", "role").agg(F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy("conv_id"))
    return parts.select("conv_id", "role", F.col("tokens").cast("long").alias("tokens"), F.round(F.col("tokens") / F.nullif(total, F.lit(0)), 4).alias("share"), F.round(100.0 * total / window, 3).alias("window_percent"))
