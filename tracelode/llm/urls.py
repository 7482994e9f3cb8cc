"""Operator 9: URL filters, in DataFrame and SQL functions only.

A rule is a host and a path prefix with an action.  Each URL is expanded into expressions: every
suffix of its host at a dot, joined with every prefix of its path that is as long as some rule's path.
Expressions and rules meet in an equi-join on the first ``PREFIX`` hex digits of their SHA-256 and on
nothing else; what met is then confirmed by the full digests, and of the confirmed rules the longest
(then ``block`` before ``allow``) decides.

Scale: rows are first grouped by (id, url, partition read) with their count, which folds repeated rows
while no count exceeds what one task has read, so a row repeated without bound is given back by many
tasks.  The later grouping of matches uses the same key, so there is one shuffle of ids and URLs.  Up
to ``BROADCAST_RULES`` rules are broadcast (their count is checked); beyond that the join shuffles, and
each rule is copied to ``SALTS`` places so that a hot host is spread.  Distinct lengths of rule paths,
at most as many as the longest path has characters, travel as one array.

Defined results: a null URL or one without ``://`` has empty host and path and no rule; without a rule
the verdict is ``allow``; a null id is kept; repeated rows repeat; an empty table gives no rows; extra
columns are left behind; two rules of one host and path that differ in action block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 8
BROADCAST_RULES = 200_000
SALTS = 32
#: The rules of the registered query: (action, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` (after the first ``://``, A-Z lower-cased) and ``path``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url_col}, instr({url_col}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": path})


def _met(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row with the rules whose short prefix equals that of one of its expressions (or with none)."""
    rules = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND action IS NOT NULL")
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path").cast("binary"), 256)
    book = rules.distinct().select("action", F.concat("rule_host", "rule_path").alias("rule"), digest.alias("rule_digest"), F.substring(digest, 1, PREFIX).alias("rule_short"))
    lengths = F.broadcast(rules.agg(F.collect_set(F.length("rule_path")).alias("lengths")))  # one row

    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, F.lit("\n"), p).cast("binary"), 256))))
    spread = rows.join(lengths).withColumn("digest", F.explode_outer(expressions)).drop("lengths").withColumn("short", F.substring("digest", 1, PREFIX))
    if book.count() <= BROADCAST_RULES:
        return spread.join(F.broadcast(book), F.col("short") == F.col("rule_short"), "left")
    salted = book.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = spread.withColumn("dealt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    return spread.join(salted, (F.col("short") == F.col("rule_short")) & (F.col("dealt") == F.col("salt")), "left")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.spark_partition_id().alias("read_by"))
    key = ["page_id", "url", "read_by"]
    met = _met(host_and_path(rows.groupBy(*key).agg(F.count("*").alias("copies"))), rules)
    # Confirmed here, after the join: an equality beside the join would become one of its keys.
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule"), (F.col("action") == "block").cast("int"), "rule", "action"))
    best = met.groupBy(*key).agg(F.max(confirmed).alias("best"), F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"))
    copy = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(DEFAULT)).alias("verdict"), copy.alias("copy")).drop("copy")
