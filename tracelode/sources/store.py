"""Document store: loading, views, upserts as new snapshots, export and comparison.

Plain Parquet has no MERGE, so every upsert returns the merged table; ``replace_snapshot`` writes it beside the old
one and names it last, so a reader never sees half of it.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
import weakref
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE_SCHEMA = """trace_id string, channel string, user_input string, retrieved_context string,
    tool_calls array<struct<name:string,result:string>>, assistant_output string"""


#: Where each table of ``written`` lies, so that it can be deleted.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def working_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder only inside one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='tracelode-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Options of ``written`` for rows of megabytes: a group of rows ends where it has 16 MB, and not with the 100th row at the earliest.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the working folder and read it back: cuts lineage and survives lost executors."""
    path = f"{working_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def replace_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write a table version; the path returned is what a catalogue entry should point to next."""
    path = f"{root.rstrip('/')}/v{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def load_traces(lines: DataFrame) -> DataFrame:
    """Typed traces of JSON lines (column ``value``).

    A trace with tool calls is an agent run, else an ask; its citations are the tools that gave a result, with the
    first 200 characters of it; it is supported if it has context.  Lines that are not JSON give nulls and are dropped.
    """
    t = lines.select(F.from_json("value", TRACE_SCHEMA).alias("t")).select("t.*").where("trace_id IS NOT NULL")
    cited = F.transform(F.filter(F.coalesce("tool_calls", F.array()), lambda c: F.coalesce(c["result"], F.lit("")) != ""), lambda c: F.concat(c["name"], F.lit("="), F.left(c["result"], F.lit(200))))
    return t.select(
        "trace_id", "user_input", "assistant_output", F.when(F.size("tool_calls") > 0, "agent").otherwise("ask").alias("endpoint_type"),
        F.array_join(cited, "|").alias("citations"), F.when(F.coalesce("retrieved_context", F.lit("")) != "", "supported").otherwise("not_applicable").alias("rag_status"),
    )


def trace_load_qa(lines: DataFrame) -> DataFrame:
    """Counts of raw lines by endpoint and by JSON type of ``tool_calls``, and how many have no context."""
    raw = lines.select(F.get_json_object("value", "$.tool_calls").alias("calls"), F.get_json_object("value", "$.retrieved_context").alias("context"))
    kind = F.when(F.col("calls").isNull(), "missing").when(F.col("calls") == "[]", "empty").when(F.col("calls").startswith("["), "array").otherwise("other")
    return raw.groupBy(kind.alias("calls_type")).agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce("context", F.lit("")) == "", 1).otherwise(0)).alias("n_no_context"))


#: Columns of the provenance view; dates stay text, because not all of them are ISO.
PROVENANCE = ("source_url", "title", "author", "published", "retrieved", "licence", "spdx", "sha256", "portal", "host", "language", "verified", "note")


def provenance_view(docs: DataFrame) -> DataFrame:
    """Provenance JSON as columns, with the size as a number where it is one."""
    fields = [F.get_json_object("provenance", f"$.{k}").alias(k) for k in PROVENANCE]
    return docs.select("doc_id", *fields, F.expr("try_cast(get_json_object(provenance, '$.size_bytes') AS BIGINT)").alias("size_bytes"))


def filter_metadata(docs: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows whose metadata equal all wanted values; operators and nested values are refused."""
    condition = F.lit(True)
    for key, value in wanted.items():
        if key.startswith("$") or isinstance(value, (dict, list)) or not re.fullmatch(r"\w+", key):
            raise ValueError(f"only equality with plain values is supported: {key}")
        said = value if isinstance(value, str) else json.dumps(value)
        condition = condition & (F.get_json_object("metadata", f"$.{key}") == said)
    return docs.where(condition)


def get_page(docs: DataFrame, columns: Sequence[str], limit: int, offset: int) -> DataFrame:
    """One page of rows in id order (a paging report)."""
    return docs.select(*columns).orderBy("doc_id").offset(offset).limit(limit)


def upsert_latest(table: DataFrame, batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """Replace whole rows by key; ids must be unique within a batch."""
    if not batch.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("ids repeat within the batch")
    rows = table.withColumn("_turn", F.lit(0)).unionByName(batch.withColumn("_turn", F.lit(1)))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_turn").desc()))
    return rows.withColumn("_k", newest).where("_k = 1").drop("_turn", "_k")


def insert_ignore(table: DataFrame, batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """Append rows whose key is new; of repeated new keys the first (by ``batch_order``) survives."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("batch_order"))
    new = batch.join(table.select(key), key, "left_anti").withColumn("_k", first).where("_k = 1")
    return table.unionByName(new.select(*table.columns))


def upsert_if_changed(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows by path: new content takes the batch's time, equal content keeps the old one."""
    old, new = (d.select("path", F.col("sha").alias(f"{n}_sha"), F.col("updated_at").alias(f"{n}_at")) for d, n in ((table, "old"), (batch, "new")))
    same = F.col("new_sha").isNull() | F.col("old_sha").eqNullSafe(F.col("new_sha"))
    return old.join(new, "path", "full_outer").select("path", F.coalesce("new_sha", "old_sha").alias("sha"), F.when(same, F.coalesce("old_at", "new_at")).otherwise(F.col("new_at")).alias("updated_at"))


def save_keep_provenance(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert of text and provenance; a null incoming provenance keeps the old one."""
    old, new = (d.select("doc_id", F.col("text").alias(f"{n}_text"), F.col("provenance").alias(f"{n}_p"), F.lit(True).alias(f"{n}_is")) for d, n in ((table, "old"), (batch, "new")))
    j = old.join(new, "doc_id", "full_outer")
    return j.select("doc_id", F.when(F.col("new_is"), F.col("new_text")).otherwise(F.col("old_text")).alias("text"), F.coalesce("new_p", "old_p").alias("provenance"))


def replace_document_chunks(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks after a re-ingest: all old chunks of a document go first, so a shorter text leaves no tail."""
    return chunks.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(incoming)


def _fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a hash of the rows that does not depend on their order."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.pmod(row, F.lit(1_000_000_007))), F.lit(0)).alias("content_hash"))


def export_with_manifest(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write each table as CSV, read it again, and report whether count and content are what was written."""
    out = None
    for name, df in tables.items():
        flat = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        options = {"header": True, "escape": '"', "quote": '"', "multiLine": True, "nullValue": "\\N"}
        flat.write.options(**options).csv(path)
        again = df.sparkSession.read.schema(flat.schema).options(**options).csv(path)
        said, got = _fingerprint(flat), _fingerprint(again)
        row = said.join(got.select(F.col("n_rows").alias("n_again"), F.col("content_hash").alias("hash_again"))).select(F.lit(name).alias("table"), "n_rows", "content_hash", ((F.col("n_rows") == F.col("n_again")) & (F.col("content_hash") == F.col("hash_again"))).alias("verified"))  # one row each
        out = row if out is None else out.union(row)
    return out


def reconcile_stores(left: DataFrame, right: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """One row: ids of one side only, rows with other content or metadata, largest difference of embeddings, verdict."""
    a, b = (d.select("id", F.struct("content", "metadata", F.col("embedding").cast("array<double>").alias("e")).alias(n)) for d, n in ((left, "a"), (right, "b")))
    gap = F.array_max(F.zip_with("a.e", "b.e", lambda x, y: F.abs(x - y)))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    facts = a.join(b, "id", "full_outer").agg(
        one(F.col("b").isNull()).alias("only_left"), one(F.col("a").isNull()).alias("only_right"),
        one(both & ~(F.col("a.content").eqNullSafe(F.col("b.content")) & F.col("a.metadata").eqNullSafe(F.col("b.metadata")))).alias("n_different"), F.max(F.when(both, gap)).alias("max_gap"),
    )
    ok = (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("n_different") == 0) & (F.coalesce("max_gap", F.lit(0.0)) < tolerance)
    return facts.select("only_left", "only_right", "n_different", F.round("max_gap", 6).alias("max_gap"), ok.alias("equal"))


class NamedQueries:
    """A registry of fixed read-only SELECTs over named DataFrames; anything but one plain SELECT is refused."""

    _WRITES = re.compile(r"\b(insert|update|delete|drop|create|alter|truncate|merge|grant|call|set|use|cache|refresh)\b", re.I)

    def __init__(self) -> None:
        self._sql: dict[str, str] = {}

    def register(self, name: str, sql: str) -> None:
        bare = re.sub(r"'[^']*'", "''", sql).strip().rstrip(";")
        if not re.match(r"(select|with)\b", bare, re.I) or ";" in bare or "--" in bare or "/*" in bare or self._WRITES.search(bare):
            raise ValueError(f"{name}: only one plain SELECT may be registered")
        self._sql[name] = sql

    def run(self, name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        if name not in self._sql:
            raise KeyError(name)
        spark = next(iter(tables.values())).sparkSession
        for view, df in tables.items():
            df.createOrReplaceTempView(view)
        return spark.sql(self._sql[name])


