"""Streaming jobs: idempotent append, windowed statistics, open requests, outbox drain, last-write memory, cost."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import working_folder


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with ``ts`` as TIMESTAMP."""
    schema = spark.read.parquet(path).schema  # a stream of files watches a folder, so one file is picked out of its folder by name
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    one_file = any(f.rpartition("/")[2] == name for f in spark.read.parquet(path).inputFiles())
    stream = reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over what is there now.  Restart-safe: offsets, state and output share one folder."""
    spark = stream.sparkSession
    root = f"{working_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{root}/out").start()
    query.awaitTermination()
    return None if each else spark.read.schema(stream.schema).parquet(f"{root}/out")


def drain_updates(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream in update mode; every batch's changed rows are kept under the batch's number."""
    root = f"{working_folder(stream.sparkSession)}/updates-{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/out").select(*stream.columns)


def stream_events(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Append each event id once; ids are remembered for ``lateness`` behind the newest event."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


#: A percentile's rank is off by at most one in so many values.
ACCURACY = 200


def stream_stats(requests: DataFrame, width: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Per closed window and path: requests, errors and the p95 of latency; with ``slide``, a window begins every so often.

    The percentile is that of a mergeable quantile summary, which is what the state holds of the values: its rank is off by
    at most one in ``ACCURACY`` values, and its size does not grow with them.
    """
    w = requests.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide), "path")
    found = w.agg(F.count("*").alias("n"), F.sum(F.when(F.col("http_status") >= 400, 1).otherwise(0)).alias("errors"), F.percentile_approx("latency_ms", 0.95, ACCURACY).alias("p95"))
    return found.select(F.col("window.start").alias("window_start"), "path", "n", "errors", F.round(F.col("errors") / F.col("n"), 4).alias("error_rate"), "p95")


def stream_open_requests(starts: DataFrame, completions: DataFrame, within: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Starts joined to their completion within a time; those without one come out once the watermark has passed."""
    s = starts.withWatermark("ts", lateness).alias("s")
    c = completions.withWatermark("ts", lateness).alias("c")
    bound = (F.col("c.request_id") == F.col("s.request_id")) & (F.col("c.ts") >= F.col("s.ts")) & (F.col("c.ts") <= F.col("s.ts") + F.expr(f"INTERVAL {within}"))
    return s.join(c, bound, "left_outer").select(F.col("s.request_id").alias("request_id"), F.col("s.ts").alias("started"), F.col("c.ts").alias("completed"))


def stream_observation_drain(lines: DataFrame, root: str) -> None:
    """Drain an outbox of JSON lines into ``root/rows``, with one ``root/report`` row for each batch.

    Malformed lines, repeats within the batch, lines older than the mark (the newest time that earlier batches have written),
    and rows that are there already (also with equal time stamps) are counted and not written.  The mark stands in the
    reports.  A batch is written under its number, so a batch that runs again replaces itself.
    """
    schema = "id string, observed_at string, decision string"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parsed = batch.select(F.from_json("value", schema).alias("o")).select("o.*")
        good = parsed.where("id IS NOT NULL AND observed_at IS NOT NULL")
        once = good.groupBy("id").agg(F.min(F.struct("observed_at", "decision")).alias("o")).select("id", "o.*")
        mark = spark.read.schema("mark string, batch bigint").option("basePath", f"{root}/report").parquet(f"{root}/report").where(F.col("batch") < number).agg(F.max("mark")).first()[0] if number else None
        new = once if mark is None else once.where(F.col("observed_at") >= mark)
        past = spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{root}/rows").parquet(f"{root}/rows").where(F.col("batch") != number) if number else None
        fresh = new if past is None else new.join(past.select("id"), "id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        counts = batch.agg(F.count("*").alias("n_lines")).join(good.agg(F.count("*").alias("n_good"))).join(once.agg(F.count("*").alias("n_once"))).join(new.agg(F.count("*").alias("n_not_below"))).join(spark.read.schema(schema).parquet(f"{root}/rows/batch={number}").agg(F.count("*").alias("n_new"), F.max("observed_at").alias("newest")))  # one row each
        counts.select(F.lit(number).cast("long").alias("batch"), "n_lines", (F.col("n_lines") - F.col("n_good")).alias("n_malformed"), (F.col("n_good") - F.col("n_once")).alias("n_repeated"), (F.col("n_once") - F.col("n_not_below")).alias("n_below"), (F.col("n_not_below") - F.col("n_new")).alias("n_known"), "n_new", F.greatest("newest", F.lit(mark).cast("string")).alias("mark")).write.mode("overwrite").parquet(f"{root}/report/batch={number}")

    query = lines.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


class _LastWrite(StatefulProcessor):
    """Keeps the newest (seq, value) of a key; emits it when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "seq long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        best = held
        for frame in rows:
            top = frame.loc[frame["seq"].idxmax()]
            if best is None or int(top["seq"]) > best[0]:
                best = (int(top["seq"]), top["value"])
        if best is not None and best != held:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "value": [best[1]]})

    def close(self) -> None:
        pass


def stream_memory(log: DataFrame) -> DataFrame:
    """Last write of each key across batches (value state in RocksDB)."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return log.groupBy("key").transformWithStateInPandas(_LastWrite(), "key string, seq long, value string", "Update", "None")


def stream_cost(usage: DataFrame, prices: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Priced usage by closed window and model; an unknown price counts as unpriced, not as 0."""
    cost = F.col("input_tokens") / 1e6 * F.col("input_rate") + F.col("output_tokens") / 1e6 * F.col("output_rate")
    priced = usage.withWatermark("ts", lateness).join(prices, ["model", "tier"], "left").withColumn("cost", cost)
    found = priced.groupBy(F.window("ts", width), "model").agg(F.round(F.sum("cost"), 8).alias("cost"), F.sum(F.when(F.col("cost").isNull(), 1).otherwise(0)).alias("n_unpriced"), F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("window_start"), "model", "cost", "n_unpriced", "n")
