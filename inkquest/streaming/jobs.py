"""Structured Streaming jobs: inbox ingestion, limits, repeats, sessions, counts, incremental merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest as I
from ..operators.store import GraphStore
from ..session import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema: T.StructType, watermark: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream with ``ts`` as UTC timestamp."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    e = r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", watermark) if watermark else e


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all available input into Parquet files and return them."""
    schema = stream.schema
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(schema).parquet(path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    return run_to_files(stream, shared_dir(spark, f"{name}-out"), shared_dir(spark, f"{name}-ckpt"))


# ---------------------------------------------------------------- T3, T4: per-client decisions

class SlidingLimit(StatefulProcessor):
    """Accept at most ``limit`` events per client in any ``seconds``; rejected ones do not count.

    State is the list of accepted times within reach, never longer than the limit.
    """

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("accepted", T.StructType([T.StructField("t", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
        kept = [r[0] for r in self.times.get()] if self.times.exists() else []
        out = []
        for t in pdf["t"]:
            kept = [k for k in kept if t - k < self.seconds]
            ok = len(kept) < self.limit
            if ok:
                kept.append(float(t))
            out.append(ok)
        if kept:
            self.times.put([(k,) for k in kept])
        else:
            self.times.clear()
        yield pd.DataFrame({"client": key[0], "event_id": pdf["event_id"].to_numpy(), "accepted": out})

    def close(self) -> None:
        pass


class TokenBucket(StatefulProcessor):
    """Accept an event when the client's bucket holds a token; refills at ``rate`` per second up to ``burst``."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("at", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
        tokens, at = self.bucket.get() if self.bucket.exists() else (self.burst, None)
        out = []
        for t in pdf["t"]:
            if at is not None:
                tokens = min(self.burst, tokens + max(t - at, 0.0) * self.rate)
            at = float(t)
            ok = tokens >= 1
            tokens -= 1 if ok else 0
            out.append(ok)
        self.bucket.update((float(tokens), float(at)))
        yield pd.DataFrame({"client": key[0], "event_id": pdf["event_id"].to_numpy(), "accepted": out})

    def close(self) -> None:
        pass


class TtlCache(StatefulProcessor):
    """Accept an event when its key is not cached; a cached key expires ``seconds`` after it was stored."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", T.StructType([T.StructField("at", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
        at = self.stored.get()[0] if self.stored.exists() else None
        out = []
        for t in pdf["t"]:
            fresh = at is None or t - at > self.seconds
            at = float(t) if fresh else at
            out.append(fresh)
        self.stored.update((float(at),))
        yield pd.DataFrame({"client": key[0], "event_id": pdf["event_id"].to_numpy(), "accepted": out})

    def close(self) -> None:
        pass


DECISION = "client long, event_id long, accepted boolean"


def decide(events: DataFrame, client: str, processor: StatefulProcessor) -> DataFrame:
    """Run a per-client processor over (client, event_id, ts)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    slim = events.select(F.col(client).alias("client"), "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return slim.groupBy("client").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType.fromDDL(DECISION), outputMode="append", timeMode="None")


# ---------------------------------------------------------------- T5-T7: declarative event time

def first_in_ttl(events: DataFrame, keys: list[str], ttl: str = "300 seconds") -> DataFrame:
    """First event of each key per time-to-live, as far as the engine guarantees it.

    Repeats within the time-to-live are always dropped; a later event of the same
    micro-batch may be dropped too.  :class:`TtlCache` decides every event exactly.
    """
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def session_stream(events: DataFrame, key: str, gap: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n")


def tumbling_stream(events: DataFrame, key: str, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("window_start"), "n")


# ---------------------------------------------------------------- T1, T2, T8: micro-batch merges

def ingest_inbox(spark: SparkSession, inbox: str, target: str, checkpoint: str, archive: str | None = None, min_chars: int = 50) -> DataFrame:
    """New text files pass the quality gate into ``target``; returns the statuses written.

    Each micro-batch writes its own folder, overwritten when the batch is replayed, so a
    restart never doubles a document.  Known hashes are those of earlier batches.
    """
    r = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = r.load(inbox).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("doc_id"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        known = _earlier(spark, f"{target}/hashes", batch_id, "hash string")
        gated = I.quality_gate(batch, known, min_chars)
        gated.write.mode("overwrite").parquet(f"{target}/status/batch={batch_id}")
        ok = batch.join(gated.where("status = 'inserted'").select("doc_id"), "doc_id", "left_semi")
        ok.write.mode("overwrite").parquet(f"{target}/documents/batch={batch_id}")
        ok.select(I.text_hash("text").alias("hash")).write.mode("overwrite").parquet(f"{target}/hashes/batch={batch_id}")

    files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id string, status string, batch int").parquet(f"{target}/status")


def _earlier(spark: SparkSession, path: str, batch_id: int, ddl: str) -> DataFrame | None:
    """Rows of the batches before ``batch_id`` (None for the first)."""
    if batch_id == 0:
        return None
    return spark.read.schema(f"{ddl}, batch int").parquet(path).where(F.col("batch") < batch_id).drop("batch")


def tail_log(spark: SparkSession, folder: str, target: str, checkpoint: str) -> DataFrame:
    """Entries of dated logs added since the last run."""
    from ..sources.readers import dated_log

    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    entries = dated_log(raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))
    return run_to_files(entries, target, checkpoint)


def merge_counts(events: DataFrame, key: str, target: str, checkpoint: str) -> DataFrame:
    """First-seen and count per key, kept up by micro-batches.

    A batch adds one pre-aggregated delta (replays overwrite it); the state is the
    aggregate of the deltas, so the write of a batch grows with the batch only.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        delta = batch.groupBy(key).agg(F.min("ts").alias("first_seen"), F.count("*").alias("n"))
        delta.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.sum("n").alias("n"))


def graph_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int = 1, buckets: int = 32) -> GraphStore:
    """Files of nodes (type, name, source_id, seq, metadata) merged into a stored graph, a few per micro-batch.

    A replayed batch is known by its number, so the graph is the same however the files fall
    into batches and however often a batch is tried.
    """
    store = GraphStore(spark, target, buckets)
    nodes = (spark.readStream.schema("type string, name string, source_id long, seq long, metadata string")
             .option("maxFilesPerTrigger", files_per_batch).parquet(folder))

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch_id, batch)

    nodes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return store
