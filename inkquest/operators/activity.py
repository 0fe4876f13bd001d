"""Event-time activity in batch: windows, repeats and sessions.

Every per-key order is cut into time buckets first, so a key that owns a large share
of the events is still worked off by many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def _seconds(ts):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(1_000_000.0)


def window_counts(events: DataFrame, key: str, width: str, slide: str | None = None) -> DataFrame:
    """Events per key in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def with_gap(events: DataFrame, keys: list[str], order: str, gap_seconds: int) -> DataFrame:
    """Adds ``gap`` (seconds to the event before of the same key) as far as it is at most about ``gap_seconds``.

    The event before is either in the same bucket of that width or the last one of the
    bucket before; anything older counts as no predecessor within reach.
    """
    e = events.withColumn("_t", _seconds(F.col("ts"))).withColumn("_b", F.floor(F.col("_t") / gap_seconds))
    last = e.groupBy(*keys, "_b").agg(F.max("_t").alias("_last")).withColumn("_b", F.col("_b") + 1)
    local = F.lag("_t").over(Window.partitionBy(*keys, "_b").orderBy("_t", order))
    return (e.withColumn("_prev", local).join(last, [*keys, "_b"], "left")
            .withColumn("gap", F.col("_t") - F.coalesce("_prev", "_last")).drop("_prev", "_last"))


def repeats(events: DataFrame, keys: list[str], order: str, ttl_seconds: int = 300) -> DataFrame:
    """Each event with ``is_repeat``: its key was stored at most the time-to-live before.

    A key is stored by its first event and by the first one after it has expired; a repeat
    does not renew it.  An event after a longer pause always stores, so only the events of one
    unbroken run depend on each other, and a run is stepped through by its stores.
    """
    runs = with_gap(events.select(*keys, order, "ts"), keys, order, ttl_seconds)
    runs = runs.withColumn("_new", F.coalesce(F.col("gap") > ttl_seconds, F.lit(True)).cast("int"))
    per = runs.groupBy(*keys, "_b").agg(F.sum("_new").alias("_s"))
    before = per.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s")).drop("_s")
    local = F.sum("_new").over(Window.partitionBy(*keys, "_b").orderBy("_t", order))
    runs = runs.withColumn("_run", local).join(before, [*keys, "_b"]).select(*keys, order, "_t", (F.col("_run") + F.col("_before")).alias("_run"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", order])
        t, stored = pdf["_t"].to_numpy(), 0
        repeat = np.ones(len(t), bool)
        while stored < len(t):
            repeat[stored] = False
            stored = int(np.searchsorted(t, t[stored] + ttl_seconds, side="right"))
        return pd.DataFrame({order: pdf[order].to_numpy(), "is_repeat": repeat})

    kind = events.schema[order].dataType.simpleString()
    runs = runs.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_run")))
    marked = runs.where("_n > 1").groupBy(*keys, "_run").applyInPandas(step, f"{order} {kind}, is_repeat boolean")
    alone = runs.where("_n = 1").select(order, F.lit(False).alias("is_repeat"))
    return events.join(marked.unionByName(alone), order)


def hit_rate(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count("*").alias("n"), F.count_if("is_repeat").alias("hits")).select("*", F.round(F.col("hits") / F.col("n"), 9).alias("hit_rate"))


def sessions(events: DataFrame, key: str, order: str, gap_seconds: int) -> DataFrame:
    """Sessions per key: (key, session, started, ended, n); a pause longer than the gap starts one.

    Session numbers are running counts of starts, carried across buckets by their totals.
    """
    g = with_gap(events, [key], order, gap_seconds).withColumn("_new", F.coalesce(F.col("gap") > gap_seconds, F.lit(True)).cast("int"))
    per = g.groupBy(key, "_b").agg(F.sum("_new").alias("_s"))
    before = per.withColumn("_before", F.sum("_s").over(Window.partitionBy(key).orderBy("_b")) - F.col("_s")).drop("_s")
    run = F.sum("_new").over(Window.partitionBy(key, "_b").orderBy("_t", order))
    s = g.withColumn("_run", run).join(before, [key, "_b"]).withColumn("session", F.col("_run") + F.col("_before"))
    return s.groupBy(key, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
