"""Sharding by fixed virtual slots: rows hash into slots, a versioned map puts slots into shards."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import shared_dir, staged

#: Virtual slots.  Fixed for the life of a data set; bounds the map and all that the driver holds.
SLOTS = 4096


def map_folder(spark: SparkSession) -> str:
    """A new folder for the versions of a map, on storage that all executors share."""
    return shared_dir(spark, "shard-map")


def virtual_slot(doc_id, text, slots: int = SLOTS):
    """Slot of a row: by its id alone, so that an edited text stays; rows without an id go by their text."""
    return F.pmod(F.coalesce(F.xxhash64(doc_id) + F.lit(0) * doc_id, F.xxhash64(text), F.lit(0)), F.lit(slots)).cast("int")


def measure(docs: DataFrame, slots: int = SLOTS, overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, virtual slot of every row, staged once.

    A null text has no bytes and the checksum of the empty text.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot")),
        "shard-sizes")


@dataclass
class ShardMap:
    """Slot-to-shard assignment.  Each edit is a new version; rows never move but through their slot."""

    shards: int
    version: int
    slot_shard: list[int]
    slot_bytes: list[int]
    slot_rows: list[int]

    @classmethod
    def plan(cls, measured: DataFrame, shards: int, slots: int = SLOTS) -> "ShardMap":
        """Version 1: heaviest slot first onto the lightest shard.  The driver sees one row per slot."""
        loads = {r["virtual_slot"]: r for r in measured.groupBy("virtual_slot").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        size = [loads[s]["bytes"] if s in loads else 0 for s in range(slots)]
        rows = [loads[s]["n"] if s in loads else 0 for s in range(slots)]
        heap = [(0, k) for k in range(shards)]
        to = [0] * slots
        for s in sorted(range(slots), key=lambda s: (-size[s], s)):
            load, k = heapq.heappop(heap)
            to[s] = k
            heapq.heappush(heap, (load + size[s], k))
        return cls(shards, 1, to, size, rows)

    def shard_bytes(self) -> list[int]:
        out = [0] * self.shards
        for s, k in enumerate(self.slot_shard):
            out[k] += self.slot_bytes[s]
        return out

    def grow(self) -> "ShardMap":
        """Next version with one more shard: slots leave the fullest shards, and only for the new one."""
        new, to, load = self.shards, list(self.slot_shard), self.shard_bytes() + [0]
        mean = sum(load) / (new + 1)
        by_shard: dict[int, list[int]] = {}
        for s in sorted(range(len(to)), key=lambda s: (self.slot_bytes[s], -s)):
            by_shard.setdefault(to[s], []).append(s)
        heap = [(-load[k], k) for k in by_shard]
        heapq.heapify(heap)
        while heap and load[new] < mean:
            _, k = heapq.heappop(heap)
            if not by_shard[k] or load[k] <= mean:
                continue
            s = by_shard[k].pop()
            if load[new] + self.slot_bytes[s] <= mean * 1.001 or not load[new]:
                to[s] = new
                load[k] -= self.slot_bytes[s]
                load[new] += self.slot_bytes[s]
            heapq.heappush(heap, (-load[k], k))
        return ShardMap(new + 1, self.version + 1, to, self.slot_bytes, self.slot_rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per slot: shard, and how many rows of that shard stand in earlier slots."""
        before, out = [0] * self.shards, []
        for s, k in enumerate(self.slot_shard):
            out.append((self.version, s, k, before[k], self.slot_bytes[s], self.slot_rows[s]))
            before[k] += self.slot_rows[s]
        return spark.createDataFrame(out, "version int, virtual_slot int, shard int, rows_before long, slot_bytes long, slot_rows long")

    def save(self, spark: SparkSession, folder: str) -> str:
        """Write this version beside the others; a version is never overwritten."""
        path = f"{folder.rstrip('/')}/version={self.version:06d}"
        self.frame(spark).drop("version").coalesce(1).write.mode("errorifexists").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> "ShardMap":
        """The given version, else the newest."""
        t = spark.read.parquet(folder)
        if version is None:
            version = t.agg(F.max("version")).first()[0]
        rows = t.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(max(r["shard"] for r in rows) + 1, version, [r["shard"] for r in rows],
                   [r["slot_bytes"] for r in rows], [r["slot_rows"] for r in rows])


def assign(measured: DataFrame, smap: ShardMap) -> DataFrame:
    """Shard and place (gapless from 0 within the shard) of every measured row.

    Places are numbered within a virtual slot and shifted by the rows of the shard's earlier
    slots, so no task orders a whole shard.  Rows with equal ids are ordered by checksum.  The
    joined map has one row per slot and is broadcast for that reason.
    """
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    m = smap.frame(measured.sparkSession).select("virtual_slot", "shard", "rows_before")
    return measured.withColumn("place", F.row_number().over(w)).join(F.broadcast(m), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("place") - 1).alias("slot"), "virtual_slot")
