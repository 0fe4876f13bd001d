"""Inbox ingestion that knows earlier texts by filters: no batch reads all hashes that were ever stored (survey row T1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ingest as I
from ..operators.store import KeyedStore

#: Groups of hashes, each with a filter of its own; bits of a filter, and bits that one hash sets.
GROUPS, BITS, SETS = 256, 1 << 22, 7


class KnownHashes:
    """Hashes of all batches before: a Bloom filter for each group of hashes, and the hashes themselves.

    A filter is kept as rows (group, word, bits) of the words that are not zero, so it costs
    some ten bits for each hash and batches merge into it by OR.  A lookup reads the words of the
    groups that a batch touches, and exact hashes only of the groups where a filter says maybe.
    """

    def __init__(self, spark: SparkSession, path: str, groups: int = GROUPS, bits: int = BITS, sets: int = SETS):
        self.groups, self.bits, self.sets = groups, bits, sets
        self.filters = KeyedStore(spark, f"{path}/filters", "grp int, word int, bits long", ("grp",),
                                  lambda d: d.groupBy("grp", "word").agg(F.bit_or("bits").alias("bits")), min(groups, 64))
        self.hashes = KeyedStore(spark, f"{path}/hashes", "grp int, hash string", ("grp",), lambda d: d.distinct(), min(groups, 64))

    def _grouped(self, hashes: DataFrame) -> DataFrame:
        return hashes.select("hash", F.pmod(F.xxhash64("hash"), F.lit(self.groups)).cast("int").alias("grp")).distinct()

    def _marks(self, grouped: DataFrame) -> DataFrame:
        """(hash, grp, word, bits): the bits that each hash sets, one row for each."""
        places = F.array(*[F.pmod(F.xxhash64("hash", F.lit(k)), F.lit(self.bits)).cast("int") for k in range(1, self.sets + 1)])
        marked = grouped.select("hash", "grp", F.explode(F.array_distinct(places)).alias("p"))
        return marked.select("hash", "grp", F.floor(F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, p % 64)").alias("bits"))

    def maybe(self, hashes: DataFrame) -> DataFrame:
        """(hash, grp) of those that may be known; all that are known are among them."""
        grouped = self._grouped(hashes)
        marks = self._marks(grouped)
        words = self.filters.read(grouped.select("grp")).withColumnRenamed("bits", "have")
        met = marks.join(words, ["grp", "word"]).where(F.col("have").bitwiseAND(F.col("bits")) != 0)
        return met.groupBy("hash", "grp").agg(F.count("*").alias("n")).join(marks.groupBy("hash").agg(F.count("*").alias("m")), "hash").where("n = m").select("hash", "grp")

    def known(self, hashes: DataFrame) -> DataFrame:
        """(hash) of those stored before; exact hashes are read for the groups of possible ones only."""
        maybe = self.maybe(hashes)
        return self.hashes.read(maybe.select("grp")).join(maybe.select("hash"), "hash", "left_semi").select("hash")

    def last_batch(self) -> int:
        return self.filters.last_batch()

    def add(self, hashes: DataFrame, batch_id: int) -> None:
        """Hashes of a batch; the filters come last, so a batch that they hold is complete."""
        grouped = self._grouped(hashes)
        self.hashes.apply(grouped.select("grp", "hash"), batch_id)
        self.filters.apply(self._marks(grouped).select("grp", "word", "bits"), batch_id)


class Inbox:
    """A folder of texts taken in batch by batch: statuses, documents, their nodes and running totals."""

    def __init__(self, spark: SparkSession, target: str, groups: int = GROUPS, bits: int = BITS):
        self.spark, self.target = spark, target
        self.known = KnownHashes(spark, f"{target}/known", groups, bits)
        self.totals = KeyedStore(spark, f"{target}/totals", "status string, n long, chars long", ("status",),
                                 lambda d: d.groupBy("status").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")), 1)

    def take(self, batch: DataFrame, batch_id: int, min_chars: int = 50) -> None:
        """One batch of (doc_id, text).  A batch that was taken wholly before is left alone; one that broke off is taken again."""
        if batch_id <= self.known.last_batch():
            return
        hashes = batch.select(I.text_hash("text").alias("hash"))
        gated = I.quality_gate(batch, self.known.known(hashes), min_chars)
        gated.write.mode("overwrite").parquet(f"{self.target}/status/batch={batch_id}")
        status = self.spark.read.schema("doc_id string, status string").parquet(f"{self.target}/status/batch={batch_id}")
        rows = batch.join(status, "doc_id")
        new = rows.where("status = 'inserted'")
        new.drop("status").write.mode("overwrite").parquet(f"{self.target}/documents/batch={batch_id}")
        node = new.select(F.xxhash64(F.lit("document"), "doc_id").alias("id"), F.lit("document").alias("type"), F.col("doc_id").alias("name"))
        node.write.mode("overwrite").parquet(f"{self.target}/nodes/batch={batch_id}")
        self.totals.apply(rows.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), batch_id)
        self.known.add(new.select(I.text_hash("text").alias("hash")), batch_id)

    def follow(self, folder: str, checkpoint: str, files_per_batch: int | None = None, archive: str | None = None, min_chars: int = 50) -> None:
        """Take all files that are there, a number of them per batch, and move them to ``archive`` when they are done."""
        r = self.spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
        if files_per_batch:
            r = r.option("maxFilesPerTrigger", files_per_batch)
        if archive:
            r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        files = r.load(folder).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
        files.writeStream.foreachBatch(lambda batch, n: self.take(batch, n, min_chars)).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()

    def progress(self) -> DataFrame:
        """(status, n, chars) over all batches."""
        return self.totals.read()
