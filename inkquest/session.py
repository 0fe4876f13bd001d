"""Session settings and the few execution helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

# Rows up to which a caller-sized table (lexicon, query list, code table) is
# broadcast.  Above it the same join runs as a shuffle join.
BROADCAST_ROWS = 200_000


def build_session(app: str = "inkquest", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Only adaptive execution, UTC and Arrow are set here; cluster sizing
    (executors, memory, shuffle partitions) is left to spark-submit.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder on the storage all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (local runs and tests) is a local folder used; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "local") + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "rdd-checkpoints"))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write once to shared storage and read back (a columnar checkpoint)."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Split a table that arrives in fewer partitions than there are cores.

    A small file is one task however costly its rows are.  Tables with enough
    partitions, as any large one has, pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def row_bound(df: DataFrame, bound: int) -> int | None:
    """Row count if it is at most ``bound``, else None (stops counting early)."""
    n = df.limit(bound + 1).count()
    return n if n <= bound else None


def broadcast_checked(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven to be within ``bound``.

    Beyond the bound the frame is returned unhinted and Spark plans a shuffle
    join (with adaptive skew handling), so the result is the same.
    """
    return F.broadcast(df) if row_bound(df, bound) is not None else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the input: its join never becomes a broadcast.

    Spark sizes a table from its files and takes an explode for no growth, and a broadcast that
    is planned once is not taken back when the table turns out larger.
    """
    return df.hint("merge")


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that two branches of one job read (spills to disk, lineage kept)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
