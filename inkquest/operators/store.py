"""Keyed tables that micro-batches merge into: versioned, bucketed, the same after any split into batches.

A store is a folder of Parquet files and a manifest for each version.  A batch adds one file per
touched bucket; a bucket that has gathered ``deltas`` of them is rewritten as one.  Reading merges
what the newest manifest lists, so a batch costs its own size and that of the buckets it fills up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X

MANIFEST = "bucket int, folders array<string>, batch_id long"


@dataclass
class KeyedStore:
    """Rows of ``schema`` (DDL), one per key once ``merge`` has grouped them.

    ``merge`` must be associative, as it is applied to rows that were merged before.  Batches
    are numbered from 0; one that was applied already (a replay) changes nothing.  At most
    ``buckets`` rows of a manifest pass through the driver.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 32
    deltas: int = 4

    def _manifest(self) -> tuple[int, int, dict[int, list[str]]]:
        """(version, last batch, folders of each bucket) of the newest complete version."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0, -1, {}
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
        if not done:
            return 0, -1, {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={max(done)}").collect()
        return max(done), max(r["batch_id"] for r in rows), {r["bucket"]: list(r["folders"]) for r in rows if r["bucket"] >= 0}

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The merged rows of all batches applied so far; with ``keys`` only of the buckets that hold one of them."""
        folders = self._manifest()[2]
        if keys is not None:
            wanted = {r["bucket"] for r in keys.select(self._bucket()).distinct().collect()}  # at most one row for each bucket
            folders = {b: f for b, f in folders.items() if b in wanted}
        return self.merge(self._load([f for some in folders.values() for f in some]))

    def last_batch(self) -> int:
        """The newest batch that was applied, -1 before the first."""
        return self._manifest()[1]

    def apply(self, rows: DataFrame, batch_id: int) -> bool:
        """Merge a batch; False if it had been applied before.

        The manifest is written last, so a batch that breaks off leaves the store as it was.
        """
        version, last, folders = self._manifest()
        if batch_id <= last:
            return False
        version += 1
        bucket = self._bucket()
        self.merge(rows).select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        touched = [r["bucket"] for r in self.spark.read.parquet(f"{self.path}/data/v={version}").select("bucket").distinct().collect()] if self._wrote(version) else []
        for b in touched:
            folders[b] = [*folders.get(b, []), f"data/v={version}/bucket={b}"]
        full = [b for b in touched if len(folders[b]) > self.deltas]
        if full:
            old = self.merge(self._load([f for b in full for f in folders[b]]))
            old.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}-whole")
            folders |= {b: [f"data/v={version}-whole/bucket={b}"] for b in full}
        lines = [(-1, [], batch_id), *((b, f, batch_id) for b, f in sorted(folders.items()))]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        return True

    def _wrote(self, version: int) -> bool:
        """Whether a version has any bucket (an empty batch has none)."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/v={version}")
        return any(s.isDirectory() for s in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root))


# ---------------------------------------------------------------- nested metadata as rows

def metadata_rows(df: DataFrame, keys: list[str], seq: str = "seq", metadata: str = "metadata") -> DataFrame:
    """(keys, path, last_seq, value) of every leaf of a JSON object; ``path`` holds the names from the top, value is JSON.

    Null, malformed and other than object metadata have no leaf; an empty object is a leaf.
    """
    import json

    def flatten(text):
        try:
            top = json.loads(text) if text else None
        except ValueError:
            top = None
        out, stack = [], [((k,), v) for k, v in top.items()] if isinstance(top, dict) else []
        while stack:
            path, v = stack.pop()
            if isinstance(v, dict) and v:
                stack += [((*path, k), x) for k, x in v.items()]
            else:
                out.append({"path": list(path), "value": json.dumps(v, sort_keys=True)})
        return out

    @F.pandas_udf("array<struct<path:array<string>,value:string>>")
    def leaves(text: pd.Series) -> pd.Series:
        return text.map(flatten)

    return df.select(*keys, F.col(seq).alias("last_seq"), F.explode(leaves(metadata)).alias("l")).select(*keys, "l.path", "last_seq", "l.value")


def nested_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metadata): the leaves put together, later ones first where one stands inside another.

    The result is what merging the objects one after another by ``last_seq`` gives: objects are
    merged name by name, anything else is replaced.  The leaves of one node meet in one row.
    """
    import json

    def build(entries):
        top: dict = {}
        placed: list[tuple[tuple, int, str]] = []
        for e in sorted(entries, key=lambda e: (-e["last_seq"], len(e["path"]), e["value"])):
            path = tuple(e["path"])
            inside = any(q[:len(path)] == path for q, _, _ in placed)
            if any(path[:len(q)] == q and v != "{}" for q, _, v in placed) or inside:
                continue
            placed.append((path, e["last_seq"], e["value"]))
        for path, _, value in sorted(placed, key=lambda p: len(p[0])):
            at = top
            for name in path[:-1]:
                at = at.setdefault(name, {})
            if value != "{}" or path[-1] not in at:
                at[path[-1]] = json.loads(value)
        return json.dumps(top, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    @F.pandas_udf("string")
    def whole(entries: pd.Series) -> pd.Series:
        return entries.map(build)

    return rows.groupBy(*keys).agg(F.collect_list(F.struct("path", "last_seq", "value")).alias("e")).select(*keys, whole("e").alias("metadata"))


# ---------------------------------------------------------------- the graph

def _first(df: DataFrame, keys: list[str], columns: list[str], counted: str) -> DataFrame:
    m = df.groupBy(*keys).agg(F.min(F.struct("first_seq", *columns)).alias("m"), F.sum(counted).alias(counted))
    return m.select(*keys, "m.first_seq", *[f"m.{c}" for c in columns], counted)


def _last(df: DataFrame) -> DataFrame:
    m = df.groupBy("type", "name_normalized", "path").agg(F.max(F.struct("last_seq", "value")).alias("m"))
    return m.select("type", "name_normalized", "path", "m.last_seq", "m.value")


class GraphStore:
    """Nodes, their metadata and edges, kept up batch by batch.

    Nodes are merged on (type, normalised name): first name and source stay, mentions add up,
    metadata is merged deeply with the later batch on top.  Edges are merged on (src, dst, type)
    without self loops; the first excerpt stays.  ``seq`` orders first and last, so it must not
    repeat for one key.  Nodes without a name and edges without both ends are left out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, deltas: int = 4):
        def store(name, schema, keys, merge):
            return KeyedStore(spark, f"{path}/{name}", schema, keys, merge, buckets, deltas)

        self.nodes_ = store("nodes", "type string, name_normalized string, first_seq long, name string, source_id long, mentions long", ("type", "name_normalized"),
                            lambda d: _first(d, ["type", "name_normalized"], ["name", "source_id"], "mentions"))
        self.metadata_ = store("metadata", "type string, name_normalized string, path array<string>, last_seq long, value string", ("type", "name_normalized"), _last)
        self.edges_ = store("edges", "src long, dst long, type string, first_seq long, excerpt string, seen long", ("src", "dst", "type"),
                            lambda d: _first(d, ["src", "dst", "type"], ["excerpt"], "seen"))

    def apply(self, batch_id: int, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """``nodes`` is (type, name, source_id, seq, metadata), ``edges`` (src, dst, type, excerpt, seq).  Safe to repeat."""
        if nodes is not None:
            key = X.normalize_name("name")
            named = nodes.where("name IS NOT NULL").withColumn("name_normalized", key).where("name_normalized <> ''")
            self.nodes_.apply(named.select("type", "name_normalized", F.col("seq").alias("first_seq"), "name", "source_id", F.lit(1).cast("long").alias("mentions")), batch_id)
            self.metadata_.apply(metadata_rows(named, ["type", "name_normalized"]), batch_id)
        if edges is not None:
            kept = edges.where("src <> dst")
            self.edges_.apply(kept.select("src", "dst", "type", F.col("seq").alias("first_seq"), "excerpt", F.lit(1).cast("long").alias("seen")), batch_id)

    def nodes(self) -> DataFrame:
        """(type, name_normalized, name, source_id, mentions, metadata) of all nodes; metadata is ``{}`` where none was given."""
        meta = nested_metadata(self.metadata_.read(), ["type", "name_normalized"])
        return self.nodes_.read().join(meta, ["type", "name_normalized"], "left").select(
            "type", "name_normalized", "name", "source_id", "mentions", F.coalesce("metadata", F.lit("{}")).alias("metadata"))

    def edges(self) -> DataFrame:
        return self.edges_.read().select("src", "dst", "type", "excerpt", "seen")
