"""Table copies with reconciliation and evidence packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """Row count and order-free content digest of a table."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(df.columns))), F.lit(0)).alias("digest")).select(
        F.lit(name).alias("table"), "n", "digest")


def reconcile(src: DataFrame, dst: DataFrame, name: str) -> DataFrame:
    a = table_digest(src, name).select("table", F.col("n").alias("n_src"), F.col("digest").alias("d_src"))
    b = table_digest(dst.select(*src.columns), name).select("table", F.col("n").alias("n_dst"), F.col("digest").alias("d_dst"))
    return a.join(b, "table").select("table", "n_src", "n_dst", ((F.col("n_src") == F.col("n_dst")) & (F.col("d_src") == F.col("d_dst"))).alias("same"))


def copy_table(df: DataFrame, path: str, fmt: str = "parquet", name: str = "table", **options) -> DataFrame:
    """Write, read back and reconcile; the result row says whether the copy is whole."""
    df.write.format(fmt).options(**options).mode("errorifexists").save(path)
    back = df.sparkSession.read.format(fmt).options(**options).schema(df.schema).load(path)
    return reconcile(df, back, name)


def evidence_package(spark: SparkSession, tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> DataFrame:
    """Write tables under ``path`` and return a manifest: one SHA-256 per file.

    :func:`package_hash` folds the manifest into one digest.
    """
    for name, df in tables.items():
        df.write.format(fmt).save(f"{path}/{name}")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*.{fmt}").load([f"{path}/{n}" for n in tables]))
    rel = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.select(rel.alias("file"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def package_hash(manifest: DataFrame) -> DataFrame:
    from ..operators.ingest import set_fingerprint

    return set_fingerprint(manifest.select(F.sha2(F.concat_ws(":", "file", "sha256"), 256).alias("h")), "h", 1, 256)


def convert_pending(files: DataFrame, done: DataFrame, converter, key: str = "path") -> DataFrame:
    """Convert files that have no output yet with a caller's Arrow batch function.

    ``converter`` maps batches of (key, content) to (key, text, error); empty texts
    are dropped and errors kept as rows.
    """
    todo = files.join(done.select(key).distinct(), key, "left_anti")
    out = todo.select(key, "content").mapInPandas(converter, f"{key} string, text string, error string")
    return out.where("error is not null or trim(text) <> ''")
