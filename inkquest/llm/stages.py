"""The stages of the corpus pipeline, each one of the operators with its decision carried out."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from . import bpe, decontam, quality, simhash, suffix
from .queries import table, tokenizer_file


def aside(stage):
    """Run a stage with all columns but those it works on under neutral names, and give them back after it."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        inner = [c if c in ("doc_id", "text", "n_chars") else f"_x{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*[F.col(i).alias(c) for i, c in zip(inner, names)])

    return run


@aside
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), usable=~quality.held_out(F.col("doc_id"), 4, 2))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD)


@aside
def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five words and a similarity of 0.8."""
    return simhash.keep_one(docs)


@aside
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; emptied documents stay, as rows without text."""
    return _recount(suffix.remove_repeats(docs), docs)


@aside
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that mostly consist of them go."""
    clean = decontam.clean(docs, table(spark, sf_dir, "benchmark"))
    return _recount(clean, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with its token ids, their number and the digests of the round trip; columns of these names are replaced."""
    return bpe.with_ids(docs, tokenizer_file("byte_bpe_50k.json"))


def _recount(df: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" in like.columns:
        df = df.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return df.select(*like.columns)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("repeats", cut_repeats), ("benchmark", cut_benchmark), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str, stages) -> DataFrame:
    """Each stage's result is written and read again, so that the next one starts from files."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return stages[-1][1](spark, docs, sf_dir)
