"""Corpus pipeline: each stage reads what its predecessor wrote and returns documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkquest.llm import stages

STAGES = stages.STAGES
#: No stage but the last could be stated in SQL, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    return stages.run(spark, sf_dir, STAGES)
