"""Operator inputs derived from the given tables (the same shapes as the SQL views)."""

from pyspark.sql import DataFrame, functions as F

from .registry import Tables


def messages(t: Tables) -> DataFrame:
    return t("documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"),
        F.concat("source", F.lit("@"), "source", F.lit(".example")).alias("sender"),
        F.expr("timestampadd(HOUR, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("date_sent"),
        F.col("text").alias("body"))


def scores(t: Tables) -> DataFrame:
    return t("labels").select(
        F.lit("document").alias("target_type"), F.col("doc_id").alias("target_id"),
        (50 + 40 * F.col("quality")).alias("pertinence"), (60 * F.col("toxic")).alias("suspicion"),
        F.lit(70).alias("confidence"))


def passages(t: Tables) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
