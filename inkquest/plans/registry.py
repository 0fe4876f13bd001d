"""Registered queries: name -> (Spark plan, equivalent SQL or None)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

PLANS: dict[str, Callable[["Tables"], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass
class Tables:
    """The Parquet tables of one folder, opened on demand."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def text(self, name: str, key: str) -> DataFrame:
        """A table whose rows are costly to process, spread over all cores."""
        return spread(self(name), key)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def query(name: str, sql: str | None = None):
    """Register a plan (a function of Tables) under ``name``."""

    def add(fn):
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
