"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import staged

#: Split pattern of the rank files (fixed value of that public tokenizer family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(length, n_docs): how many rows encode to ``length`` tokens, over all rows and whole texts.

    Null and empty texts have length 0.  Every batch is counted before it is shuffled, so a
    length that a third of the rows share is one row per task; the histogram is staged, so
    that texts are encoded once however often it is read.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = encoding(path).encode_ordinary, Counter()
        for b in batches:
            for x in b.column(0):
                found[len(encode(x.as_py() or ""))] += 1
        yield pa.RecordBatch.from_pydict({"length": pa.array(found.keys(), pa.int64()), "n_docs": pa.array(found.values(), pa.int64())})

    counted = docs.select(F.col(text).alias("t")).mapInArrow(count, "length long, n_docs long")
    return staged(counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def suffix_sums(hist: DataFrame, width: int = 1024) -> DataFrame:
    """Per occurring length: documents and tokens there, at it or above, and the total if all were cut to it.

    Lengths are summed within blocks of ``width`` and then over the blocks; only the one row
    per block meets in a task.  ``quantile`` is the share of documents no longer than the length.
    """
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / width).alias("block"))
    per = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
                     F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    here = Window.partitionBy("block").orderBy("length").rowsBetween(0, Window.unboundedFollowing)
    s = h.join(per, "block").select(
        "length", "n_docs", "tokens", (F.sum("n_docs").over(here) + F.col("d_later")).alias("docs_at_least"),
        (F.sum("tokens").over(here) + F.col("t_later")).alias("tokens_at_least"), "d_all", "t_all")
    return s.select(
        "length", "n_docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("t_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("d_all")).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, truncated_total) for any context limits, read off the suffix sums.

    The total cut to a limit is that at the next occurring length above it, less what the
    documents there have beyond the limit; above the longest document nothing is cut.
    """
    q = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    per = sums.crossJoin(F.broadcast(q)).groupBy("limit").agg(
        F.min_by(F.struct("length", "docs_at_least", "truncated_total"), F.when(F.col("length") > F.col("limit"), F.col("length"))).alias("up"),
        F.max("truncated_total").alias("all"))
    return per.select("limit", F.coalesce("up.docs_at_least", F.lit(0)).alias("docs_over"), F.coalesce(
        F.col("up.truncated_total") - (F.col("up.length") - F.col("limit")) * F.col("up.docs_at_least"), "all").alias("truncated_total"))
