"""Heat-seeking exploration of many trails at once (survey row E26), state kept as tables by round.

A trail is one exploration with its own targets.  It works off a hot queue before a pending one
and the next target only when both are empty.  In each round every live trail pops one query and
all popped queries are searched in one job, so the number of rounds is the longest trail's, not
the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..session import staged

HOT, PENDING, TARGET = 0, 1, 2
# Curated hits that make a query hot, and cold queries running after which a trail is left.
HOT_HITS, COLD_RUN = 3, 3


def explore_trails(targets: DataFrame, search: Callable[[DataFrame], DataFrame], suggest: Callable[[DataFrame], DataFrame], curated: DataFrame,
                   pending: DataFrame | None = None, max_queries: int | None = None, hot_hits: int = HOT_HITS, cold_run: int = COLD_RUN) -> DataFrame:
    """(trail, step, query, curated_hits, heat, source) of every query that was run, in order of ``step`` from 1.

    ``targets`` and ``pending`` are (trail, ord, query).  ``search`` takes (query_id, query) and
    returns (query_id, doc_id); ``suggest`` takes those hits and returns (query_id, ord,
    suggestion, relevant, noise); ``curated`` is (doc_id).  Suggestions of a hot query go to
    the hot queue, those of a warm one to the pending queue: relevant ones to its front (the
    last one first), others that are no noise to its end.  A query runs once for each trail, letter
    case aside.  After ``cold_run`` cold queries without a hot queue the pending queue is
    dropped and the trail goes on with its next target.  A trail ends when nothing is left, or
    after ``max_queries``.
    """
    def queue_rows(df: DataFrame, kind: int) -> DataFrame:
        # items of a queue sort by (front, turn, ord): what is put in front later comes first
        return df.select("trail", F.lit(kind).alias("kind"), F.lit(1).alias("front"), F.lit(0).alias("turn"), F.col("ord").cast("int").alias("ord"), "query")

    queue = queue_rows(targets, TARGET)
    if pending is not None:
        queue = queue.unionByName(queue_rows(pending, PENDING))
    queue = staged(queue.where("query IS NOT NULL AND trail IS NOT NULL"), "queue")
    state = queue.select("trail").distinct().withColumn("cold", F.lit(0))
    done = queue.limit(0).select("trail", F.lit(0).alias("step"), "query", F.lit(0).cast("long").alias("curated_hits"), F.lit("").alias("heat"), F.lit("").alias("source"))
    step = 0
    while max_queries is None or step < max_queries:
        step += 1
        waiting = _not_run(queue, "query", done)
        item = F.struct("kind", "front", "turn", "ord", "query")
        popped = staged(waiting.groupBy("trail").agg(F.min(item).alias("m")).select("trail", "m.*"), "popped")
        if popped.isEmpty():
            break
        asked = popped.select(F.col("trail").alias("query_id"), "query")
        hits = staged(search(asked).select("query_id", "doc_id"), "hits")
        found = hits.join(curated.select("doc_id").distinct(), "doc_id", "left_semi").groupBy(F.col("query_id").alias("trail")).agg(F.count("*").alias("c"))
        heat = F.when(F.col("curated_hits") >= hot_hits, "hot").when(F.col("curated_hits") > 0, "warm").otherwise("cold")
        source = F.when(F.col("kind") == HOT, "hot").when(F.col("kind") == PENDING, "pending").otherwise("target")
        ran = staged(popped.join(found, "trail", "left").withColumn("curated_hits", F.coalesce("c", F.lit(0)).cast("long")).select(
            "trail", F.lit(step).alias("step"), "query", "curated_hits", heat.alias("heat"), source.alias("source"), "kind", "front", "turn", "ord"), "ran")
        done = done.unionByName(ran.select(*done.columns))
        # what is left of the queues: items before the popped one had all been run before
        left = waiting.join(ran.select("trail", F.struct("kind", "front", "turn", "ord", "query").alias("_m")), "trail").where(item > F.col("_m")).drop("_m")
        # suggestions: not run in this trail, and if they go to an end, or come from a warm query, not pending word for word
        news = suggest(hits).withColumnRenamed("query_id", "trail").join(ran.select("trail", "heat"), "trail").where("heat <> 'cold'")
        news = _not_run(news, "suggestion", done)
        same = left.where(F.col("kind") == PENDING).select("trail", F.col("query").alias("suggestion"), F.lit(True).alias("is_pending")).distinct()
        news = news.join(same, ["trail", "suggestion"], "left").withColumn("is_pending", F.coalesce("is_pending", F.lit(False)))
        hot = F.col("heat") == "hot"
        taken = news.where((F.col("relevant") & (hot | ~F.col("is_pending"))) | (~F.col("relevant") & ~F.col("noise") & ~F.col("is_pending")))
        # a warm query adds a text once: its first suggestion is pending for the later ones
        first = F.row_number().over(Window.partitionBy("trail", "suggestion").orderBy("ord"))
        taken = taken.withColumn("_n", first).where((F.col("_n") == 1) | hot).drop("_n")
        fresh = taken.select("trail", F.when(hot, HOT).otherwise(PENDING).alias("kind"), F.when(F.col("relevant"), 0).otherwise(1).alias("front"),
                             F.when(F.col("relevant"), -step).otherwise(step).alias("turn"), F.when(F.col("relevant"), -F.col("ord")).otherwise(F.col("ord")).cast("int").alias("ord"),
                             F.col("suggestion").alias("query"))
        left = staged(left.unionByName(fresh), "left")
        has_hot = left.where(F.col("kind") == HOT).select("trail").distinct().withColumn("has_hot", F.lit(True))
        # a target that is popped begins anew; a cold query counts on, all others reset
        run = F.when(F.col("heat") == "cold", F.when(F.col("source") == "target", 0).otherwise(F.col("cold")) + 1).otherwise(0)
        after = state.join(ran.select("trail", "heat", "source"), "trail").join(has_hot, "trail", "left").withColumn("cold", run)
        bounced = (F.col("cold") >= cold_run) & F.col("has_hot").isNull()
        after = staged(after.select("trail", F.when(bounced, 0).otherwise(F.col("cold")).alias("cold"), bounced.alias("bounced")), "state")
        queue = left.join(after.where("bounced").select("trail", F.lit(PENDING).alias("kind")), ["trail", "kind"], "left_anti")
        state = after.select("trail", "cold")
    return done


def _not_run(df: DataFrame, query: str, done: DataFrame) -> DataFrame:
    """Rows whose query their trail has not run yet, letter case aside."""
    ran = done.select("trail", F.lower("query").alias("_q")).distinct()
    return df.withColumn("_q", F.lower(query)).join(ran, ["trail", "_q"], "left_anti").drop("_q")
