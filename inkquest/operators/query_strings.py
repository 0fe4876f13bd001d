"""Query strings (AND, OR, NOT, quotes, brackets) answered from positional postings.

A string is read into leaves (a word, or a phrase) and a postfix expression over them.  The
postings say which leaves hold in a document: a word by its posting, a phrase by positions that
follow one another.  The expression is then evaluated on the set of leaves that hold, so no text
is read and any nesting costs the same joins.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokenize
from ..session import BROADCAST_ROWS, broadcast_checked, reuse, staged
from .search import Index, of_pairs, ranked, score_terms

NOT, AND, OR = -1, -2, -3
_LEX = re.compile(r'"([^"]*)"?|([()])|([^\s()"]+)')
PARSED = "ops array<int>, leaves array<struct<text:string,positive:boolean>>, bare boolean"


def parse(query: str | None) -> tuple[list[int], list[tuple[str, bool]], bool]:
    """(postfix expression, leaves, whether it holds where no leaf does).

    Words next to each other are joined by AND, which binds closer than OR and looser than NOT.
    A missing bracket or quote is added at the end, operators without an operand and closing
    brackets without an opening one are skipped, operators are upper-case words.  A leaf is
    positive if it stands under an even number of NOTs.
    """
    tokens = [("phrase", m[1]) if m[1] is not None else ("bracket", m[2]) if m[2] else ("op" if m[3] in ("AND", "OR", "NOT") else "word", m[3])
              for m in _LEX.finditer(query or "")]
    leaves: list[tuple[str, bool]] = []

    def leaf(text: str, positive: bool) -> list[int]:
        if not re.search("[a-z0-9]{2}", text.lower()):
            return []
        leaves.append((text, positive))
        return [len(leaves) - 1]

    def join(parts: list[list[int]], op: int) -> list[int]:
        parts = [p for p in parts if p]
        return [x for p in parts for x in p] + [op] * (len(parts) - 1)

    # one frame for each open bracket: alternatives, factors of the last one, NOTs in front of the next factor, and the sign outside
    frames: list[dict] = [{"ors": [], "ands": [], "nots": 0, "sign": True}]

    def add(part: list[int]) -> None:
        f = frames[-1]
        if part:
            f["ands"].append(part + [NOT] * (f["nots"] % 2))
        f["nots"] = 0

    def close() -> list[int]:
        f = frames.pop()
        return join([*f["ors"], join(f["ands"], AND)], OR)

    for kind, value in tokens:
        f = frames[-1]
        sign = f["sign"] == (f["nots"] % 2 == 0)
        if kind in ("word", "phrase"):
            add(leaf(value, sign))
        elif value == "NOT":
            f["nots"] += 1
        elif value == "OR":
            f["ors"].append(join(f["ands"], AND))
            f["ands"], f["nots"] = [], 0
        elif value == "(":
            frames.append({"ors": [], "ands": [], "nots": 0, "sign": sign})
        elif value == ")" and len(frames) > 1:
            add(close())
    while len(frames) > 1:
        add(close())
    ops = close()
    stack: list[bool] = []
    for op in ops:
        if op >= 0:
            stack.append(False)
        elif op == NOT:
            stack.append(not stack.pop())
        else:
            a, b = stack.pop(), stack.pop()
            stack.append(a and b if op == AND else a or b)
    return ops, leaves, bool(stack and stack[-1])


def parsed(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, ops, leaves, bare) of every query string."""
    def run(batches):
        for b in batches:
            rows = [parse(q if isinstance(q, str) else None) for q in b["q"]]
            yield pd.DataFrame({"query_id": b["query_id"], "ops": [r[0] for r in rows], "leaves": [[{"text": t, "positive": p} for t, p in r[1]] for r in rows],
                                "bare": [r[2] for r in rows]})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", F.col(query).alias("q")).mapInPandas(run, f"query_id {kind}, {PARSED}")


def holds(ops: Column, leaves: Column) -> Column:
    """Value of a postfix expression where exactly the leaves of an array hold."""
    def apply(stack: Column, op: Column) -> Column:
        n = F.size(stack)
        top, below = F.element_at(stack, -1), F.element_at(stack, F.greatest(n - 1, F.lit(1)))
        rest = F.slice(stack, F.lit(1), F.greatest(n - F.when(op == NOT, 1).otherwise(2), F.lit(0)))
        return F.when(op >= 0, F.concat(stack, F.array(F.array_contains(leaves, op)))).otherwise(
            F.concat(rest, F.array(F.when(op == NOT, ~top).when(op == AND, top & below).otherwise(top | below))))

    return F.coalesce(F.get(F.aggregate(ops, F.array().cast("array<boolean>"), apply), F.lit(0)), F.lit(False))


def possible(index: Index, leaves: DataFrame, plan: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents that may satisfy their query, or hold a word of one that is bare.

    A phrase counts as held where all of its words are, and what is negated as absent: no document
    that satisfies a query is left out.  The postings are dealt by document and positions are not
    read, so what the queries make of the postings is neither shuffled nor wide.
    """
    held = index.postings.select("term", "doc_id").repartition("doc_id").join(broadcast_checked(leaves), "term")
    whole = held.groupBy("query_id", "doc_id", "leaf", "n_words", "positive").agg(F.count("*").alias("n")).where("n = n_words")
    found = whole.groupBy("query_id", "doc_id").agg(F.collect_set(F.when(F.col("positive"), F.col("leaf"))).alias("on"))
    return found.join(broadcast_checked(plan.select("query_id", "ops", "bare")), "query_id").where(F.col("bare") | holds(F.col("ops"), F.col("on"))).select("query_id", "doc_id")


def leaf_hits(index: Index, leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, leaf, doc_id) of every leaf that holds in ``pairs`` (query_id, doc_id); ``leaves`` is (query_id, leaf, n_words, ord, term)."""
    hits = of_pairs(index.postings.select("term", "doc_id", "positions"), broadcast_checked(leaves), pairs)
    words = hits.where("n_words = 1").select("query_id", "leaf", "doc_id")
    # the start that each word of a phrase would give it; one row for each phrase and document, no longer than the phrase
    starts = hits.where("n_words > 1").groupBy("query_id", "leaf", "doc_id", "n_words").agg(
        F.collect_list(F.transform("positions", lambda p: p - F.col("ord"))).alias("s")).where(F.size("s") == F.col("n_words"))
    common = F.aggregate(F.slice("s", F.lit(2), F.col("n_words") - 1), F.element_at("s", 1), lambda a, b: F.array_intersect(a, b))
    return words.unionByName(starts.where(F.size(common) > 0).select("query_id", "leaf", "doc_id"))


def query_string_search(index: Index | str, queries: DataFrame, k: int | None = 20, formula: str = "bm25") -> DataFrame:
    """(query_id, doc_id, score, rank): documents that satisfy each query string, by the words that are not negated.

    ``index`` is a positional index or the folder of a stored one, of which only the postings of
    the queries' words are read.  A query that holds where none of its words does (``NOT x``)
    returns all other documents too, with a score of 0.  Strings without words find nothing.
    ``k`` of None returns every match.
    """
    spark = queries.sparkSession
    plan = staged(parsed(queries), "queries")
    leaf = plan.select("query_id", F.posexplode("leaves").alias("leaf", "l")).select("query_id", "leaf", "l.positive", tokenize("l.text").alias("w"))
    leaves = leaf.select("query_id", "leaf", "positive", F.size("w").alias("n_words"), F.posexplode("w").alias("ord", "term"))
    if isinstance(index, str):
        index = Index.load(spark, index, leaves)
    index.postings = reuse(index.postings)
    pairs = staged(possible(index, leaves, plan), "pairs")
    matched = leaf_hits(index, leaves.drop("positive"), pairs).groupBy("query_id", "doc_id").agg(F.collect_set("leaf").alias("on"))
    kept = matched.join(broadcast_checked(plan.select("query_id", "ops", "bare")), "query_id").withColumn("ok", holds(F.col("ops"), F.col("on")))
    found = kept.where("ok").select("query_id", "doc_id")
    bare = [r["query_id"] for r in plan.where("bare").select("query_id").limit(BROADCAST_ROWS).collect()]
    if bare:
        every = index.documents.select("doc_id", F.explode(F.array(*map(F.lit, bare))).alias("query_id"))
        found = found.unionByName(every.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id"))
    terms = leaves.where("positive").groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    found = staged(found, "found")
    scored = found.join(score_terms(index, terms, formula, found).drop("hits"), ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored if k is None else ranked(scored, k)
