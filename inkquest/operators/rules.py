"""Rule classifiers and predicates driven by caller word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.text import col
from ..session import broadcast_checked
from .search import substring_join, top_per


def any_of(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def listing(df: DataFrame, equals: dict | None = None, like: dict | None = None, at_least: dict | None = None,
            order=(), id_col: str = "doc_id", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filtered listing: only the filters given apply; nulls last, ties by id."""
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    for c, v in (like or {}).items():
        if v is not None:
            df = df.where(F.col(c).ilike(f"%{v}%"))
    for c, v in (at_least or {}).items():
        if v is not None:
            df = df.where(F.col(c) >= v)
    df = df.orderBy(*[F.col(c).desc_nulls_last() for c in order], F.col(id_col).asc())
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def matched_lists(x, lexicon: dict[str, list[str]]) -> Column:
    """Names of the lists with a term inside the lower-case text (short lexicons, in-line)."""
    low = F.lower(col(x))
    return F.array_compact(F.array(*[F.when(any_of(low, terms), name) for name, terms in sorted(lexicon.items())]))


def lexicon_matches(docs: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, list_name, term, weight) for a lexicon table of any size (see ``substring_join``)."""
    return substring_join(docs, lexicon, text, "term", id_col)


def weighted_score(docs: DataFrame, lexicon: DataFrame, cap: float = 1.0, flag_over: float = 0.1,
                   text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Sum of the weights of the terms in a text, at most ``cap``; flagged above ``flag_over``."""
    hit = lexicon_matches(docs, lexicon, text, id_col).groupBy(id_col).agg(F.sum("weight").alias("w"), F.count("*").alias("terms"))
    score = F.round(F.least(F.coalesce("w", F.lit(0.0)), F.lit(cap)), 6)
    return docs.select(id_col).join(hit, id_col, "left").select(
        id_col, F.coalesce("terms", F.lit(0)).cast("bigint").alias("terms"), score.alias("score"), (score > flag_over).alias("flagged"))


def is_noise(x, noise_terms, min_len: int = 4) -> Column:
    """Empty, short, containing a noise term, or a number with blanks and hyphens."""
    low = F.trim(F.lower(F.coalesce(col(x), F.lit(""))))
    return (F.length(low) < min_len) | any_of(low, noise_terms) | F.regexp_like(F.translate(low, " -", ""), F.lit("^[0-9]+$"))


def filter_suggestions(suggestions: DataFrame, relevant_terms, noise_terms, strict: bool = True, k: int = 4) -> DataFrame:
    """At most ``k`` suggestions per query (query_id, query, pos, suggestion).

    Relevant ones first; when not strict, names of two or more capitalised words
    longer than eight characters fill up.
    """
    low, q = F.trim(F.lower("suggestion")), F.lower("query")
    relevant = any_of(low, relevant_terms)
    name_like = (F.length("suggestion") > 8) & F.regexp_like("suggestion", F.lit(r"^\s*[A-Z]\S*(?:\s+[A-Z]\S*)+\s*$"))
    rows = suggestions.where(~F.contains(q, low) & ~is_noise("suggestion", noise_terms))
    rows = rows.withColumn("tier", F.when(relevant, 0).when(name_like if not strict else F.lit(False), 1)).where("tier is not null")
    return top_per(rows, "query_id", k, "tier", "pos", "suggestion").select("query_id", "suggestion", "tier", "rank")


def topic_suggestions(queries: DataFrame, rules: DataFrame, default=(), k: int = 3) -> DataFrame:
    """Suggestions of the first rule (rule_order, term, pos, suggestion) whose term is in the query."""
    terms = rules.select("rule_order", "term").distinct()
    first = substring_join(queries, terms, "query", "term", "query_id").groupBy("query_id").agg(F.min("rule_order").alias("rule_order"))
    own = first.join(broadcast_checked(rules.select("rule_order", "pos", "suggestion").distinct()), "rule_order").select("query_id", "pos", "suggestion")
    if default:
        rest = queries.join(first, "query_id", "left_anti").select(
            "query_id", F.posexplode(F.array(*[F.lit(d) for d in default])).alias("pos", "suggestion"))
        own = own.unionByName(rest)
    asked = own.join(queries.select("query_id", F.lower("query").alias("_q")), "query_id").where(~F.contains("_q", F.lower("suggestion")))
    return top_per(asked, "query_id", k, "pos", "suggestion").select("query_id", "suggestion", "rank")


def topic_links(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """All (query_id, suggestion) of every rule whose term is in the query."""
    hits = substring_join(queries, rules.select("rule_order", "term").distinct(), "query", "term", "query_id")
    return hits.join(broadcast_checked(rules.select("rule_order", "suggestion").distinct()), "rule_order").select("query_id", "suggestion").distinct()


def content_mix(hits: DataFrame, junk_senders, junk_subjects, personal_domains, top: int = 25) -> DataFrame:
    """Share of junk and count of personal mail among the first hits of each query, with a label."""
    h = hits.where(F.col("rank") <= top)
    sender, subject = F.lower("sender"), F.lower("subject")
    junk = any_of(sender, junk_senders) | any_of(subject, junk_subjects)
    personal = ~junk & any_of(sender, [f"@{d}" for d in personal_domains]) & (F.length("subject") < 50) & ~F.contains(
        subject, F.lit("fwd")) & ~F.contains(subject, F.lit("re:"))
    n = h.groupBy("query_id").agg(F.count("*").alias("total"), F.count_if(junk).alias("junk"), F.count_if(personal).alias("personal"))
    ratio = F.col("junk") / F.col("total")
    return n.withColumn("mix", F.when(ratio > 0.7, "mostly_automated").when(ratio > 0.4, "mixed")
                        .when(F.col("personal") > 3, "personal").otherwise("standard"))


# Signal name and pattern on the lower-case text.
SIGNALS = [("deletion_request", r"\b(?:delete|destroy|shred|erase)\b"), ("urgency", r"\b(?:urgent|asap|immediately|right away)\b"),
           ("cash_mention", r"\b(?:cash|offshore|wire transfer)\b"), ("vague_reference", r"\b(?:the thing|you know what|that matter)\b")]


def message_signals(messages: DataFrame, signals=SIGNALS, quiet=(22, 6)) -> DataFrame:
    """(doc_id, signal) of text signals and of messages sent between the quiet hours."""
    low = X.ascii_fold(F.lower(F.concat_ws(" ", "subject", "body")))
    hour = F.hour("date_sent")
    late = (hour >= quiet[0]) | (hour < quiet[1])
    found = F.array_compact(F.array(*[F.when(F.regexp_like(low, F.lit(r)), n) for n, r in signals], F.when(late, "out_of_hours")))
    return messages.select("doc_id", F.explode(found).alias("signal"))
