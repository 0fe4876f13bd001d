"""Ingestion: quality gate, exact duplicates, chunking, classification, work queues, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.ml.feature import Bucketizer

from ..functions import text as X
from ..functions.text import col
from ..session import broadcast_checked


def text_hash(x) -> Column:
    return F.sha2(col(x), 256)


# ---------------------------------------------------------------- gate and duplicates

def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id of the first copy (smallest id) of every distinct text.

    Only (hash, id) moves, and the partial ``min`` collapses a text with very many
    copies before the shuffle.
    """
    return docs.select(text_hash(text_col).alias("hash"), F.col(id_col)).groupBy("hash").agg(F.min(id_col).alias(id_col))


def quality_gate(docs: DataFrame, known_hashes: DataFrame | None = None, min_chars: int = 50,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Status of each document: ``too_short``, ``duplicate`` or ``inserted``.

    Copies are recognised by joining on the unique id of each first copy, never on
    the hash itself, so a text with many copies is no hot join key.
    """
    long_enough = docs.where(F.length(F.trim(col(text_col))) >= min_chars)
    fresh = first_copies(long_enough, id_col, text_col)
    if known_hashes is not None:
        fresh = fresh.join(known_hashes.select("hash").distinct(), "hash", "left_anti")
    fresh = fresh.select(id_col, F.lit(True).alias("fresh"))
    narrow = docs.select(id_col, F.coalesce(F.length(F.trim(col(text_col))), F.lit(0)).alias("chars"))
    return narrow.join(fresh, id_col, "left").select(
        id_col, F.when(F.col("chars") < min_chars, "too_short")
        .when(F.col("fresh"), "inserted").otherwise("duplicate").alias("status"))


def drop_exact_duplicates(docs: DataFrame, existing: DataFrame | None = None,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose text is the first copy in the batch and absent from ``existing``."""
    keep = first_copies(docs, id_col, text_col)
    if existing is not None:
        keep = keep.join(existing.select(text_hash(text_col).alias("hash")).distinct(), "hash", "left_anti")
    return docs.join(keep.select(id_col), id_col, "left_semi")


def skip_known(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Messages whose body and subject are both absent from ``known`` (two equi anti-joins)."""
    bodies = known.where("body is not null").select(text_hash("body").alias("h")).distinct()
    subjects = known.where("subject is not null").select("subject").distinct()
    return (messages.join(bodies, text_hash("body") == F.col("h"), "left_anti")
            .join(subjects, "subject", "left_anti"))


# ---------------------------------------------------------------- chunks

def chunk_documents(docs: DataFrame, size: int = 2000, overlap: int = 200, long_over: int = 50_000,
                    long_size: int = 10_000, long_overlap: int = 500,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Overlapping chunks; very long documents use the larger chunk size."""
    pieces = F.when(F.length(text_col) > long_over, X.chunks(text_col, long_size, long_overlap)).otherwise(
        X.chunks(text_col, size, overlap))
    return docs.select(id_col, F.posexplode(pieces).alias("chunk_index", "content"))


def join_chunks(chunks: DataFrame, sep: str = "\n\n", id_col: str = "doc_id") -> DataFrame:
    """Chunks of a document in index order joined by ``sep``."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda c: c["content"]), sep).alias("content"))


# ---------------------------------------------------------------- document types

# Ordered first-match rules.  A rule is (label, alternatives); an
# alternative is a list of (field, marker) that must all occur.
TYPE_RULES = {
    "content": [
        ("email", [[("content", "from:"), ("content", "subject:")]]),
        ("deposition", [[("content", "deposition")], [("content", "q."), ("content", "a.")]]),
        ("transcript", [[("content", "transcript")]]),
        ("court_filing", [[("content", "court")], [("content", "plaintiff")]]),
    ],
    "name_first": [
        ("deposition", [[("name", "deposition")], [("content", "q."), ("content", "a.")]]),
        ("email", [[("content", "from:"), ("content", "subject:")]]),
        ("transcript", [[("content", "transcript")]]),
        ("court_filing", [[("content", "court")], [("content", "plaintiff")], [("content", "defendant")]]),
    ],
    "name_only": [("deposition", [[("name", "deposition")]])],
}
# Label when no rule fires.
TYPE_DEFAULT = {"content": "misc", "name_first": "misc", "name_only": "transcript"}
# Stored type of a loader's type; all others are "misc".
STORED_TYPE = {"flight_log": "dataset", "flight_log_summary": "dataset", "court_document": "court_filing"}


def document_type(content, name=None, rules="content", default: str | None = None) -> Column:
    """First rule whose markers occur in the lower-case content or file name."""
    table = TYPE_RULES[rules] if isinstance(rules, str) else rules
    default = default or TYPE_DEFAULT.get(rules if isinstance(rules, str) else "", "misc")
    field = {"content": F.lower(col(content)), "name": F.lower(col(name)) if name is not None else F.lit("")}
    out = None
    for label, alternatives in table:
        hit = F.lit(False)
        for alt in alternatives:
            both = F.lit(True)
            for f, marker in alt:
                both = both & F.contains(field[f], F.lit(marker))
            hit = hit | both
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def stored_type(x) -> Column:
    out = None
    for k, v in STORED_TYPE.items():
        out = F.when(col(x) == k, v) if out is None else out.when(col(x) == k, v)
    return out.otherwise("misc")


# ---------------------------------------------------------------- sources, queue, audit

def merge_sources(sources: DataFrame, batch: DataFrame) -> DataFrame:
    """Known sources (source, doc_count, chars) with the batch (source, n_chars) added."""
    new = batch.groupBy("source").agg(F.count("*").alias("new_docs"), F.sum("n_chars").alias("new_chars"))
    return sources.join(new, "source", "full_outer").select(
        "source", (F.coalesce("doc_count", F.lit(0)) + F.coalesce("new_docs", F.lit(0))).alias("doc_count"),
        (F.coalesce("chars", F.lit(0)) + F.coalesce("new_chars", F.lit(0))).alias("chars"),
        F.col("doc_count").isNull().alias("created"))


def unprocessed(docs: DataFrame, audit: DataFrame, action: str, id_col: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Documents with no audit row for ``action``; null audit ids never hide a document."""
    done = audit.where((F.col("action") == action) & F.col("target_id").isNotNull()).select(
        F.col("target_id").alias(id_col)).distinct()
    out = docs.join(done, id_col, "left_anti")
    return out.orderBy(id_col).limit(limit) if limit else out


def audit_rows(stats: DataFrame, target_type: str, action: str, reason: str, id_col: str = "doc_id") -> DataFrame:
    """Audit rows whose ``new_value`` is the JSON of all columns but the id."""
    rest = [c for c in sorted(stats.columns) if c != id_col]
    return stats.select(F.lit(target_type).alias("target_type"), F.col(id_col).alias("target_id"),
                        F.lit(action).alias("action"), F.to_json(F.struct(*rest)).alias("new_value"),
                        F.lit(reason).alias("reason"))


def evidence_hash(*columns) -> Column:
    """First 16 hex digits of the SHA-256 of the JSON of the named columns in key order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


# ---------------------------------------------------------------- sync (I11), filter

def sync_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys only in ``a`` and keys only in ``b``."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return (left.join(right, key, "left_anti").withColumn("side", F.lit("only_a"))
            .unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("only_b"))))


def set_fingerprint(df: DataFrame, hash_col: str, prefix: int = 3, bits: int = 512) -> DataFrame:
    """Order-free fingerprint of a set of hex hashes.

    A two-level tree: hashes that share their first ``prefix`` digits are folded
    together, then the folded digests.  Hash prefixes are uniform, so no task sees
    more than about 16**-prefix of the set.
    """
    leaves = (df.select(F.col(hash_col).alias("h")).distinct()
              .groupBy(F.left("h", F.lit(prefix)).alias("p"))
              .agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), bits).alias("d")))
    ordered = F.array_sort(F.collect_list(F.struct("p", "d")))
    return leaves.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda s: s["d"]), ""), bits).alias("fingerprint"))


def substantial(messages: DataFrame, min_chars: int, subject_patterns: list[str]) -> DataFrame:
    """Messages longer than ``min_chars`` whose subject is like none of the patterns."""
    keep = F.length("body") > min_chars
    for p in subject_patterns:
        keep = keep & ~F.col("subject").ilike(p)
    return messages.where(keep)


# ---------------------------------------------------------------- numbering at scale

# Rows of a slice that one task puts in order, and slices of a group at most.
SLICE_ROWS, GROUP_SLICES = 1_000_000, 256


def slices_for(df: DataFrame, least: int = 256) -> int:
    """How many slices keep each within SLICE_ROWS."""
    return max(least, -(-df.count() // SLICE_ROWS))


def group_slices(df: DataFrame, group: str, key: str, out: str = "_b") -> DataFrame:
    """``df`` with a slice number that rises with ``key`` within its group.

    Groups are cut at approximate quantiles of their own keys, so slices are about equal
    however sparse or uneven the keys are; small groups have few distinct cuts.
    """
    probs = [i / GROUP_SLICES for i in range(1, GROUP_SLICES)]
    cuts = df.groupBy(F.col(group).alias("_g")).agg(F.array_distinct(F.percentile_approx(F.col(key).cast("double"), probs, 10_000)).alias("_c"))
    at = F.size(F.filter("_c", lambda q: q < F.col(key)))
    return df.join(broadcast_checked(cuts), F.col(group) == F.col("_g"), "left").withColumn(
        out, F.when(F.col("_c").isNull(), 0).otherwise(at)).drop("_g", "_c")


def numbered(df: DataFrame, key: str, out: str = "rn", buckets: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 in the order of a unique numeric ``key``.

    A window over the whole table would sort it in one task.  Instead the key range
    is cut at approximate quantiles; rows are numbered within each slice and shifted
    by the count of the slices before it (at most ``buckets`` rows, as many as the rows ask for).
    """
    buckets = buckets or slices_for(df)
    cuts = df.stat.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    tmp = df.withColumn("_k", F.col(key).cast("double"))
    sliced = Bucketizer(splits=splits, inputCol="_k", outputCol="_b").transform(tmp).drop("_k")
    sizes = sliced.groupBy("_b").agg(F.count("*").alias("_n"))
    shift = sizes.withColumn("_off", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return (sliced.withColumn("_r", local).join(broadcast_checked(shift, buckets + 1), "_b")
            .withColumn(out, F.col("_r") + F.col("_off")).drop("_b", "_r", "_off"))


def numbered_within(df: DataFrame, group: str, key: str, out: str = "rn", span: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 within each group in the order of a unique numeric ``key``.

    A group is cut at quantiles of its keys (or at multiples of ``span``), numbered slice by slice and shifted by the
    rows before, so a group with most of the rows is still many tasks.
    """
    s = group_slices(df, group, key) if span is None else df.withColumn("_b", F.floor(F.col(key) / span))
    sizes = s.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    off = F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")
    local = F.row_number().over(Window.partitionBy(group, "_b").orderBy(key))
    return (s.withColumn("_r", local).join(sizes.withColumn("_off", off).drop("_n"), [group, "_b"])
            .withColumn(out, F.col("_r") + F.col("_off")).drop("_b", "_r", "_off"))
