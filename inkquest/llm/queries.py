"""One query per operator over its whole table, with SQL where SQL can state it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, chat, decontam, embeddings, prefix_trie, pst, quality, sharding, simhash, suffix, token_counts, transducer

SHARDS = 24
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_file(name: str, folder: str = "/opt/tokenizers") -> str:
    """Path of a public vocabulary; the folder is a parameter and nothing of it is copied."""
    return os.path.join(folder, name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_sharding")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    measured = sharding.measure(table(spark, folder, "documents"))
    smap = sharding.ShardMap.plan(measured, SHARDS)
    smap.save(spark, sharding.map_folder(spark))
    return sharding.assign(measured, smap).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.removal_report(table(spark, folder, "documents"))


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, table(spark, folder, "labels"), usable=~out)
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op4_simhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_embeddings", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY 1), n AS (SELECT x AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query("op6_suffix_tree_lm")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.held_out(F.col("doc_id"), 7, 2)
    return pst.score(table(spark, folder, "documents"), ~out, out)


@query("op7_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    hist = token_counts.lengths_histogram(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return token_counts.suffix_sums(hist)


def _sql_words(x: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce({x}, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op9_decontamination", f"""
WITH d AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents), b AS (SELECT item_id, {_sql_words('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
  SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least({decontam.WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw))),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


@query("op10_chat", f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    CAST(sum({len(chat.START) + len(chat.END) + 2} + length(replace({_sql_escape('role')}, chr(10), '\\' || chr(10)))
      + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.chat_digest(chat.format_chat(turns.withColumn("parts", chat.text_part(F.col("text")))))


#: CRC-32 of the decimal digits of x, bit by bit: the registers of the reflected polynomial, seen as integers.
def _sql_crc32(x: str) -> str:
    bit = "(CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    byte = f"list_reduce([xor(r, v)] || list_transform(range(8), lambda i: 0::BIGINT), lambda c, i: {bit})"
    return f"xor(list_reduce([4294967295] || list_transform(range(1, length({x}) + 1), lambda p: ascii({x}[p])::BIGINT), lambda r, v: {byte}), 4294967295)"


@query("op11_prefix_trie", f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_sql_crc32('s')} % 9 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, t.k, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.k <= c.h
  UNION ALL SELECT c.conv_id, 1, t.k, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.k > c.h),
p AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY part, k) AS keys, list(strlen(text) ORDER BY part, k) AS sizes FROM r GROUP BY 1),
a AS (SELECT c.conv_id, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes FROM c LEFT JOIN p USING (conv_id)),
e AS (SELECT conv_id, d AS depth, array_to_string(keys[1:d], ',') AS node, CASE WHEN d > 0 THEN array_to_string(keys[1:d - 1], ',') END AS up, keys[1:d] AS path,
    CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(keys) AS ends FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM a)),
n AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(path) AS path, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY 1),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT array_to_string(path[1:d], ',') AS node, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM (
    SELECT path, n_convs, size, k.node IS NULL AS leaf, unnest(range(0, depth + 1)) AS d FROM n LEFT JOIN k USING (node)) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n u ON u.node = n.up""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(rebuilt(prefix_trie.sequences(table(spark, folder, "conversations"))))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Conversations that begin with up to eight turns of the first one of their block of five ids."""
    return prefix_trie.with_head_of(seqs, F.col("conv_id") - F.pmod("conv_id", F.lit(5)), F.crc32(F.col("conv_id").cast("string")) % 9, 8)


@query("op12_byte_transducer")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return transducer.round_trip_digest(table(spark, folder, "documents"), "byte_bpe_multi_50k.tiktoken")


@query("op13_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.report(table(spark, folder, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")
