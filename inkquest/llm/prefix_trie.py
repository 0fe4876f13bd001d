"""The trie of conversation prefixes: ternary search trees by range shard, joined at the shards' borders.

A turn is known by a digest of its role and text, a conversation by the array of its turns'
digests.  Conversations are dealt by range of that array (and id, so that many equal ones are
several shards too), and each shard numbers its turns, puts its distinct sequences into a ternary
search tree, median first, and walks the tree without recursion.  Ranges of sorted sequences
overlap in nothing but prefixes of a shard's first and last sequence: all other nodes are complete,
and these border nodes are merged on Spark by the digest of their prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

#: Conversations of one shard at most: a larger partition is several shards.
SHARD_ROWS = 200_000
ROOT = b""
NODE = ("shard long, border boolean, name binary, parent_name binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, size long, ends string, ends_sha256 string")


# ---------------------------------------------------------------- conversations as sequences


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<key, size>>) of every conversation, by turn, null first.

    ``turns`` has conv_id, turn, role and text; null roles and texts are empty, rows without a
    conv_id belong to no conversation and are left out.  Turns of equal number are ordered by
    role and then by digest, repeated rows are turns each.  Texts are not shuffled; the turns of
    one conversation, some 40 bytes each, meet in one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    keyed = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return keyed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def with_head_of(seqs: DataFrame, other: Column, n_turns: Column, most: int) -> DataFrame:
    """Sequences whose first ``n_turns`` (at most ``most``) turns are replaced by those of the conversation ``other``.

    Where the other is shorter all its turns are taken, where it is absent none; what a
    conversation has beyond its own first ``n_turns`` stays.
    """
    heads = seqs.select(F.col("conv_id").alias("other"), F.slice("turns", 1, most).alias("head"))
    asked = seqs.select("conv_id", "turns", other.alias("other"), n_turns.cast("int").alias("n"))
    own = F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    return asked.join(heads, "other", "left").select("conv_id", F.when(F.col("head").isNull(), own).otherwise(
        F.concat(F.slice("head", F.lit(1), F.col("n")), own)).alias("turns"))


# ---------------------------------------------------------------- one shard


class TernaryTree:
    """A ternary search tree over small integers; every node of it is a node of the trie but the root, which is node 0.

    Nodes are numbered as they come, so parents have smaller numbers than their children.
    """

    def __init__(self):
        self.symbol, self.low, self.high, self.down, self.parent, self.depth = [-1], [0], [0], [0], [-1], [0]

    def _node(self, symbol: int, parent: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, 0), (self.high, 0), (self.down, 0), (self.parent, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node that the sequence ends in."""
        low, high, down, symbol = self.low, self.high, self.down, self.symbol
        at = 0
        for s in sequence:
            to = down[at]
            if not to:
                to = down[at] = self._node(s, at)
            while symbol[to] != s:
                side = low if s < symbol[to] else high
                if not side[to]:
                    side[to] = self._node(s, at)
                to = side[to]
            at = to
        return at

    def find(self, sequence: list[int]) -> list[int]:
        """All nodes of a sequence that was inserted, from the root on."""
        path = [0]
        for s in sequence:
            to = self.down[path[-1]]
            while self.symbol[to] != s:
                to = self.low[to] if s < self.symbol[to] else self.high[to]
            path.append(to)
        return path


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += [(m + 1, b), (a, m)]


def _ids_text(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def shard_nodes(shard: int, ids: list[int], keys: pa.Array, sizes: pa.Array) -> pa.RecordBatch:
    """All nodes of one shard, whose conversations come sorted by sequence and id.

    Inner nodes are complete (but for their parent's conversation where that is a border node);
    border nodes hold what this shard alone says: members, and of their inner children the
    number, the leaves and the savings.
    """
    coded = keys.flatten().dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    symbols = rank[coded.indices.to_numpy()].tolist() if len(coded) else []
    size_of = dict(zip(symbols, sizes.flatten().to_pylist()))
    name_of = dict(zip(symbols, keys.flatten().to_pylist()))
    ends = np.cumsum(keys.value_lengths().to_numpy()).tolist()
    runs: list[tuple[list[int], list[int]]] = []  # distinct sequence, its conversations
    at = 0
    for i, end in zip(ids, ends):
        seq = symbols[at:end]
        at = end
        if runs and runs[-1][0] == seq:
            runs[-1][1].append(i)
        else:
            runs.append((seq, [i]))
    tree, members_of = TernaryTree(), {}
    for m in medians(len(runs)):
        members_of[tree.insert(runs[m][0])] = runs[m][1]
    n = len(tree.symbol)
    border, name = [False] * n, [None] * n
    for seq in (runs[0][0], runs[-1][0]):
        digest = ROOT
        for k, node in enumerate(tree.find(seq)):
            if k:
                digest = hashlib.md5(digest + name_of[tree.symbol[node]]).digest()
            border[node], name[node] = True, digest
    none = np.iinfo(np.int64).max
    count, least, children, leaves, saved = [0] * n, [none] * n, [0] * n, [0] * n, [0] * n
    for node, found in members_of.items():
        count[node], least[node] = len(found), found[0]
    for v in range(n - 1, -1, -1):  # children before parents
        up = tree.parent[v]
        if not border[v]:
            leaves[v] += not children[v]
            saved[v] += (count[v] - 1) * size_of[tree.symbol[v]]
            children[up] += 1
            leaves[up] += leaves[v]
            saved[up] += saved[v]
        if up >= 0:
            count[up] += count[v]
            least[up] = min(least[up], least[v])
    parents = tree.parent
    empty = hashlib.sha256(b"").hexdigest()
    text = [_ids_text(members_of[v]) if v in members_of else "" for v in range(n)]
    columns = [
        pa.array([shard] * n, pa.int64()), pa.array(border), pa.array(name, pa.binary()),
        pa.array([name[p] if p >= 0 and border[p] else None for p in parents], pa.binary()), pa.array(least, pa.int64()), pa.array(tree.depth, pa.int64()),
        pa.array([least[p] if p >= 0 and not border[p] else None for p in parents], pa.int64()), pa.array(count, pa.int64()), pa.array(children, pa.int64()),
        pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), pa.array([size_of[s] if s >= 0 else 0 for s in tree.symbol], pa.int64()),
        pa.array([t if b else None for t, b in zip(text, border)], pa.string()),
        pa.array([None if b else hashlib.sha256(t.encode()).hexdigest() if t else empty for t, b in zip(text, border)], pa.string())]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in NODE.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards of one partition; shard numbers rise with the order of the conversations."""
    part, k, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        keys, sizes = (whole[c].chunk(0) for c in ("keys", "sizes"))
        return shard_nodes(part * 10_000 + k, whole["conv_id"].to_pylist(), keys, sizes)

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= SHARD_ROWS:
            yield flush()
            held, rows, k = [], 0, k + 1
    if rows:
        yield flush()


# ---------------------------------------------------------------- all shards


def _hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, ends_sha256): pieces of id lists, sorted by name and shard, hashed as they pass."""
    name, h = None, None
    for b in batches:
        for key, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if h is not None and key == name:
                h.update(b",")
            else:
                if h is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([h.hexdigest()])], ["name", "ends_sha256"])
                name, h = key, hashlib.sha256()
            h.update(piece.encode())
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([h.hexdigest()])], ["name", "ends_sha256"])


def _merge_borders(parts: DataFrame) -> DataFrame:
    """Border nodes with their final columns, one row for each prefix.

    Subtree sums over the merged border nodes are taken by doubling: after round k a node has the
    sum over all border nodes less than 2^k below it, and knows the ancestor 2^k above.
    """
    rows = parts.where("border")
    ends = rows.where("ends <> ''").select("name", "ends", "shard").repartition("name").sortWithinPartitions("name", "shard").select("name", "ends").mapInArrow(
        _hash_in_order, "name binary, ends_sha256 string")
    one = staged(rows.groupBy("name").agg(
        F.first("parent_name", True).alias("up"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.first("size").alias("size")), "borders")
    below = one.where("up IS NOT NULL").groupBy(F.col("up").alias("name")).agg(F.count("*").alias("more"))
    one = one.join(below, "name", "left").withColumn("n_children", F.col("inner") + F.coalesce("more", F.lit(0)))
    state = staged(one.select("name", F.col("up").alias("far"), (F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
                              (F.col("saved") + (F.col("n_convs") - 1) * F.col("size") * (F.col("depth") > 0).cast("int")).alias("saved")), "sums")
    while not state.where("far IS NOT NULL").isEmpty():
        got = state.where("far IS NOT NULL").groupBy(F.col("far").alias("name")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = state.select(F.col("name").alias("far"), F.col("far").alias("farther"))
        zero = F.lit(0).cast("long")
        state = staged(state.join(got, "name", "left").join(jump.where("farther IS NOT NULL"), "far", "left").select(
            "name", F.col("farther").alias("far"), (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved")), "sums")
    least = one.select(F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return staged(one.join(state.select("name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "name").join(least, "up", "left")
                  .join(ends, "name", "left").select("name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                     F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "borders")


def nodes(seqs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every trie node.

    ``seqs`` has one row (conv_id, turns) for each conversation; an array that is null or empty ends
    at the root.  Without any conversation there is no node, not even a root.  Further columns
    are ignored.
    """
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    turns = F.coalesce("turns", F.array().cast("array<struct<key:binary,size:bigint>>"))
    flat = staged(seqs.select("conv_id", turns["key"].alias("keys"), turns["size"].alias("sizes")), "sequences")
    parts = staged(flat.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id").mapInArrow(_shards, NODE), "shards")
    borders = _merge_borders(parts)
    inner = parts.where("NOT border")
    # the children of border nodes get their parent's conversation by (shard, name), which holds no more than a shard
    open_ = inner.where("parent_name IS NOT NULL").drop("parent_conv_id")
    asked = parts.where("border").select("shard", F.col("name")).join(borders.select("name", F.col("conv_id").alias("parent_conv_id")), "name")
    closed = open_.join(asked.withColumnRenamed("name", "parent_name"), ["shard", "parent_name"])
    return borders.select(out).unionByName(inner.where("parent_name IS NULL").select(out)).unionByName(closed.select(out))
