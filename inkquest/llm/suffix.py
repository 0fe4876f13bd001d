"""Removal of repeated passages with suffix arrays over shards.

1. The rows are written once, in packs of bounded size, to a table bucketed by pack.  Every
   later step that needs texts reads that table where it lies.
2. Each start of a ``least``-byte string is owned by the smallest hash among the Q-grams in it.
   Equal strings have equal owners, so an owner that occurs in one document only owns nothing
   that repeats.  Packs send their owners to hash shards and get back which occur elsewhere.
3. Runs of starts with one repeated owner, each distinct text of them once per pack, go to the
   owner's shard with the smallest doc_id that has it.  The shard sorts all suffixes by induced
   sorting, reads the common prefixes of neighbours in text order, and gives each start the
   smallest doc_id that has its string.
4. The answers go back to the packs, which mark and remove bytes.

Nothing is sent for one occurrence alone that stands for many: a passage that a third of the
documents share is one row per pack, and what decides about a string is one number.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import shared_dir, staged
from .induced import common_prefix, suffix_array, words_at

#: Bytes of a repeated string, of the Q-grams that own its starts, of a pack, of a slice of hashing.
LEAST, Q, PACK_BYTES, SLICE = 50, 24, 4_000_000, 500_000
#: Bytes of all texts per shard.  About one in fourteen starts begins a run, and one run in seven repeats.
SHARD_BYTES = 2_000_000
NO_ID = np.iinfo(np.int64).max
U = np.uint64


# ---------------------------------------------------------------- packs


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number packs within the task; a longer text is a pack of its own."""
    task, pack, held = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size, ids = b.column(1).to_pylist(), []
        for n in size:
            if held and held + n > PACK_BYTES:
                pack, held = pack + 1, 0
            held += n
            ids.append((task << 24) + pack)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *b.columns], names=["_pack", *b.schema.names])


def _packed(docs: DataFrame) -> DataFrame:
    """A bucketed table of the rows with their pack, the text as bytes and its length."""
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    src = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_raw"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("_size"),
                      F.col("text").isNull().alias("_null"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)])
    out = src.mapInArrow(_pack, T.StructType([T.StructField("_pack", T.LongType()), *src.schema.fields]))
    name = f"packs_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out.write.bucketBy(n, "_pack").format("parquet").option("path", shared_dir(spark, "packs")).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")  # the files stay where they are, in the shared folder
    return table


@dataclass
class Pack:
    """The texts of a pack end to end, in the order of doc_id, with the owner of every start."""

    order: np.ndarray
    ids: np.ndarray
    size: np.ndarray
    raw: np.ndarray
    run_at: np.ndarray
    run_n: np.ndarray
    run_doc: np.ndarray
    run_owner: np.ndarray

    @classmethod
    def of(cls, t: pa.Table, least: int, q: int) -> "Pack":
        body = t["_raw"].combine_chunks()
        ids = t["doc_id"].fill_null(NO_ID).to_numpy()
        texts = body.to_pylist()
        order = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), np.int64)
        size = np.fromiter((len(texts[i]) for i in order), np.int64, len(order))
        raw = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        at, n, doc, owner = _runs(raw, size, least, q)
        return cls(order, ids[order], size, raw, at, n, doc, owner)


def _gram_hashes(raw: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, joined from those of half the length."""
    with np.errstate(over="ignore"):
        h = (raw.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
        have, done = 1, 0
        base = 0x100000001B3
        total = None
        while True:
            if q & have:
                piece = h[done:] if done else h
                total = piece if total is None else total[:len(piece)] * U(pow(base, have, 1 << 64)) + piece[:len(total)]
                done += have
            if done == q:
                break
            h = h[:-have] * U(pow(base, have, 1 << 64)) + h[have:]
            have *= 2
        total = total[:len(raw) - q + 1]
        total = (total ^ (total >> U(31))) * U(0xBF58476D1CE4E5B9)
        total = (total ^ (total >> U(29))) * U(0x94D049BB133111EB)
        return total ^ (total >> U(32))


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:len(h) - (w - have)], h[w - have:]) if w > have else h


def _runs(raw: np.ndarray, size: np.ndarray, least: int, q: int):
    """Runs of neighbouring starts in one document with one owner: start, length, document, owner."""
    ends = np.cumsum(size)
    at, length, docs, owners = [], [], [], []
    for s in range(0, len(raw), SLICE):
        part = raw[s:s + SLICE + least - 1]
        if len(part) < least:
            break
        m = _window_min(_gram_hashes(part, q), least - q + 1)
        pos = np.arange(s, s + len(m))
        doc = np.searchsorted(ends, pos, side="right")
        ok = pos + least <= ends[doc]
        new = ok & np.r_[True, ~ok[:-1] | (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = np.flatnonzero(ok & np.r_[new[1:] | ~ok[1:], True])
        at.append(pos[first])
        length.append(stop - first + 1)
        docs.append(doc[first])
        owners.append(m[first])
    if not at:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, U)
    owner = np.concatenate(owners)
    with np.errstate(over="ignore"):  # minima crowd at the low end; spread them, so that shards are even
        owner *= U(0x9E3779B97F4A7C15)
        owner ^= owner >> U(29)
        owner *= U(0xBF58476D1CE4E5B9)
    return np.concatenate(at), np.concatenate(length), np.concatenate(docs), owner


def _shard_slices(owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards of sorted owners, and where each begins."""
    shard = (owner >> U(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.empty(0, np.int64)
    return shard[first], np.r_[first, len(shard)]


# ---------------------------------------------------------------- owners


def _distinct_owners(p: Pack) -> tuple[np.ndarray, np.ndarray]:
    """Sorted owners of the pack, and which of them two of its documents have."""
    own, at = np.unique(p.run_owner, return_inverse=True)
    low, high = np.full(len(own), NO_ID), np.full(len(own), -1)
    np.minimum.at(low, at, p.run_doc)
    np.maximum.at(high, at, p.run_doc)
    return own, low != high


def _send_owners(least: int, q: int, bits: int):
    def run(t: pa.Table) -> pa.Table:
        own, many = _distinct_owners(Pack.of(t, least, q))
        shard, cut = _shard_slices(own, bits)
        rest = own << U(bits) >> U(24)  # 40 bits beyond the shard's; a clash only sends a run in vain
        high, low = (rest >> U(32)).astype(np.uint8), (rest & U(0xFFFFFFFF)).astype("<u4")
        part = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        return pa.table({"shard": pa.array(shard, pa.int64()), "_pack": pa.array([t["_pack"][0].as_py()] * len(part), pa.int64()),
                         "high": pa.array([high[a:b].tobytes() for a, b in part], pa.binary()), "low": pa.array([low[a:b].tobytes() for a, b in part], pa.binary()),
                         "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in part], pa.binary())})

    return run


def _find_repeated(t: pa.Table) -> pa.Table:
    """For each pack of a shard one bit per owner: whether another document has it."""
    low = [np.frombuffer(x, "<u4") for x in t["low"].to_pylist()]
    size = [len(x) for x in low]
    key = np.concatenate(low).astype(np.int64) | np.concatenate([np.frombuffer(x, np.uint8) for x in t["high"].to_pylist()]).astype(np.int64) << 32
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t["many"].to_pylist(), size)]).astype(bool)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    flag = np.empty(len(key), bool)
    flag[order] = np.r_[False, same] | np.r_[same, False] | many[order]
    bits = [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum(size)[:-1])]
    keep = np.array([x.any() for x in np.split(flag, np.cumsum(size)[:-1])], bool)
    return pa.table({"_pack": t["_pack"], "shard": t["shard"], "bits": pa.array(bits, pa.binary())}).filter(pa.array(keep))


# ---------------------------------------------------------------- regions


@dataclass
class Regions:
    """Distinct texts of the repeated runs of a pack, numbered by shard, and which run has which."""

    shard: np.ndarray
    text: list[bytes]
    low: np.ndarray
    runs: np.ndarray
    of_run: np.ndarray

    @classmethod
    def of(cls, p: Pack, flags: pa.Table, bits: int, least: int) -> "Regions":
        own, _ = _distinct_owners(p)
        shard, cut = _shard_slices(own, bits)
        got = dict(zip(flags["shard"].to_pylist(), flags["bits"].to_pylist()))
        hot = np.zeros(len(own), bool)
        for s, a, b in zip(shard.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            if s in got:
                hot[a:b] = np.unpackbits(np.frombuffer(got[s], np.uint8), count=b - a)
        runs = np.flatnonzero(hot[np.searchsorted(own, p.run_owner)]) if len(own) else np.empty(0, np.int64)
        whole, seen, of_run = p.raw.tobytes(), {}, np.empty(len(runs), np.int64)
        at, stop = p.run_at[runs].tolist(), (p.run_at[runs] + p.run_n[runs] + least - 1).tolist()
        for k, (a, b) in enumerate(zip(at, stop)):
            of_run[k] = seen.setdefault(whole[a:b], len(seen))
        text, low, home = list(seen), np.full(len(seen), NO_ID), np.zeros(len(seen), np.int64)
        np.minimum.at(low, of_run, p.ids[p.run_doc[runs]])
        home[of_run] = (p.run_owner[runs] >> U(64 - bits)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        place = np.empty(len(seen), np.int64)
        place[order] = np.arange(len(seen))
        return cls(home[order], [text[i] for i in order], low[order], runs, place[of_run])


def _send_regions(least: int, q: int, bits: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not len(docs) or not len(flags):
            return pa.table({"shard": pa.array([], pa.int64()), "_pack": pa.array([], pa.int64()), "sizes": pa.array([], pa.binary()),
                             "body": pa.array([], pa.binary()), "low": pa.array([], pa.binary())})
        r = Regions.of(Pack.of(docs, least, q), flags, bits, least)
        first = np.flatnonzero(np.r_[True, r.shard[1:] != r.shard[:-1]]) if len(r.shard) else np.empty(0, np.int64)
        part = list(zip(first.tolist(), [*first[1:].tolist(), len(r.shard)]))
        size = np.fromiter(map(len, r.text), np.int64, len(r.text)).astype("<u4")
        return pa.table({"shard": pa.array(r.shard[first], pa.int64()), "_pack": pa.array([docs["_pack"][0].as_py()] * len(part), pa.int64()),
                         "sizes": pa.array([size[a:b].tobytes() for a, b in part], pa.binary()), "body": pa.array([b"".join(r.text[a:b]) for a, b in part], pa.binary()),
                         "low": pa.array([r.low[a:b].astype("<i8").tobytes() for a, b in part], pa.binary())})

    return run


def smallest_holders(texts: list[bytes], low: np.ndarray, least: int) -> list[np.ndarray]:
    """For every start of a ``least``-byte string in each text, the smallest id of a text that has the string.

    The texts are laid end to end with a byte between them that no UTF-8 holds.  A start with
    ``least`` bytes before that byte is compared with the one before it in the suffix array;
    the common prefixes are stored by text position, and where they are shorter than ``least``
    a new string begins.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    t = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    owner = np.repeat(np.arange(len(texts)), size + 1)
    starts = np.arange(len(t)) + least <= (begin + size)[owner]
    sa = suffix_array(t)
    sa = sa[starts[sa]]
    held = np.full(len(t), NO_ID)
    if len(sa):
        before = np.full(len(t), -1)
        before[sa[1:]] = sa[:-1]
        prefix = np.zeros(len(t), np.int64)
        place = np.flatnonzero(before >= 0)
        prefix[place] = common_prefix(words_at(t), place, before[place], least)
        first = np.flatnonzero(np.r_[True, prefix[sa[1:]] < least])
        smallest = np.minimum.reduceat(low[owner[sa]], first)
        held[sa] = np.repeat(smallest, np.diff(np.r_[first, len(sa)]))
    return [held[b:b + n - least + 1] for b, n in zip(begin.tolist(), size.tolist())]


def _solve_shard(least: int):
    def run(t: pa.Table) -> pa.Table:
        seen, number, low = {}, [], []
        counts = []
        for sizes, body, ids in zip(t["sizes"].to_pylist(), t["body"].to_pylist(), t["low"].to_pylist()):
            cut = np.r_[0, np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))].tolist()
            number += [seen.setdefault(body[a:b], len(seen)) for a, b in zip(cut, cut[1:])]
            low.append(np.frombuffer(ids, "<i8"))
            counts.append(len(cut) - 1)
        number = np.array(number, np.int64)
        smallest = np.full(len(seen), NO_ID)
        np.minimum.at(smallest, number, np.concatenate(low))
        answers = []
        for held in smallest_holders(list(seen), smallest, least):
            stop = np.flatnonzero(np.r_[held[1:] != held[:-1], True])
            answers.append((len(stop), (stop + 1).astype("<u4").tobytes(), held[stop].astype("<i8").tobytes()))
        cut = np.r_[0, np.cumsum(counts)].tolist()
        mine = [[answers[k] for k in number[a:b].tolist()] for a, b in zip(cut, cut[1:])]
        return pa.table({"_pack": t["_pack"], "shard": t["shard"],
                         "steps": pa.array([np.array([x[0] for x in m], "<u4").tobytes() for m in mine], pa.binary()),
                         "stops": pa.array([b"".join(x[1] for x in m) for m in mine], pa.binary()),
                         "holders": pa.array([b"".join(x[2] for x in m) for m in mine], pa.binary())})

    return run


# ---------------------------------------------------------------- removal


def _covered(p: Pack, answers: pa.Table, bits: int, least: int) -> np.ndarray:
    """Which bytes of the pack stand in a string that a document with a smaller id has too."""
    cover = np.zeros(len(p.raw) + 1, np.int32)
    kinds = answers["bits"].is_valid()
    flags, told = answers.filter(kinds), answers.filter(pc.invert(kinds)).sort_by("shard")
    if len(flags):
        r = Regions.of(p, flags, bits, least)
        cat = lambda c, d: np.frombuffer(b"".join(told[c].to_pylist()), d)
        steps, stops, holders = cat("steps", "<u4").astype(np.int64), cat("stops", "<u4").astype(np.int64), cat("holders", "<i8")
        n = p.run_n[r.runs]
        if len(n):
            base = np.r_[0, np.cumsum(steps)]
            each = np.diff(np.r_[0, stops])
            each[base[:-1]] = stops[base[:-1]]
            held = np.repeat(holders, each)  # by region and start
            begin = np.r_[0, np.cumsum(each)][base[:-1]]
            ends = np.cumsum(n)
            spot = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            gone = held[spot + np.repeat(begin[r.of_run], n)] < np.repeat(p.ids[p.run_doc[r.runs]], n)
            at = (spot + np.repeat(p.run_at[r.runs], n))[gone]
            cover[:-1] += np.bincount(at, minlength=len(p.raw)).astype(np.int32)
            cover -= np.bincount(at + least, minlength=len(cover)).astype(np.int32)
    return np.cumsum(cover[:-1]) > 0


def _remove(least: int, q: int, bits: int, extra: list[str], digest: bool, names: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return None
        p = Pack.of(docs, least, q)
        gone = _covered(p, answers, bits, least)
        at = np.r_[0, np.cumsum(p.size)]
        removed, spans, kept = [], [], []
        for a, b in zip(at.tolist(), at[1:].tolist()):
            g = gone[a:b]
            removed.append(int(g.sum()))
            spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0]))
            if not digest and removed[-1] and len(g) > removed[-1]:
                g = _whole_characters(p.raw[a:b], g)
            kept.append(p.raw[a:b][~g].tobytes() if removed[-1] else p.raw[a:b].tobytes())
        docs = docs.take(pa.array(p.order))
        out = {"doc_id": docs["doc_id"], "n_bytes": pa.array(p.size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        if digest:
            out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        else:
            null = docs["_null"].to_pylist()
            out["text"] = pa.array([None if x else k.decode("utf-8", "replace") for x, k in zip(null, kept)], pa.string())
            out |= {c: docs[c] for c in extra}
        return pa.table({n: out[n] for n in names})

    return run


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Removed bytes without the characters that are removed in part only."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(first) or first[0]:
        first = np.r_[0, first]
    whole = np.logical_and.reduceat(gone, first)
    return np.repeat(whole, np.diff(np.r_[first, len(raw)]))


def _run(docs: DataFrame, least: int, q: int, digest: bool) -> DataFrame:
    if not 1 < q <= least:
        raise ValueError("the owning grams must fit into the repeated string")
    spark = docs.sparkSession
    packed = _packed(docs)
    total = packed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    bits = max(3, int(total // SHARD_BYTES).bit_length())
    texts = packed.select("_pack", "doc_id", "_raw")
    owners = texts.groupBy("_pack").applyInArrow(_send_owners(least, q, bits), "shard long, _pack long, high binary, low binary, many binary")
    flags = staged(owners.groupBy("shard").applyInArrow(_find_repeated, "_pack long, shard long, bits binary"), "owners")
    regions = texts.groupBy("_pack").cogroup(flags.groupBy("_pack")).applyInArrow(
        _send_regions(least, q, bits), "shard long, _pack long, sizes binary, body binary, low binary")
    told = staged(regions.groupBy("shard").applyInArrow(_solve_shard(least), "_pack long, shard long, steps binary, stops binary, holders binary"), "holders")
    answers = told.unionByName(flags, allowMissingColumns=True)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    extra = [f"_c{i}" for i in range(len(rest))]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]
    if digest:
        left = texts
        fields.append(T.StructField("kept_sha256", T.StringType()))
    else:
        left = packed.select("_pack", "doc_id", "_raw", "_null", *extra)
        fields += [T.StructField("text", T.StringType()), *[T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(rest)]]
    schema = T.StructType(fields)
    out = left.groupBy("_pack").cogroup(answers.groupBy("_pack")).applyInArrow(_remove(least, q, bits, extra, digest, schema.names), schema)
    if digest:
        return out
    back = dict(zip(rest, extra))
    return out.select(*[F.col(back.get(c, c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns], "n_removed", "n_spans")


def removal_report(docs: DataFrame, least: int = LEAST, q: int = Q) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a ``least``-byte string over it also starts in a row with a smaller doc_id;
    strings are judged on the input and never cross rows.  Null texts are empty; rows that
    repeat a doc_id do not remove from each other; a null doc_id counts as larger than all.
    Other columns are ignored; an empty table gives an empty result.
    """
    return _run(docs.select("doc_id", "text"), least, q, digest=True)


def remove_repeats(docs: DataFrame, least: int = LEAST, q: int = Q) -> DataFrame:
    """``docs`` with the same bytes cut out of ``text``, and n_removed and n_spans behind.

    Of a character of which only some bytes are covered all are kept, so texts stay UTF-8.
    Null texts stay null, and rows of which nothing is left stay with an empty text.
    """
    return _run(docs, least, q, digest=False)
