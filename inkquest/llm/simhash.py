"""SimHash near-duplicates: a binary trie of fingerprints is joined with itself under an error budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import row_bound, shuffled, staged
from .components import components

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Fingerprints that a trie in a task takes before its top levels are opened on Spark, and how many of them.
TRIE_ROWS, TOP_BITS = 50_000, 8
#: Stages of a pipeline link texts by five words and this similarity, looked for within so many bits (see README for what they find).
STAGE_SHINGLE, STAGE_BUDGET, STAGE_SIMILARITY = 5, 8, 0.8
#: Fingerprints that may share a value of the blocks on average.
FEW = 64
#: Held a joined group by some of its fingerprints; read by nothing since all of them are searched, kept for callers that set it.
GROUP_SHOWN = 32
#: Links of a fingerprint that are tried first in each trie, and found pairs that are held before they are cut to those.
CLOSEST, HELD_PAIRS = 1, 200_000
#: Rows of ids and hashes, some 100 bytes each in memory, that are broadcast rather than that texts are shuffled.
ID_ROWS = 400_000
#: Words of 64 bits of the sketch of a set of shingles.
SKETCH = 4
#: Node pairs that are held at once while a trie is walked, fingerprints of a node that is not opened further, and pairs compared at once.
FRONTIER, LEAF, LEAF_PAIRS = 15_000, 32, 400_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, in order; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - size + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1:].tolist())), np.uint64, n)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits of the XXH64 of all word shingles, as a signed integer; 0 without words."""
    return _majority(_hashes(text, size, seed))


def _majority(h: np.ndarray) -> int:
    n = len(h)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(h[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def sketch(h: np.ndarray) -> tuple[int, ...]:
    """Number of distinct shingles, and for each place of 64 * SKETCH whether an odd number of them falls there.

    A shingle that only one of two sets has changes one place, so two sketches never differ in more places than
    their sets in shingles: a lower bound of the difference without any set at hand.
    """
    h = np.unique(h)
    odd = np.bincount((h >> np.uint64(7) & np.uint64(64 * SKETCH - 1)).view(np.int64), minlength=64 * SKETCH) & 1
    return len(h), *np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


_SKETCHED = ["shingles", *[f"k{i}" for i in range(SKETCH)]]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, read once and staged; with ``digest`` also a hash of the text and the sketch of its shingles."""
    more = _SKETCHED if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sketches = [], []
            for t in b.column(1):
                h = _hashes(t.as_py(), size, SEED)
                fp.append(_majority(h))
                if digest:
                    sketches.append(sketch(h))
            shown = [pa.array(c, pa.int64()) for c in (zip(*sketches) if sketches else [[]] * len(more))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:], *shown], ["doc_id", "fp", *["digest"] * digest, *more])

    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"), *[F.xxhash64(text).alias("digest")] * digest)
    kept = "".join(f", {c} long" for c in ["digest"] * digest + more)
    return staged(src.mapInArrow(run, "doc_id long, fp long" + kept), "fingerprints")


def may_reach(similarity: float, sketches: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets can have the Jaccard similarity by their sketches (rows: size, words), and how much of both differs at least."""
    both = sketches[x, 0] + sketches[y, 0]
    differ = np.maximum(np.bitwise_count((sketches[x, 1:] ^ sketches[y, 1:]).view(np.uint64)).sum(1, dtype=np.int64), np.abs(sketches[x, 0] - sketches[y, 0]))
    return differ * (1 + similarity) <= (1 - similarity) * both + 1e-6, differ / np.maximum(both, 1)


def closest(x: np.ndarray, y: np.ndarray, far: np.ndarray, few: int) -> np.ndarray:
    """Places of the pairs that are among the ``few`` nearest of one of their ends."""
    end, other, pair = np.r_[x, y], np.r_[y, x], np.tile(np.arange(len(x)), 2)
    order = np.lexsort([other, np.r_[far, far], end])
    first = np.flatnonzero(np.r_[True, end[order][1:] != end[order][:-1]]) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return np.unique(pair[order][rank < few])


def _across(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of node pairs, in parts; of a node with itself each pair once."""
    rows = np.cumsum(a1 - a0)
    x = np.arange(rows[-1]) - np.repeat(rows - (a1 - a0) - a0, a1 - a0)
    low, high = np.repeat(b0, a1 - a0), np.repeat(b1, a1 - a0)
    low = np.where(np.repeat((a0 == b0) & (a1 == b1), a1 - a0), x + 1, low)
    total = np.cumsum(high - low)
    at = 0
    while at < len(x):
        done = total[at - 1] if at else 0
        end = max(int(np.searchsorted(total, done + LEAF_PAIRS, "right")), at + 1)
        n = (high - low)[at:end]
        yield np.repeat(x[at:end], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low[at:end], n)
        at = end


def trie_join(fps: np.ndarray, spans: list[tuple[int, int, int, int]], budget: int, of: np.ndarray | None = None,
              keep=None, few: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` differing bits, for pairs of trie nodes; with ``of`` only those of different groups.

    ``fps`` is sorted (unsigned) inside every node; a span (a0, a1, b0, b1) is a pair of nodes,
    or one node with itself.  Both nodes of a pair step down one bit together: equal bits keep
    the error, unequal ones add one, and pairs over the budget are cut with all below them.
    A node is a range of the sorted array, so its children are found from counts of set bits;
    nodes of ``LEAF`` fingerprints at most are not opened, their pairs are compared as they are.
    Nodes that hold one and the same group are left at once, however many it has.
    ``keep`` says of found pairs which of them stay and how far apart each is; with ``few`` only those
    stay that are among so many nearest of one of their ends, so that they grow with the fingerprints.
    """
    n = len(fps)
    turns = None if of is None else np.cumsum(np.r_[0, of[1:] != of[:-1]])
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ones: dict[int, np.ndarray] = {}
    first = np.array(spans, np.int64).T
    stack = [(0, np.vstack([first, np.zeros(first.shape[1], np.int64)]))]
    left, right, apart = [], [], []
    held, most = 0, max(HELD_PAIRS, 4 * few * n)

    def found() -> list[np.ndarray]:
        x, y, far = (np.concatenate(c) for c in (left, right, apart))
        some = closest(x, y, far, few) if few else slice(None)
        return [x[some], y[some], far[some]]

    while stack:
        level, f = stack.pop()
        if f.shape[1] > FRONTIER:
            half = f.shape[1] // 2
            stack += [(level, f[:, :half]), (level, f[:, half:])]
            continue
        if turns is not None and f.shape[1]:
            a0, a1, b0, b1, _ = f
            f = f[:, ~((of[a0] == of[b0]) & (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1]))]
        a0, a1, b0, b1, d = f
        leaf = (a1 - a0 <= LEAF) & (b1 - b0 <= LEAF)
        if leaf.any():
            for x, y in _across(a0[leaf], a1[leaf], b0[leaf], b1[leaf]):
                differ = np.bitwise_count(fps[x] ^ fps[y])
                near = np.flatnonzero((differ > 0) & (differ <= budget))
                x, y, far = x[near], y[near], differ[near]
                if of is not None:
                    apart_of = of[x] != of[y]
                    x, y, far = x[apart_of], y[apart_of], far[apart_of]
                if keep is not None:
                    stays, far = keep(x, y)
                    x, y, far = x[stays], y[stays], far[stays]
                held += len(x)
                for column, values in zip((left, right, apart), (x, y, far)):
                    column.append(values)
                if few and held > most:
                    left, right, apart = ([c] for c in found())
                    held = len(left[0])
            a0, a1, b0, b1, d = f[:, ~leaf]
        if not len(a0) or level == 64:
            continue
        if level not in ones:
            ones[level] = np.zeros(n + 1, np.int32)
            np.cumsum((fps >> np.uint64(63 - level)) & np.uint64(1), out=ones[level][1:])
        c = ones[level]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        itself = (a0 == b0) & (a1 == b1)
        down = np.hstack([np.vstack([a0, am, b0, bm, d]), np.vstack([am, a1, bm, b1, d]),
                          np.vstack([a0, am, bm, b1, d + 1]), np.vstack([am, a1, b0, bm, d + 1])[:, ~itself]])
        alone = (down[0] == down[2]) & (down[1] - down[0] <= 1) & (down[1] == down[3])
        down = down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget) & ~alone]
        if down.shape[1]:
            stack.append((level + 1, down))
    return tuple(found()[:2]) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _masks(budget: int, agree: int = 2) -> list[int]:
    """Masks of ``agree`` of budget + agree blocks: pairs within the budget agree on all bits of one of them."""
    blocks = max(agree + 1, budget + agree)
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    bits = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return [sum(some) for some in combinations(bits, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _free_shift(mask: int, width: int) -> int:
    """Place of ``width`` neighbouring bits outside the mask."""
    return next(s for s in range(64 - width, -1, -1) if not (mask >> s) & ((1 << width) - 1))


def _walk(budget: int, masks: list[int], with_groups: bool = False, similarity: float | None = None, few: int = 0):
    """Trie joins over rows sorted by group; a group that spans batches is carried on."""
    def join(gid: list[np.ndarray], fp: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
        of, sketches = more[0] if with_groups else None, np.stack(more[with_groups:], axis=1) if similarity is not None else None
        m, node_a, node_b, shift = gid[0], gid[2], gid[3], gid[4]
        change = np.flatnonzero(np.r_[True, np.any([g[1:] != g[:-1] for g in gid], axis=0)])
        ends = np.r_[change[1:], len(fp)]
        order = np.lexsort([fp, np.repeat(np.arange(len(change)), ends - change)])
        fp, of, sketches = fp[order], None if of is None else of[order], None if sketches is None else sketches[order]
        spans = []
        for s, e in zip(change.tolist(), ends.tolist()):
            if node_a[s] == node_b[s]:
                if e - s > 1:
                    spans.append((s, e, s, e))
            else:
                in_b = ((fp[s:e] >> np.uint64(shift[s])) & np.uint64((1 << TOP_BITS) - 1)) == np.uint64(node_b[s])
                part = np.argsort(in_b, kind="stable")
                fp[s:e] = fp[s:e][part]
                for column in (of, sketches):
                    if column is not None:
                        column[s:e] = column[s:e][part]
                k = s + int((~in_b).sum())
                spans.append((s, k, k, e))
        def keep(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            diff = fp[x] ^ fp[y]
            lowest = np.full(len(x), len(masks))
            for k in range(len(masks) - 1, -1, -1):
                lowest[(diff & np.uint64(masks[k])) == 0] = k
            mine = lowest == m[x]
            if sketches is None:
                return mine, np.bitwise_count(diff)
            may, far = may_reach(similarity, sketches, x, y)
            return mine & may, far

        x, y = trie_join(fp, [p for p in spans if p[0] < p[1] and p[2] < p[3]], budget, of, keep, few)
        return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[y].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:5]], axis=0)) if b.num_rows else []
            new = bool(held) and b.num_rows and any(c[0] != h[-1] for c, h in zip(cols[:5], held[-1][:5]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if new or cut:
                held.append([c[:cut] for c in cols])
                whole = [np.concatenate(c) for c in zip(*held)]
                if len(whole[0]):
                    yield join(whole[:5], whole[5].view(np.uint64), *whole[6:])
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            whole = [np.concatenate(c) for c in zip(*held)]
            if len(whole[0]):
                yield join(whole[:5], whole[5].view(np.uint64), *whole[6:])

    return run


def links(fps: DataFrame, budget: int = BUDGET, trie_rows: int = TRIE_ROWS, agree: int = 2, similarity: float | None = None, few: int = 0) -> DataFrame:
    """(a, b): every pair of distinct fingerprints within the budget, once.

    The 64 bits are dealt into budget + ``agree`` blocks; a pair within the budget agrees on
    ``agree`` whole blocks (two at first), so each fingerprint is sent once for every choice of
    them and a trie is built for each value.  Where more than ``trie_rows`` fingerprints share a value, the top levels of
    its trie are opened on Spark: each fingerprint goes to the pairs of top nodes that its own
    node forms within the budget.  If ``fps`` has a ``component`` for each fp, only pairs of different ones are returned.
    With ``similarity``, ``fps`` also has the sketch of each fp, and pairs that cannot reach it are left out;
    with ``few``, only the nearest of each fingerprint within each trie are returned.
    """
    masks = _masks(budget, agree)
    grouped = "component" in fps.columns
    of = ["component"] * grouped + (_SKETCHED if similarity is not None else [])
    f = fps.select("fp", *of).where("fp IS NOT NULL").distinct()
    keyed = f.select("fp", *of, F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"),
                                                        F.lit(_free_shift(m, TOP_BITS)).alias("s")) for k, m in enumerate(masks)])).alias("g"))
    keyed = keyed.select("fp", *of, "g.m", "g.v", "g.s")
    # only values above ``trie_rows`` are a table: all values are nearly as many as the rows
    crowded = staged(keyed.groupBy("m", "v").agg(F.count("*").alias("n")).where(F.col("n") > trie_rows).select("m", "v"), "crowded")
    alone = ["m", "v", F.lit(0).alias("na"), F.lit(0).alias("nb"), "s", "fp", *of]
    if crowded.isEmpty():
        return _trie_pairs(keyed.select(*alone), budget, masks, grouped, similarity, few)
    crowded = _beside(crowded)
    flips = [sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(TOP_BITS), k)]
    node = F.expr(f"CAST(shiftrightunsigned(fp, s) & {(1 << TOP_BITS) - 1} AS INT)")
    small = keyed.join(crowded, ["m", "v"], "left_anti").select(*alone)
    large = keyed.join(crowded, ["m", "v"], "left_semi").select("m", "v", "s", "fp", *of, node.alias("node"), F.explode(F.array(*map(F.lit, flips))).alias("x"))
    other = F.col("node").bitwiseXOR(F.col("x"))
    large = large.select("m", "v", F.least("node", other).alias("na"), F.greatest("node", other).alias("nb"), "s", "fp", *of)
    return _trie_pairs(small.unionByName(large), budget, masks, grouped, similarity, few)


def _trie_pairs(dealt: DataFrame, budget: int, masks: list[int], grouped: bool, similarity: float | None, few: int) -> DataFrame:
    group = ["m", "v", "na", "nb", "s"]
    return dealt.repartition(*group[:4]).sortWithinPartitions(*group).mapInArrow(_walk(budget, masks, grouped, similarity, few), "a long, b long")


def _beside(df: DataFrame) -> DataFrame:
    """A side of ids and hashes: broadcast within ``ID_ROWS``, else joined by shuffles."""
    return F.broadcast(df) if row_bound(df, ID_ROWS) is not None else shuffled(df)


def near_duplicates(docs: DataFrame, budget: int = BUDGET, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of fingerprints.  Null, empty and
    blank texts have fingerprint 0 and link like any other; equal fingerprints are one node
    however many rows they have; rows with a null id have a component like others.
    """
    rows = fingerprints(docs)
    nodes = _components_of(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), budget, trie_rows)
    low = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    of = nodes.select("fp", "component").join(shuffled(low), "component").select("fp", "component_id")
    return rows.join(shuffled(of), "fp").select("doc_id", "fp", "component_id")


def _components_of(nodes: DataFrame, budget: int, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """``nodes`` (one row for each fp) with the component of each."""
    return _with_component(nodes, links(nodes, budget, trie_rows))


def _with_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    comp = components(edges)
    return nodes.join(shuffled(comp.withColumnRenamed("node", "fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, sorted; none without words."""
    return np.unique(_hashes(text, size, seed)).view(np.int64)


def _similar(pairs: DataFrame, shown: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those ``pairs`` (a, b) of fingerprints whose texts in ``shown`` (fp, text) have the Jaccard similarity; each text is hashed once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                sets = [shingle_hashes(t.as_py(), size) for t in rows.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["fp", "s"])

    sets = staged(shown.mapInArrow(run, "fp long, s array<long>"), "shingles")
    both = _beside(pairs).join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(shuffled(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"))), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def blocks_for(n: int, budget: int) -> int:
    """How many whole blocks a pair has to agree on so that a value of them has few of ``n`` even fingerprints."""
    return next(k for k in range(2, 64) if n <= FEW << (64 * k // (budget + k)))


def keep_one(docs: DataFrame, size: int = STAGE_SHINGLE, budget: int = STAGE_BUDGET, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id, or without any if no row has one.

    Texts of equal fingerprint over ``size``-word shingles are one group.  Others are linked if
    their fingerprints differ in at most ``budget`` bits and the Jaccard similarity of their shingles is
    at least ``similarity``, which is computed for every pair that the trie join finds and whose sketches allow it.
    The nearest links of each fingerprint are taken first, narrow ones, then wide ones; all others are searched between the groups that
    these join only, so that a large group of near copies does not become all its pairs.  A row is known by its doc_id and a hash of its text, so rows that
    share an id, or have none, stay or go each with its own group.
    """
    rows = fingerprints(docs, digest=True, size=size)
    keys = rows.groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    shown = rows.groupBy("fp").agg(F.min(F.struct(place.alias("low"), *_SKETCHED)).alias("m"))
    nodes = staged(shown.select("fp", "m.low", *[f"m.{c}" for c in _SKETCHED]), "nodes")
    agree = blocks_for(nodes.count(), budget)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("its_id")) & (F.xxhash64("text") == F.col("its_digest"))

    def linked(found: DataFrame) -> DataFrame:
        pairs = staged(found, "pairs")
        asked = shuffled(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()).join(nodes, "fp")
        asked = staged(asked.select("fp", F.col("low.doc_id").alias("its_id"), F.col("low.digest").alias("its_digest")), "asked")
        return _similar(pairs, docs.select("doc_id", "text").join(_beside(asked), same).select("fp", "text").dropDuplicates(["fp"]), size, similarity)

    every = linked(links(nodes, min(budget, BUDGET), similarity=similarity, few=CLOSEST))
    for few in (CLOSEST, 0):
        every = staged(every, "links")
        group = staged(_with_component(nodes, every), "groups")
        every = every.unionByName(linked(links(group, budget, agree=agree, similarity=similarity, few=few)))
    nodes = _with_component(nodes, every)
    best = nodes.groupBy("component").agg(F.min("low").alias("best"))
    own = staged(keys.join(shuffled(nodes.select("fp", "component").join(shuffled(best), "component").select("fp", "best")), "fp").select(
        F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest"), "n", (place == F.col("best")).alias("stays")), "survivors")
    kept = docs.join(_beside(own.where("NOT stays")), same, "left_anti")
    twice = own.where("stays AND n > 1")
    if twice.isEmpty():
        return kept
    twice = _beside(twice)
    again = kept.join(twice, same, "left_semi").withColumn("its_digest", F.xxhash64("text")).dropDuplicates(["doc_id", "its_digest"])
    return kept.join(twice, same, "left_anti").unionByName(again.drop("its_digest"))
