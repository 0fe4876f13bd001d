"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .components import components

#: Bound of the fit: vectors and bytes of the sample that the cells are learned from.  All vectors are dealt to cells.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS, MAX_CELLS = 20_000, 64_000_000, 10, 1024
#: Vectors of one block; a task compares two blocks and holds BLOCK x SLICE cosines at once.
BLOCK, SLICE = 4096, 512


def usable(v: Column) -> Column:
    """Vectors that can link: no null, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(flat: np.ndarray, n: int) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square over- or underflows."""
    x = flat.astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(distinct: DataFrame, n: int, seed: int = 1) -> dict[int, np.ndarray]:
    """Centres per vector length by spherical k-means on a bounded sample.

    About the square root of the vectors' number over nine makes the cells, at most MAX_CELLS.
    """
    order = F.xxhash64("rep", F.lit(seed))
    dim = distinct.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = distinct.orderBy(order, "rep").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["embedding"]), []).append(r["embedding"])
    centres = {}
    for d, got in by_dim.items():
        x = unit(np.array(got, np.float64).ravel(), len(got))
        k = max(1, min(MAX_CELLS, len(x) // 8, round((n * len(x) / len(rows)) ** 0.5 / 9)))
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            size = np.sqrt((total * total).sum(1))
            c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
        centres[d] = c
    return centres


def deal(distinct: DataFrame, centres: dict[int, np.ndarray], least: float) -> DataFrame:
    """(rep, w, embedding, dim, home, guests): the nearest cell, and the cells where a partner may be at home.

    Two unit vectors of cosine ``least`` are at most sqrt(2 - 2 least) apart.  If they have
    different homes, the plane between the two centres parts them, so one of them is within
    half that distance of it.  A vector is therefore a guest in every cell whose plane is that
    near, and each linked pair meets in the home of one of the two.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * least)) / 2 + 1e-9
    held = distinct.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(2)
            size = np.diff(vec.offsets.to_numpy())
            flat, at = vec.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)]
            home, guests = np.zeros(len(size), np.int32), [np.empty(0, np.int32)] * len(size)
            for d in np.unique(size).tolist():
                c = held.value.get(d)
                if c is None:
                    continue
                mine = np.flatnonzero(size == d)
                gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-18))
                for part in np.array_split(mine, max(1, len(mine) // 1024)):
                    s = unit(np.concatenate([flat[at[i]:at[i] + d] for i in part]), len(part)) @ c.T
                    h = s.argmax(1)
                    margin = (s[np.arange(len(part)), h][:, None] - s) / gap[h]
                    near = margin <= reach
                    near[np.arange(len(part)), h] = False
                    home[part] = h
                    for i, row in zip(part.tolist(), near):
                        guests[i] = np.flatnonzero(row).astype(np.int32)
            ends = np.r_[0, np.cumsum([len(g) for g in guests])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(guests) if guests else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.array(home), lists],
                                             ["rep", "w", "embedding", "dim", "home", "guests"])

    kind = distinct.schema["embedding"].dataType.simpleString()
    return distinct.select("rep", "w", "embedding").mapInArrow(run, f"rep long, w long, embedding {kind}, dim int, home int, guests array<int>")


def block_pairs(dealt: DataFrame, block: int) -> DataFrame:
    """Every vector in each pair of blocks that it takes part in.

    A cell is cut into blocks by a hash of the id, as many as its rows ask for; home blocks
    meet each other and all guest blocks, guests do not meet guests.
    """
    home = dealt.select("*", F.col("home").alias("cell"), F.lit(True).alias("at_home"))
    guest = dealt.select("*", F.explode("guests").alias("cell"), F.lit(False).alias("at_home"))
    cells = home.select("dim", "cell", "at_home").unionByName(guest.select("dim", "cell", "at_home")).groupBy("dim", "cell").agg(
        F.ceil(F.count_if("at_home") / block).cast("int").alias("h"), F.ceil(F.count_if(~F.col("at_home")) / block).cast("int").alias("g"))
    spot = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), F.col(n)).cast("int")
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    zero, one = F.lit(0), F.lit(1)
    at = F.col("at")
    home = home.join(cells, ["dim", "cell"]).withColumn("at", spot("h")).withColumn("p", F.explode(F.concat(
        F.transform(upto(at, F.col("h") + F.col("g") - one), lambda j: pair(at, j, 0)),
        F.transform(upto(zero, at - one), lambda i: pair(i, at, 1)))))
    guest = guest.join(cells.where("h > 0"), ["dim", "cell"]).withColumn("at", F.col("h") + spot("g")).withColumn(
        "p", F.explode(F.transform(upto(zero, F.col("h") - one), lambda i: pair(i, at, 1))))
    cols = ["dim", "cell", "p.i", "p.j", "p.side", "rep", "w", "embedding", "home", "guests"]
    return home.select(*cols).unionByName(guest.select(*cols))


def _labels(mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable inside one block pair, for its rows and columns."""
    top = np.iinfo(np.int64).max
    while True:
        c = np.minimum(cols, np.where(mask, rows[:, None], top).min(0))
        r = np.minimum(rows, np.where(mask, c[None, :], top).min(1))
        if (c == cols).all() and (r == rows).all():
            return r, c
        rows, cols = r, c


def _compare(least: float):
    def side(t: pa.Table, k: int):
        t = t.filter(pc.equal(t["side"], k)).combine_chunks()
        vec = t["embedding"].combine_chunks()
        n = len(t)
        x = unit(vec.flatten().to_numpy(zero_copy_only=False), n) if n else np.empty((0, 1))
        return t["rep"].to_numpy(), t["w"].to_numpy(), x, t["home"].to_numpy(), t["guests"].combine_chunks()

    def guest_in(guests: pa.ListArray, cells: int) -> np.ndarray:
        flat = guests.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(guests), max(cells, int(flat.max(initial=-1)) + 1)), bool)
        out[np.repeat(np.arange(len(guests)), np.diff(guests.offsets.to_numpy())), flat] = True
        return out

    def run(t: pa.Table) -> pa.Table:
        cell, itself = t["cell"][0].as_py(), t["i"][0].as_py() == t["j"][0].as_py()
        ids, w, x, _, guests = side(t, 0)
        other = (ids, w, x, None, guests) if itself else side(t, 1)
        o_ids, o_w, y, o_home, _ = other
        a, b, n = [], [], []
        if len(ids) and len(o_ids):
            count, o_count = np.zeros(len(ids), np.int64), np.zeros(len(o_ids), np.int64)
            mask = np.zeros((len(ids), len(o_ids)), bool)
            at_home = itself or bool((o_home == cell).all())
            # A pair with two homes may meet in both; it counts in the smaller one if it does.
            seen = None if at_home else guest_in(guests, int(o_home.max()) + 1)
            for s in range(0, len(ids), SLICE):
                m = x[s:s + SLICE] @ y.T >= least
                if itself:
                    m[np.arange(len(m)), np.arange(s, s + len(m))] = False
                elif not at_home:
                    m &= ~(seen[s:s + SLICE][:, o_home] & (o_home < cell)[None, :])
                mask[s:s + SLICE] = m
                count[s:s + SLICE] = m @ o_w
                if not itself:
                    o_count += w[s:s + SLICE] @ m
            r, c = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
            if len(r):
                low_r, low_c = _labels(mask[np.ix_(r, c)], ids[r], o_ids[c])
                edges = np.r_[ids[r], o_ids[c]], np.r_[low_r, low_c]
                a += [ids[r], *([] if itself else [o_ids[c]]), edges[0]]
                b += [np.full(len(r) + (0 if itself else len(c)), -1), edges[1]]
                n += [count[r], *([] if itself else [o_count[c]]), np.zeros(len(edges[0]), np.int64)]
        cat = lambda v: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64)
        a, b, n = cat(a), cat(b), cat(n)
        return pa.table({"a": a, "b": b, "n": n, "edge": n == 0})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Pairs of cosine ``least`` or more link, none is left out: what the cells part is compared
    as a guest.  Equal vectors are one node with a weight, so a vector that a third of all rows
    share is compared once; a dense cell is cut into blocks, and a task returns counts and a
    spanning forest of its links, never the pairs.  Vectors of different lengths do not link.
    Null, zero, empty or non-finite vectors link with nothing and stay; so do rows with a null
    id, which have no component and are not kept.  Rows that repeat an id are one node.
    """
    t = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    ok = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    good = t.where(ok)
    distinct = staged(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).select("rep", "w", "embedding"), "vectors")
    centres = fit_cells(distinct, distinct.count())
    pairs = block_pairs(staged(deal(distinct, centres, least), "cells"), block)
    found = staged(pairs.groupBy("dim", "cell", "i", "j").applyInArrow(_compare(least), "a long, b long, n long, edge boolean"), "links")
    degree = found.where("not edge").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.where("edge"))
    rows = good.join(distinct, "embedding").select("vec_id", "rep", "w")
    info = distinct.select("rep").distinct().join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    linked = rows.join(info, "rep").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = t.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
