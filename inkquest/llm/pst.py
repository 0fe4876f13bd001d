"""Language-model scoring by a probabilistic suffix tree over the bytes of normalised text.

Normal form: A-Z lower-cased, words joined by one blank, one line feed as the end; no word
holds a blank or line feed, so it is one to one with the sequence of words.  Contexts are byte
strings of up to DEPTH bytes that may begin at, but never reach over, the start of a text, and
beginnings of words of any length.  The former are the head of the tree; the latter are as many
as the corpus gives a count of MIN_COUNT, and are kept with the words, spread over the cluster.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, repeat
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

#: The head of the tree, an automaton in every task: its longest context, and the share of all symbols below which it does
#: not grow.  At most 1 / P_MIN contexts of each length exist, so it fits in a task however large the corpus is.
DEPTH, P_MIN = 6, 1e-5
#: The rest of the tree, kept by beginnings of words: least count of a context, and bytes that words share which meet in a
#: group; a beginning of more than HOT_WORDS words is counted by what follows it, and its words meet by more bytes, which are
#: looked for up to the next of these numbers at a time.
MIN_COUNT, KEYS, HOT_WORDS = 8, (4, 12, 36, 108), 200_000
#: Words of at least this share of all tokens are scored from a table in the task (at most
#: 1 / HEAD_SHARE of them); all others by a join, which for that reason has no hot key.
HEAD_SHARE = 1e-6
#: Bytes of text that are counted and scored at once, lanes of a scan, words counted before they are passed on.
COUNT_SLICE, SCORE_SLICE, LANES, HELD_WORDS = 3_000_000, 1_000_000, 1024, 300_000
END = 10
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def _slices(column: pa.Array, most: int) -> Iterator[list[list[bytes]]]:
    """Word lists of the texts, some MB of them at a time."""
    held, size = [], 0
    for t in column:
        w = words_of(t.as_py())
        held.append(w)
        size += 8 * len(w)
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def stream(texts: list[list[bytes]]) -> np.ndarray:
    """Symbols of all texts, each with its end."""
    return np.frombuffer(b"\n".join([*map(b" ".join, texts), b""]), np.uint8)


# ---------------------------------------------------------------- learning


class _Sums:
    """Sparse sums of codes, merged when many are held."""

    def __init__(self):
        self.codes, self.counts, self.held = [], [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(counts)
        self.held += len(codes)
        if self.held > 4_000_000:
            c, n = self.merged()
            self.codes, self.counts, self.held = [c], [n], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.codes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        n = np.zeros(len(codes), np.int64)
        np.add.at(n, at, np.concatenate(self.counts))
        return codes, n


def _count_words_and_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, code, n): word counts with the empty word for ends, and counts of three neighbouring symbols.

    Rows are (text, whether to learn from it); words of the others come with a count of 0.
    """
    found, triples = Counter(), _Sums()

    def words() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.nulls(len(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
                                         ["word", "code", "n"])
        found.clear()
        return out

    def split(b: pa.RecordBatch) -> Iterator[tuple[bool, list[list[bytes]]]]:
        for learn in (True, False):
            rows = b.filter(pc.equal(b.column(1), learn))
            yield from ((learn, texts) for texts in _slices(rows.column(0), COUNT_SLICE))

    for b in batches:
        for learn, texts in split(b):
            for w in texts:
                if learn:
                    found.update(w)
                else:
                    for x in w:
                        found.setdefault(x, 0)
            found[b""] += len(texts) if learn else 0
            if len(found) > HELD_WORDS:
                yield words()
            if not learn:
                continue
            s = np.r_[np.full(2, END, np.uint8), stream(texts)]
            used = np.flatnonzero(np.bincount(s, minlength=256))
            small = np.zeros(256, np.int32)
            small[used] = np.arange(len(used))
            x, k = small[s], len(used)
            n = np.bincount((x[:-2] * k + x[1:-1]) * k + x[2:], minlength=k ** 3)
            at = np.flatnonzero(n)
            triples.add((used[at // (k * k)] << 16) | (used[at // k % k] << 8) | used[at % k], n[at])
    if found:
        yield words()
    codes, n = triples.merged()
    if len(codes):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.binary()), pa.array(codes), pa.array(n)], ["word", "code", "n"])


@dataclass
class Level:
    """Contexts of one length: the suffix one shorter, the byte before it, what follows how often."""

    parent: np.ndarray
    first: np.ndarray
    follow: np.ndarray | None  # contexts x symbols


@dataclass
class Symbols:
    """Bytes seen in training; all others are one further symbol."""

    used: np.ndarray

    @property
    def n(self) -> int:
        return len(self.used)

    def table(self) -> np.ndarray:
        t = np.full(256, self.n, np.int64)
        t[self.used] = np.arange(self.n)
        return t


def _steps(levels: list[Level], n: int) -> list[np.ndarray]:
    """For each length the table (context, byte before) -> context one longer; the last row is no context."""
    out = []
    for low, high in zip(levels, levels[1:]):
        t = np.full((len(low.first) + 1, n + 1), len(high.first), np.int32)
        t[high.parent, high.first] = np.arange(len(high.first))
        out.append(t)
    return out


def _count_level(symbols: Symbols, first: np.ndarray, steps: list[np.ndarray], size: int):
    """(code, n) for contexts of the deepest length: what follows (even codes), what stands before (odd)."""
    k = symbols.n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, depth = symbols.table().astype(np.int32), len(steps) + 1
        start = np.full(k, len(first), np.int32)
        start[first] = np.arange(len(first))
        follow, before = np.zeros(size * k, np.int64), np.zeros(size * k, np.int64)
        for b in batches:
            for texts in _slices(b.column(0), COUNT_SLICE):
                x = np.r_[np.full(depth + 1, table[END], np.int32), table[stream(texts)]]
                ids = start[x]
                for j, t in enumerate(steps, 1):
                    ids = t[ids[1:], x[:-j]]
                # ids[i] is the context of ``depth`` symbols that starts at i
                is_context = ids[1:len(x) - depth] < size
                c = ids[1:len(x) - depth][is_context] * k
                follow += np.bincount(c + x[depth + 1:][is_context], minlength=size * k)
                before += np.bincount(c + x[:len(is_context)][is_context], minlength=size * k)
        for kind, n in ((0, follow), (1, before)):
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(2 * at + kind), pa.array(n[at])], ["code", "n"])

    return run


@dataclass
class Tree:
    """The automaton of the retained contexts: log10 probabilities, the next state per state and symbol, and how long a state's context is."""

    symbols: Symbols
    logp: np.ndarray
    next: np.ndarray
    start: int
    depth: int
    length: np.ndarray

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 probability of every text, read in lanes that warm up over the bytes before them."""
        k = self.symbols.n + 1
        s = stream(texts)
        ends = np.flatnonzero(s == END)
        end = self.symbols.table()[END]
        lanes = min(LANES, len(s))
        t = -(-len(s) // lanes)
        x = np.full(self.depth + lanes * t, end, np.int64)
        x[self.depth:self.depth + len(s)] = self.symbols.table()[s]
        grid = np.lib.stride_tricks.as_strided(x, (self.depth + t, lanes), (x.itemsize, t * x.itemsize))
        state = np.full(lanes, self.start, np.int64)
        out = np.empty((t, lanes), np.float32)
        flat_next, flat_logp = self.next.ravel(), self.logp.ravel()
        for i in range(self.depth + t):
            at = state * k + grid[i]
            if i >= self.depth:
                out[i - self.depth] = flat_logp[at]
            state = flat_next[at]
        total = np.add.reduceat(out.T.ravel()[:len(s)].astype(np.float64), np.r_[0, ends[:-1] + 1])
        return total


def learn(docs: DataFrame, usable: Column | None = None, text: str = "text") -> tuple[DataFrame, Tree]:
    """(word, n) of all texts, n in those of training, ends under the empty word, and the tree; every text is counted whole.

    One pass counts words and neighbouring triples, one more each further length of context.
    A task sends one count for each of its words and for each context and symbol.
    """
    learns = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    every = docs.select(F.col(text).alias("t"), learns.alias("learns"))
    src = every.where("learns").select("t")
    first = staged(every.mapInArrow(_count_words_and_triples, "word binary, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n")), "counts")
    words = first.where("code IS NULL").select("word", "n")
    got = first.where("code IS NOT NULL").select("code", "n").toArrow()  # at most 256 ** 3 rows
    code, n = got["code"].to_numpy(), got["n"].to_numpy()
    a, b, c = code >> 16, code >> 8 & 255, code & 255
    used = np.unique(np.r_[a, b, c, END]).astype(np.int64)
    symbols = Symbols(used)
    k, end, table = symbols.n + 1, symbols.table()[END], symbols.table()
    a, b, c = table[a], table[b], table[c]
    total = int(n.sum())
    enough = max(2, P_MIN * total)

    def frequent(codes: np.ndarray) -> np.ndarray:
        kind, at = np.unique(codes, return_inverse=True)
        s = np.zeros(len(kind), np.int64)
        np.add.at(s, at, n[mask])
        return kind[s >= enough]

    mask = np.ones(len(n), bool)
    root = np.zeros(k, np.int64)
    np.add.at(root, c, n)
    one = frequent(b) if total else np.empty(0, np.int64)
    levels = [Level(np.zeros(len(one), np.int64), one, np.zeros((len(one), k), np.int64))]
    at1 = np.full(k, -1)
    at1[one] = np.arange(len(one))
    ok = at1[b] >= 0
    np.add.at(levels[0].follow, (at1[b[ok]], c[ok]), n[ok])
    mask = (b != end) & (at1[b] >= 0)
    two = frequent((at1[b] * k + a)[mask]) if mask.any() else np.empty(0, np.int64)
    levels.append(Level(two // k, two % k, np.zeros((len(two), k), np.int64)))
    at2 = np.full(len(one) * k + 1, -1)
    at2[two] = np.arange(len(two))
    pair = np.where(at1[b] >= 0, at1[b] * k + a, len(one) * k)
    ok = mask & (at2[pair] >= 0)
    np.add.at(levels[1].follow, (at2[pair[ok]], c[ok]), n[ok])
    tail = np.where(at1[c] >= 0, at1[c] * k + b, len(one) * k)
    mask = (c != end) & (b != end) & (at2[tail] >= 0)
    three = frequent((at2[tail] * k + a)[mask]) if mask.any() else np.empty(0, np.int64)
    levels.append(Level(three // k, three % k, None))
    for depth in range(3, DEPTH + 1):
        level = levels[-1]
        size = len(level.first)
        level.follow = np.zeros((size, k), np.int64)
        if not size:
            break
        run = _count_level(symbols, levels[0].first, _steps(levels, symbols.n), size)
        got = src.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most contexts x symbols
        code, n = got["code"].to_numpy(), got["n"].to_numpy()
        f = code % 2 == 0
        level.follow.ravel()[code[f] // 2] = n[f]
        if depth < DEPTH:
            code, n = code[~f] // 2, n[~f]
            grow = (n >= enough) & (level.first[code // k] != end)
            levels.append(Level(code[grow] // k, code[grow] % k, None))
    return words, _tree(symbols, root, levels)


def _tree(symbols: Symbols, root: np.ndarray, levels: list[Level]) -> Tree:
    """Test the contexts, smooth what is left and make the automaton of longest suffixes.

    A context stays if what it gains over its suffix, count times divergence, pays for its own
    parameters (half a logarithm of the count each), or if another one needs it as a suffix or
    prefix.  Each distribution is mixed with that of its suffix by the number of kinds seen.
    """
    k, n = symbols.n + 1, root.sum()
    unseen = 256 - symbols.n
    base = (root + 1.0) / (n + 256)
    base[-1] = 1.0 / (n + 256) if unseen else 0.0
    names: list[list[bytes]] = [[b""]]
    probs, keep = [base[None, :]], [np.ones(1, bool)]
    for level in levels:
        up = probs[-1][level.parent] if len(level.parent) else np.empty((0, k))
        total, kinds = level.follow.sum(1, keepdims=True), (level.follow > 0).sum(1, keepdims=True)
        probs.append((level.follow + kinds * up) / np.maximum(total + kinds, 1) if len(up) else up)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = level.follow / np.maximum(total, 1)
            gain = np.where(level.follow > 0, level.follow * np.log(own / np.maximum(up, 1e-300)), 0).sum(1)
        keep.append((gain >= 0.5 * np.log(np.maximum(total[:, 0], 1)) * np.maximum(kinds[:, 0] - 1, 1)) & (total[:, 0] > 0))
        names.append([bytes([symbols.used[f]]) + names[-1][p] for p, f in zip(level.parent.tolist(), level.first.tolist())])
    place = {name: (d, i) for d, level in enumerate(names) for i, name in enumerate(level)}
    need = [name for d, level in enumerate(names) for i, name in enumerate(level) if keep[d][i]]
    held = set(need)
    while need:
        name = need.pop()
        for part in (name[1:], name[:-1]):
            if part in place and part not in held:
                held.add(part)
                need.append(part)
    states = sorted(held, key=lambda s: (len(s), s))
    number = {name: i for i, name in enumerate(states)}
    logp = np.log10(np.array([probs[d][i] for d, i in map(place.get, states)])).astype(np.float32) if states else np.zeros((1, k), np.float32)
    logp[~np.isfinite(logp)] = -9.0
    nxt = np.zeros((len(states), k), np.int32)
    for i, name in enumerate(states):
        nxt[i] = nxt[number[name[1:]]] if name else 0
        for s in range(symbols.n):
            to = number.get(name + bytes([symbols.used[s]]))
            if to is not None:
                nxt[i, s] = to
    start = number.get(bytes([END]), 0)
    nxt[:, symbols.table()[END]] = start
    return Tree(symbols, logp, nxt, start, DEPTH, np.array([len(name) for name in states] or [0], np.int16))


# ---------------------------------------------------------------- contexts that begin with a word


def _gains(tree: Tree, blank: int, end: int, j: int, seen: list[tuple[int, int]]) -> tuple[dict[int, float], float] | None:
    """What a beginning of ``j`` bytes adds before each of ``seen`` (byte or -1 for the end, count) and before all others; None if it is not kept."""
    if tree.length[blank] > j or tree.length[end] > j:
        return None
    table, row = tree.symbols.table(), tree.logp[blank]
    up = [10.0 ** float(row[table[s]]) if s >= 0 else 10.0 ** float(row[table[32]]) + 10.0 ** float(row[table[END]]) for s, _ in seen]
    total, kinds = sum(n for _, n in seen), len(seen)
    worth = sum(n * log(n / total / u) for (_, n), u in zip(seen, up))
    if worth < 0.5 * log(total) * max(kinds - 1, 1):
        return None
    return {s: log10((n + kinds * u) / (total + kinds) / u) for (s, n), u in zip(seen, up)}, log10(kinds / (total + kinds))


def _states(tree: Tree, begun: bytes) -> list[int]:
    """Where the automaton is behind a beginning after a blank, and at the start of a text."""
    table, states = tree.symbols.table(), []
    for first in (32, END):
        state = 0
        for b in (first, *begun):
            state = tree.next[state, table[b]]
        states.append(state)
    return states


def _deeper(tree: Tree, group: list[tuple[bytes, int]], shortest: int) -> tuple[list[float], int]:
    """What the contexts from the start of a word on add to the log10 probability of each word, and how many are kept.

    ``group`` holds all words with the same first ``shortest`` bytes, in order, so a context is a
    range of it.  A context is the beginning of a word, at
    least that long; it is kept if it occurs MIN_COUNT times and pays for its parameters over the
    state that the automaton has there, as in ``_tree``.  What follows is a byte or the word's end,
    of which blank and end of text keep their shares.  Where the automaton holds the whole beginning itself nothing is added.
    """
    words, more, kept = [w for w, _ in group], [0.0] * len(group), 0
    if len(words[0]) < shortest:
        return more, 0
    before = [0, *accumulate(n for _, n in group)]
    if before[-1] < MIN_COUNT:
        return more, 0
    table, states = tree.symbols.table(), _states(tree, words[0][:shortest])
    stack = [(0, len(words), shortest, *states)]
    while stack:
        a, b, j, blank, end = stack.pop()
        runs, i = [], a
        while i < b:  # words that go on with the same byte, the word that ends here first
            s = words[i][j] if len(words[i]) > j else -1
            k = i + 1
            while k < b and s >= 0 and words[k][j] == s:
                k += 1
            runs.append((s, i, k, before[k] - before[i]))
            i = k
        got = _gains(tree, blank, end, j, [(s, n) for s, _, _, n in runs if n])
        if got is not None:
            kept += 1
            gain, other = got
            for s, i, k, _ in runs:
                g = gain.get(s, other)
                for x in range(i, k):
                    more[x] += g
        stack += [(i, k, j + 1, tree.next[blank, table[s]], tree.next[end, table[s]]) for s, i, k, n in runs if s >= 0 and n >= MIN_COUNT]
    return more, kept


def _crowded(words: DataFrame) -> dict[bytes, list[tuple[int, int]]]:
    """What follows each beginning of more than HOT_WORDS words (byte or -1 for the end, count); with one, all shorter ones are there.

    There is at most one of a length for every HOT_WORDS words, with at most 257 rows each.
    """
    out: dict[bytes, list[tuple[int, int]]] = {}
    key = F.substring("word", 1, KEYS[0])
    hot = words.where(F.length("word") >= KEYS[0]).groupBy(key.alias("begun")).agg(F.count("*").alias("m")).where(F.col("m") > HOT_WORDS)
    hot = [bytes(r["begun"]) for r in hot.select("begun").collect()]
    for short, longer in zip(KEYS, KEYS[1:]):
        if not hot:
            break
        begin = short if short == KEYS[0] else short + 1  # the former lengths are counted
        some = words.where(F.substring("word", 1, short).isin(hot) & (F.length("word") >= begin))
        at = F.explode(F.sequence(F.lit(begin), F.least(F.length("word"), F.lit(longer))))
        parts = some.select("word", "n", at.alias("j")).select(F.expr("substring(word, 1, j)").alias("begun"), F.expr("substring(word, j + 1, 1)").alias("s"), "n")
        parts = parts.groupBy("begun", "s").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
        many = parts.groupBy("begun").agg(F.sum("m").alias("m")).where(F.col("m") > HOT_WORDS).select("begun")
        for r in parts.join(many, "begun", "left_semi").select("begun", "s", "n").collect():
            out.setdefault(bytes(r["begun"]), []).append((r["s"][0] if r["s"] else -1, r["n"]))
        hot = [c for c in out if len(c) == longer]
    # the words of the longest ones meet in a group each, which counts them
    return {c: sorted(seen) for c, seen in out.items() if len(c) < KEYS[-1]}


def deepen(words: DataFrame, tree) -> DataFrame:
    """``words`` (word, n) with ``deeper``: what contexts longer than the automaton's add to a word's log10 probability.

    The automaton is the head of the tree, small enough for every task; this is the rest of it.
    Contexts that reach back to the start of their word depend on the word alone, so each is
    counted, tested and used where the distinct words with the same beginning meet: its size is that of the
    vocabulary, and nothing of it goes through the driver but beginnings of more than HOT_WORDS words. Those are
    counted by what follows them and add the same to all words that meet by a longer one, so that the result does not
    depend on where words meet.
    """
    crowded = _crowded(words)
    first = F.lit(KEYS[0])
    for size in sorted({len(c) for c in crowded}):
        first = first + F.when(F.substring("word", 1, size).isin([c for c in crowded if len(c) == size]), 1).otherwise(0)
    above = {c: _gains(tree.value, *_states(tree.value, c), len(c), [x for x in seen if x[1]]) for c, seen in crowded.items() if sum(n for _, n in seen) >= MIN_COUNT}
    shortest = KEYS[0]
    keyed = words.select("word", "n", first.cast("int").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tree.value
        held: list[tuple[bytes, int]] = []
        out: list[list] = [[], [], []]
        now = None

        def close() -> None:
            more, _ = _deeper(model, held, now[0])
            base = 0.0
            for j in range(shortest, now[0]):
                if (got := above.get(now[1][:j])) is not None:
                    base += got[0].get(now[1][j] if len(now[1]) > j else -1, got[1])
            more = [base + m for m in more]
            for column, values in zip(out, ([w for w, _ in held], [n for _, n in held], more)):
                column += values
            held.clear()

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["word", "n", "deeper"])
            for column in out:
                column.clear()
            return rows

        for b in batches:
            for w, n, k in zip(*(c.to_pylist() for c in b.columns)):
                key = (k, w[:k])
                if key != now:
                    if held:
                        close()
                    if len(out[0]) > 20_000:
                        yield batch()
                    now = key
                held.append((w, n))
        if held:
            close()
        yield batch()

    key = F.substring("word", 1, F.col("k"))
    return keyed.repartition("k", key).sortWithinPartitions("k", key, "word").mapInArrow(run, "word binary, n long, deeper double")


# ---------------------------------------------------------------- scoring


def _score(tree, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (words, value, deep, end, end_known) = tree.value, head.value
        index = {w: i for i, w in enumerate(words)}
        table, deeper = np.r_[value, 0.0], np.r_[deep, 0.0]
        for b in batches:
            done = 0
            for texts in _slices(b.column(2), SCORE_SLICE):
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                flat = [w for t in texts for w in t]
                at = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
                stop = np.cumsum(size)
                sums = np.diff(np.r_[0, np.cumsum(table[at])][np.r_[0, stop]])
                known = np.diff(np.r_[0, np.cumsum(at >= 0)][np.r_[0, stop]])
                more = np.diff(np.r_[0, np.cumsum(deeper[at])][np.r_[0, stop]])
                out = np.flatnonzero(at < 0)
                ends = np.r_[0, np.searchsorted(out, stop)].astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(ends), pa.array([flat[i] for i in out.tolist()], pa.binary()))
                rows = slice(done, done + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[rows], b.column(1)[rows], pa.array(size + 1), pa.array(known + end_known), pa.array(sums + end), pa.array(model.score(texts) + more), tail],
                    ["rid", "doc_id", "n_tokens", "known", "head", "score", "tail"])
                done += len(texts)

    return run


def score(docs: DataFrame, usable: Column, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The tree and the word counts learn from the rows where ``usable`` holds.  Null and empty
    texts are one end.  Repeated rows are scored each; without any training text every word is
    unknown and every byte as likely as another.  Further columns are ignored.
    """
    spark = docs.sparkSession
    words, tree = learn(docs, usable, text)
    shared = spark.sparkContext.broadcast(tree)
    words = staged(deepen(words, shared), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    whole = float(n + v + 1)
    top = words.where(((F.col("n") > 0) & (F.col("n") >= HEAD_SHARE * n)) | (F.col("word") == F.lit(b""))).toArrow()  # at most 1 / HEAD_SHARE + 1 rows
    count, deep = (dict(zip(top["word"].to_pylist(), top[c].to_pylist())) for c in ("n", "deeper"))
    ends = count.pop(b"", 0)
    deep.pop(b"", 0)
    value = np.log10((np.fromiter(count.values(), np.float64, len(count)) + 1) / whole)
    head = spark.sparkContext.broadcast((list(count), value, np.fromiter(deep.values(), np.float64, len(deep)), float(np.log10((ends + 1) / whole)), int(ends > 0)))
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), F.col(text).alias("t"))
    rows = staged(src.mapInArrow(_score(shared, head),
                                 f"rid long, doc_id {kind}, n_tokens long, known long, head double, score double, tail array<binary>"), "scores")
    tail = rows.select("rid", F.explode("tail").alias("word")).join(words, "word", "left").groupBy("rid").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(whole))).alias("rest"), F.count_if(F.col("n") > 0).alias("more"),
        F.sum(F.coalesce("deeper", F.lit(0.0))).alias("deeper"))
    return rows.drop("tail").join(tail, "rid", "left").select(
        F.col("doc_id").alias(key), held_out.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("head") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"))
