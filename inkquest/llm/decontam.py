"""Benchmark decontamination: documents stream through a suffix automaton of the normalised items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: Words of a window, and bytes of item texts that one automaton holds; more items make more automata.
WINDOW, CHUNK_BYTES = 10, 8_000_000
#: A-Z to lower case, every ASCII character outside letters and digits to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over word ids of all items of a chunk.

    A state stands for the word sequences that end at the same places of the items; ``length``
    is its longest one and ``link`` the state of the longest suffix that occurs elsewhere too.
    ``window_items`` names the items whose windows a state's sequence of WINDOW words starts;
    items shorter than that are whole windows and are kept by state and length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        seqs = []
        for name, words in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if seq:
                seqs.append((name, seq))
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shortest = min([window, *(len(s) for _, s in seqs)])
        self.window_items: dict[int, set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}  # state -> length -> short items that are it
        for name, seq in seqs:
            state = matched = 0
            for c in seq:
                state, matched = self.next[state][c], matched + 1
                if matched >= window:
                    state = self.cut(state, window)
                    matched = window
                    self.window_items.setdefault(state, set()).add(name)
            if len(seq) < window:
                self.whole.setdefault(state, {}).setdefault(len(seq), set()).add(name)

    def _extend(self, last: int, c: int) -> int:
        nxt, length, link = self.next, self.length, self.link
        q = nxt[last].get(c)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def cut(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match that reached ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words stand in an occurrence of a window, and the items whose windows occur.

        Words outside the items reset the match, so only runs of known words that are long
        enough for the shortest window are walked.
        """
        n = len(words)
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, n)
        known = np.r_[False, ids >= 0, False]
        edge = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.shortest
        mark, items = np.zeros(n + 1, np.int32), set()
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            state = matched = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                state = self.next[state].get(c, 0)
                matched = matched + 1 if state else 0
                if matched >= self.window:
                    s = self.cut(state, self.window)
                    items |= self.window_items.get(s, set())
                    mark[i - self.window + 1] += 1
                    mark[i + 1] -= 1
                if self.whole:
                    s = state
                    while s > 0:
                        for size, names in self.whole.get(s, {}).items():
                            if size <= matched:
                                items |= names
                                mark[i - size + 1] += 1
                                mark[i + 1] -= 1
                        s = self.link[s]
        return np.cumsum(mark[:n]) > 0, items


def _chunks(bench: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    held, size = [], 0
    for r in bench.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        held.append((r["i"] or "", fold(r["t"])))
        size += len(r["t"])
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
            window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (a packed bit per word) and items (ids as sorted strings).

    Items are streamed to the driver in chunks of bounded size and each chunk is one pass over
    the documents, so the automaton in a task stays bounded however many items there are; the
    benchmark tables at hand are one chunk.  Documents never move.  A null text has no words
    and null items are skipped; repeated items and rows are harmless; a column of ``docs``
    named like an added one is replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(*keep, F.lit(0).alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    at = keep.index(text)
    for chunk in _chunks(bench, item, item_text, chunk_bytes):
        held = spark.sparkContext.broadcast(chunk)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            auto = Automaton(held.value, window)
            for b in batches:
                n, hits, items = [], [], []
                for t, h, old in zip(b.column(at), b.column(len(keep) + 1), b.column(len(keep) + 2)):
                    words = fold(t.as_py())
                    hit, found = auto.scan(words)
                    if h.is_valid:
                        hit |= np.unpackbits(np.frombuffer(h.as_py(), np.uint8), count=len(words)).astype(bool)
                    n.append(len(words))
                    hits.append(np.packbits(hit).tobytes())
                    items.append(sorted(found.union(old.as_py() or ())) if found or len(old) else [])
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(n, pa.int32()), pa.array(hits, pa.binary()),
                                                  pa.array(items, pa.list_(pa.string()))], names=b.schema.names)

        out = out.mapInArrow(scan, schema)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, hit, joined = [], [], []
        for words, bits, items in zip(b.column(1), b.column(2), b.column(3)):
            n.append(words.as_py())
            hit.append(int(np.unpackbits(np.frombuffer(bits.as_py() or b"", np.uint8)).sum()))
            joined.append(hashlib.sha256(",".join(items.as_py() or ()).encode()).hexdigest())
        size = [len(x) for x in b.column(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(size, pa.int64()),
                                          pa.array(joined, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())],
                                         ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def report(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = matches(docs.select("doc_id", "text"), bench, **how)
    return m.select("doc_id", "n_words", "hits", "items").mapInArrow(
        _count_words, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _without(text: str, hit: np.ndarray) -> str:
    """``text`` without the spans of hit words; what stands between two of them goes too."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    begin, end = edge[::2], edge[1::2]
    change = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    kept, at = [], 0
    for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
        kept.append(raw[at:int(begin[a])])
        at = int(end[b - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, bench: DataFrame, max_coverage: float = 0.5, **how) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of ``text``, and a document
    of whose words more than ``max_coverage`` are hit goes as a whole.  Rows without a hit keep
    their text to the byte, null included, and all other columns stay whatever their names."""
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")
    m = matches(docs.toDF(*[f"_c{i}" for i in range(len(columns))]), bench, text=f"_c{at}", **how)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for t, n, bits in zip(b.column(at), b.column("n_words"), b.column("hits")):
                hit = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=n.as_py()).astype(bool) if bits.is_valid else np.zeros(0, bool)
                keep.append(not hit.any() or hit.sum() <= max_coverage * len(hit))
                texts.append(_without(t.as_py(), hit) if hit.any() and keep[-1] else t.as_py())
            out = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep, pa.bool_()))

    return m.drop("items").mapInArrow(cut, schema)
