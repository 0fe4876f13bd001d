"""Byte-level BPE: many words are encoded together by batched merge rounds over flat numpy arrays."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts of one round of merges, and words kept by a Python worker before it starts afresh.
BATCH_CHARS, KEPT_WORDS = 500_000, 100_000
#: Split pattern of the byte-level vocabulary (fixed value), and the same for texts without the characters in ODD.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
PLAIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: itself if it prints, else the next code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


#: A text with one of these goes by PATTERN: information separators, the numbers beyond digits of
#: Latin-1, and all code points from the first further one of that kind on.
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u09f4-\U0010ffff]")


class Merger:
    """A vocabulary with sorted pair keys, and the words met so far in flat arrays."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.zeros(256, np.int64)
        for shown, b in symbols.items():
            self.byte_id[b] = vocab[shown]
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rich = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def split(self, text: str) -> list[str]:
        """Pretokens and special tokens, in order."""
        if self.split_special is not None and any(s in text for s in self.special):
            return [w for k, part in enumerate(self.split_special.split(text)) for w in ([part] if k % 2 else self.split_plain(part))]
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        return (self.rich if ODD.search(text) else PLAIN).findall(text)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has.

        One round looks up the keys of all neighbouring symbols by binary search, takes the
        lowest rank in each word and joins every place that has it, from the left where places
        overlap.  A pair that a join makes ranks after the one that made it, so joining all
        places at once gives what joining one after another gives.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        out_sym, out_word, far = [], [], np.iinfo(np.int64).max
        while len(sym):
            same = word[1:] == word[:-1]
            k = sym[:-1] * self.size + sym[1:]
            at = np.searchsorted(self.key, k)
            at[at == len(self.key)] = 0
            rank = np.full(len(sym), far)
            hit = same & (self.key[at] == k) if len(self.key) else np.zeros(len(k), bool)
            rank[:-1][hit] = self.rank[at[hit]]
            first = np.flatnonzero(np.r_[True, ~same])
            low = np.minimum.reduceat(rank, first)
            each = np.repeat(low, np.diff(np.r_[first, len(sym)]))
            done = each == far
            if done.any():  # words without a pair left are complete
                out_sym.append(sym[done])
                out_word.append(word[done])
                go = ~done
                sym, word, rank, each = sym[go], word[go], rank[go], each[go]
                if not len(sym):
                    break
            take = rank == each
            run = take & np.r_[False, take[:-1] & (word[1:] == word[:-1])]
            if run.any():  # aaa: every second place of a run of overlapping ones
                begin = np.maximum.accumulate(np.where(take & ~run, np.arange(len(take)), 0))
                take &= (np.arange(len(take)) - begin) % 2 == 0
            at = np.flatnonzero(take)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not out_sym:
            return np.empty(0, np.uint32), size
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        return sym[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self.index) > KEPT_WORDS:
            self.forget()
        known, new, parts, sizes = self.index, [], [], []
        for t in texts:
            words = self.split(t)
            sizes.append(len(words))
            parts += words
        for w in set(parts).difference(known):
            known[w] = len(self.start) + len(new)
            new.append(w)
        if new:
            plain = [b"" if w in self.special else w.encode("utf-8", "replace") for w in new]
            ids, count = self.merge(plain)
            start = np.r_[0, np.cumsum(count)[:-1]]
            if self.special and any(w in self.special for w in new):
                pieces = np.split(ids, np.cumsum(count)[:-1])
                pieces = [np.array([self.special[w]], np.uint32) if w in self.special else p for w, p in zip(new, pieces)]
                ids, count = np.concatenate(pieces), np.array([len(p) for p in pieces])
                start = np.r_[0, np.cumsum(count)[:-1]]
            self.start = np.r_[self.start, start + len(self.ids)]
            self.ids, self.count = np.r_[self.ids, ids], np.r_[self.count, count]
        at = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        count = self.count[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(self.start[at] - (ends - count), count)] if total else np.empty(0, np.uint32)
        cut = np.r_[0, ends][np.cumsum(sizes)] if len(ends) else np.zeros(len(sizes), np.int64)
        return np.split(flat, cut[:-1]) if len(sizes) else []

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def _texts(column: pa.Array) -> Iterator[list[str]]:
    batch, held = [], 0
    for x in column:
        t = x.as_py() or ""
        batch.append(t)
        held += len(t)
        if held > BATCH_CHARS:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): token ids of every whole text; null and empty texts have none.  Special strings
    inside a text become their special id, as the vocabulary file asks.  Rows stay as they are,
    repeated ones included; further columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            done = 0
            for texts in _texts(b.column(1)):
                ids = m.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(texts)), pa.ListArray.from_arrays(pa.array(ends), values)], ["key", "ids"])
                done += len(texts)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text): ids back to text, special tokens included; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            texts = [m.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): both ways in one pass, ids never leave the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            n, h, d = [], [], []
            for texts in _texts(b.column(1)):
                for ids in m.encode(texts):
                    n.append(len(ids))
                    h.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    d.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())],
                                             ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def with_ids(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and (ids, n_tokens, ids_sha256, decoded_sha256) behind them; columns of these four names are replaced."""
    added = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in added]
    inner = [f"_c{i}" for i in range(len(kept))]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            done = 0
            for texts in _texts(b.column(at)):
                ids = m.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                shas = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], [hashlib.sha256(m.decode(i).encode()).hexdigest() for i in ids]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(texts)) for c in b.columns), lists, pa.array(np.diff(ends).astype(np.int64)), *map(pa.array, shas)], [*inner, *added])
                done += len(texts)

    src = docs.select(*kept).toDF(*inner)
    schema = ", ".join(f"{c} {docs.schema[k].dataType.simpleString()}" for c, k in zip(inner, kept))
    out = src.mapInArrow(run, f"{schema}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.toDF(*kept, *added)
