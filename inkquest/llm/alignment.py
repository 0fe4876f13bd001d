"""Two tokenizers of one text are aligned byte by byte, many documents in lockstep.

A is a byte-level BPE (``tokenizers``) and reads a blank and the text, B is a piece vocabulary
(``sentencepiece``), which puts that blank itself.  A document whose tokens spell exactly these
bytes on both sides is a pair of tilings of one byte range.  One state vector holds a pointer
into A and one into B for every lane; each step links the two tokens that all lanes point at,
cuts where both end and moves on whichever ends first.  Finished lanes are compacted away.
A long document is several lanes: they begin at A tokens, where the B token over the same byte
is found by binary search, so the number of steps does not grow with a document.
No token of either side reaches over a blank between a word and a letter, so what stands
between two such blanks is encoded once by a worker and then looked up.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .bpe import byte_symbols
from .transducer import vocabulary_path

#: Texts aligned at once (characters, and at most as many texts), A tokens of a lane, and characters from which a text is encoded in parts.
BATCH_CHARS, BATCH_TEXTS, LANE, PART_CHARS = 1_000_000, 4_000, 256, 200_000
#: Id pairs with at least this share of all links are looked up in the task (at most 1 / HEAD_SHARE
#: of them exist, 16 bytes each); all others by a join, which for that reason has no hot key.
HEAD_SHARE = 2e-6
#: Sums of id pairs that a task holds before it passes them on.
HELD_PAIRS = 2_000_000
#: Stretches between borders, and tokens of them, from which on a worker forgets all it has encoded but the half most in use.
KEPT_WORDS, KEPT_TOKENS = 300_000, 3_000_000
#: A blank between a character that is none and a letter: no token of either side reaches over its left edge.
BORDER = re.compile(r"(?<=\S) (?=[^\W\d_])")


class Vocabularies:
    """Both tokenizers, and what each of their ids spells."""

    def __init__(self, a_name: str, b_name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks of all cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary_path(a_name))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b_name))
        symbols = byte_symbols()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(symbols[c] for c in t) if (t := self.a.id_to_token(i)) is not None and all(c in symbols for c in t) else b"" for i in range(size)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        #: Whether pieces have blanks in front only, so that no merge of B reaches over a BORDER.
        self.parts = not any(" " in t.decode("utf-8", "replace").lstrip(" ") for t in self.b_bytes)
        self.code_type = "int" if size * len(self.b_bytes) < 2 ** 31 else "long"

    def split(self, text: str) -> list[str]:
        """The text in parts that both sides encode as they encode the whole; the blank of each border is left out,
        as both sides put it in front of a part again."""
        out, at = [], 0
        while self.parts and len(text) - at > PART_CHARS:
            m = BORDER.search(text, at + PART_CHARS)
            if m is None:
                break
            out.append(text[at:m.start()])
            at = m.end()
        return [*out, text[at:]]

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B for every text; none where null, empty, or spelled otherwise than blank and text."""
        parts = [self.split(t) if t else [] for t in texts]
        flat = [p for some in parts for p in some]
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in flat], add_special_tokens=False)]
        b = self.b.encode(flat, out_type=int, num_threads=1) if flat else []
        out, at = [], 0
        for t, some in zip(texts, parts):
            x, y = ([i for x in side[at:at + len(some)] for i in x] if len(some) != 1 else side[at] for side in (a, b))
            at += len(some)
            out.append((x, y) if self.spell(t or "", x, y) else ([], []))
        return out

    def spell(self, text: str, a, b) -> bool:
        """Whether the tokens of both sides spell a blank and the text."""
        want = (" " + text).encode("utf-8", "replace")
        return all(b"".join(map(names.__getitem__, x)) == want for names, x in ((self.a_bytes, a), (self.b_bytes, b)))


class Words:
    """Ids of the stretches between borders, mostly words, each of which a worker encodes once."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.number: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.stop = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.same, self.uses = np.empty(0, bool), np.empty(0, np.int64)

    def forget(self) -> None:
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:len(self.number) // 2])
        words = list(self.number)
        self.number = {words[i]: k for k, i in enumerate(keep.tolist())}
        for k in (0, 1):
            size = np.diff(self.stop[k])
            kept = np.zeros(len(size), bool)
            kept[keep] = True
            self.flat[k] = self.flat[k][np.repeat(kept, size)]
            self.stop[k] = np.r_[0, np.cumsum(size[keep])]
        self.same, self.uses = self.same[keep], self.uses[keep] // 2

    def learn(self, words: list[str]) -> None:
        a = [e.ids for e in self.v.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        b = self.v.b.encode(words, out_type=int, num_threads=1)
        want = [(" " + w).encode("utf-8", "replace") for w in words]
        length, same = np.fromiter(map(len, want), np.int64, len(want)), np.ones(len(words), bool)
        for k, (ids, names) in enumerate(((a, self.v.a_bytes), (b, self.v.b_bytes))):
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            stop = np.cumsum(size)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
            end = np.r_[0, np.cumsum((self.v.a_size, self.v.b_size)[k][flat])]
            if not np.array_equal(end[stop] - end[stop - size], length) or b"".join(map(names.__getitem__, flat.tolist())) != b"".join(want):
                same &= np.fromiter((b"".join(map(names.__getitem__, x)) == w for x, w in zip(ids, want)), bool, len(want))
            self.flat[k] = np.concatenate([self.flat[k], flat])
            self.stop[k] = np.concatenate([self.stop[k], self.stop[k][-1] + stop])
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.same, self.uses = np.concatenate([self.same, same]), np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all texts, one behind the other, and how many each text has; none as ``tokens`` says."""
        while len(self.number) > KEPT_WORDS or max(map(len, self.flat)) > KEPT_TOKENS:
            self.forget()
        parts = [(BORDER.split(t) if self.v.parts else [t]) if t else [] for t in texts]
        words = [p for some in parts for p in some]
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.uses += np.bincount(at, minlength=len(self.uses))
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        out = []
        for flat, stop in zip(self.flat, self.stop):
            size = stop[at + 1] - stop[at]
            ids = flat[np.repeat(stop[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))].astype(np.int64)
            out.append((ids, np.bincount(doc, size, len(texts)).astype(np.int64)))
        (a, a_count), (b, b_count) = out
        # a stretch spelled otherwise all but settles its text
        a_stop, b_stop = np.cumsum(a_count), np.cumsum(b_count)
        drop = np.zeros(len(texts), bool)
        for i in np.unique(doc[~self.same[at]]).tolist():
            drop[i] = not self.v.spell(texts[i], a[a_stop[i] - a_count[i]:a_stop[i]].tolist(), b[b_stop[i] - b_count[i]:b_stop[i]].tolist())
        if drop.any():
            a, b = a[~np.repeat(drop, a_count)], b[~np.repeat(drop, b_count)]
            a_count, b_count = np.where(drop, 0, a_count), np.where(drop, 0, b_count)
        return a, b, a_count, b_count


@lru_cache(maxsize=1)
def vocabularies(a_name: str, b_name: str) -> Vocabularies:
    return Vocabularies(a_name, b_name)


@lru_cache(maxsize=1)
def encoded_words(a_name: str, b_name: str) -> Words:
    return Words(vocabularies(a_name, b_name))


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_count: np.ndarray, b_count: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) and cuts (a, b), as places in the two flat arrays of ends, each in order.

    ``a_count`` and ``b_count`` say how many tokens each document has; its ends count from its
    own first byte and both sides end at the same byte.  Documents without tokens have no link.
    """
    a_stop, b_stop = np.cumsum(a_count), np.cumsum(b_count)
    total = np.array([a_end[s - 1] if n else 0 for s, n in zip(a_stop.tolist(), a_count.tolist())], np.int64)
    base = np.cumsum(total) - total
    ga = a_end + np.repeat(base, a_count)  # ends in the bytes of all documents, one behind the other
    gb = b_end + np.repeat(base, b_count)
    lanes = -(-a_count // lane)
    doc = np.repeat(np.arange(len(a_count)), lanes)
    first = (a_stop - a_count)[doc] + lane * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    if not len(first):
        none = np.empty(0, np.int64)
        return none, none, none, none
    starts = np.where(first > 0, ga[first - 1], 0)  # all documents are tiled, so the end before is the start
    ia, ib = first.copy(), np.searchsorted(gb, starts, "right")
    until = np.minimum(first + lane, a_stop[doc])  # a lane makes the links of its own A tokens
    number = np.arange(len(first))
    link_a, link_b, link_lane, cuts = [], [], [], []
    while len(ia):
        link_a.append(ia)
        link_b.append(ib)
        link_lane.append(number)
        ea, eb = ga[ia], gb[ib]
        cuts.append(ea == eb)
        ia, ib = ia + (ea <= eb), ib + (eb <= ea)
        on = ia < until
        if not on.all():
            ia, ib, until, number = ia[on], ib[on], until[on], number[on]
    a, b, cut = np.concatenate(link_a), np.concatenate(link_b), np.concatenate(cuts)
    order = np.argsort(np.concatenate(link_lane), kind="stable")
    a, b, cut = a[order], b[order], cut[order]
    return a, b, a[cut], b[cut]


def _digits(size: int) -> np.ndarray:
    """Decimal digits of all ids, right-aligned, zero bytes in front, a last column for what stands behind."""
    width = len(str(max(size - 1, 0)))
    ids = np.arange(size)
    out = np.zeros((size, width + 1), np.uint8)
    for k in range(width):
        shown = (ids >= 10 ** k) | (k == 0)
        out[shown, width - 1 - k] = 48 + ids[shown] // 10 ** k % 10
    return out


class Aligner:
    """Aligns batches of texts."""

    def __init__(self, a_name: str, b_name: str):
        self.v = vocabularies(a_name, b_name)
        self.words = encoded_words(a_name, b_name)
        self.a_digits, self.b_digits = _digits(len(self.v.a_bytes)), _digits(len(self.v.b_bytes))
        width = max(self.a_digits.shape[1], self.b_digits.shape[1])
        self.a_digits = np.pad(self.a_digits, ((0, 0), (width - self.a_digits.shape[1], 0)))
        self.b_digits = np.pad(self.b_digits, ((0, 0), (width - self.b_digits.shape[1], 0)))

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        v = self.v
        a, b, a_count, b_count = self.words.encode(texts)
        a_stop, b_stop = np.cumsum(a_count), np.cumsum(b_count)

        def ends(size, stop, count):
            e = np.cumsum(size)
            return e - np.repeat(np.r_[0, e][stop - count], count)

        la, lb, ca, cb = lockstep(ends(v.a_size[a], a_stop, a_count), ends(v.b_size[b], b_stop, b_count), a_count, b_count)
        return {"a": a, "b": b, "a_count": a_count, "b_count": b_count, "link_a": la, "link_b": lb, "cut_a": ca, "cut_b": cb,
                "link_doc": np.searchsorted(a_stop, la, "right"), "cut_doc": np.searchsorted(a_stop, ca, "right")}

    def group_text(self, x: dict[str, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """All groups written out, and where each document's part ends; every group ends in a semicolon."""
        a, b = x["a"], x["b"]
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[x["cut_a"]], b_last[x["cut_b"]] = True, True
        group = np.r_[np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last]
        order = np.argsort(2 * group + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        rows = np.concatenate([self.a_digits[a], self.b_digits[b]])
        rows[:, -1] = np.r_[np.where(a_last, 124, 44), np.where(b_last, 59, 44)]  # | , ; ,
        rows = rows[order]
        size = (rows != 0).sum(1)
        flat = rows.ravel()
        stop = np.cumsum(x["a_count"] + x["b_count"])
        return flat[flat != 0].tobytes(), np.r_[0, np.cumsum(size)][stop]


def _batches(column: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for t in column:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > BATCH_CHARS or len(held) >= BATCH_TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def align(docs: DataFrame, a_name: str, b_name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a_ids, b_ids, links, cuts): both encodings of every whole text, its links (places in a_ids and b_ids whose
    bytes overlap, in order) and its cuts (how many tokens of A and of B come before each common border).

    Texts that are null, empty or spelled otherwise by either side have empty arrays.  Repeated rows
    and null keys are kept, further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_name, b_name)

        def lists(values, stop):
            return pa.ListArray.from_arrays(pa.array(np.r_[0, stop].astype(np.int32)), values)

        def pairs(p, q, where, x):
            a0, b0 = (np.cumsum(x["a_count"]) - x["a_count"])[where], (np.cumsum(x["b_count"]) - x["b_count"])[where]
            both = pa.StructArray.from_arrays([pa.array((p - a0).astype(np.int32)), pa.array((q - b0).astype(np.int32))], ["a", "b"])
            return lists(both, np.searchsorted(where, np.arange(len(x["a_count"])), "right"))

        for batch in batches:
            done = 0
            for texts in _batches(batch.column(1)):
                x = aligner.align(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(texts)), lists(pa.array(x["a"].astype(np.int32)), np.cumsum(x["a_count"])),
                     lists(pa.array(x["b"].astype(np.int32)), np.cumsum(x["b_count"])), pairs(x["link_a"], x["link_b"], x["link_doc"], x),
                     pairs(x["cut_a"] + 1, x["cut_b"] + 1, x["cut_doc"], x)], ["key", "a_ids", "b_ids", "links", "cuts"])
                done += len(texts)

    kind = docs.schema[key].dataType.simpleString()
    both = "array<struct<a:int,b:int>>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(
        run, f"key {kind}, a_ids array<int>, b_ids array<int>, links {both}, cuts {both}").withColumnRenamed("key", key)


# ---------------------------------------------------------------- counts over the corpus


def _summaries(a_name: str, b_name: str, code_type: str):
    """One row for each document with its distinct id pairs, and rows without an id for the sums of a task."""
    pa_code = pa.int32() if code_type == "int" else pa.int64()
    names = ["rid", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "code", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_name, b_name)
        width, held, kind = len(aligner.v.b_bytes), [], None

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def sums() -> pa.RecordBatch:
            codes, n = merged()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array(v.astype(np.int64)).cast(t)) for v, t in ((codes, pa_code), (n, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *lists], names)

        for batch in batches:
            done, kind = 0, batch.column(1).type
            for texts in _batches(batch.column(2)):
                x, d = aligner.align(texts), len(texts)
                code = x["a"][x["link_a"]] * width + x["b"][x["link_b"]]
                span = len(aligner.v.a_bytes) * width
                mine, n = np.unique(x["link_doc"] * span + code, return_counts=True)
                ends = np.r_[0, np.searchsorted(mine, span * np.arange(1, d + 1))].astype(np.int32)
                text, stop = aligner.group_text(x)
                view, shas = memoryview(text), []
                for begin, end in zip(np.r_[0, stop[:-1]].tolist(), stop.tolist()):
                    shas.append(hashlib.sha256(view[begin:end - 1]).hexdigest() if end > begin else "")
                rows = slice(done, done + d)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array(x["a_count"]), pa.array(x["b_count"]), pa.array(np.bincount(x["cut_doc"], minlength=d)),
                     pa.array(np.bincount(x["link_doc"], minlength=d)), pa.array(shas, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(mine % span).cast(pa_code)), pa.ListArray.from_arrays(pa.array(ends), pa.array(n))], names)
                done += d
                held.append((mine % span, n))
                if sum(len(c) for c, _ in held) > HELD_PAIRS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield sums()
                        held = []
        if held:
            yield sums()

    return run


def _look_up(head, known_type: pa.DataType):
    """Sums over the links whose pair is in the table of the task; the pairs of all others are passed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count, best = head.value
        for batch in batches:
            lists = [batch.column(k) for k in (1, 2)]
            d, size = batch.num_rows, lists[0].value_lengths().to_numpy(zero_copy_only=False)
            code, n = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            doc = np.repeat(np.arange(d), size)
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            value = np.where(hit, count[at], 0) * n if len(codes) else np.zeros(len(code), np.int64)
            is_best = np.where(hit, best[at], False) * n if len(codes) else value
            sums, bests = np.zeros(d, np.int64), np.zeros(d, np.int64)
            np.add.at(sums, doc, value)
            np.add.at(bests, doc, is_best)
            ends = np.r_[0, np.cumsum(np.bincount(doc[~hit], minlength=d))].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[~hit])) for v in (code, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bests), pa.array(sums), *rest], ["rid", "best", "sum", "code", "n"])

    return run


def pair_counts(parts: DataFrame, width: int) -> DataFrame:
    """(code, n, best): links of every id pair over the corpus, and whether no pair of its B id has more."""
    n = parts.where("rid IS NULL").select(F.explode(F.arrays_zip("code", "n")).alias("p")).groupBy(F.col("p.code").alias("code")).agg(F.sum("p.n").alias("n"))
    most = n.groupBy((F.col("code") % width).alias("b")).agg(F.max("n").alias("most"))
    return n.withColumn("b", F.col("code") % width).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def report(docs: DataFrame, a_name: str, b_name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    n_best counts the links whose id pair is as frequent in the corpus as any with its B id;
    count_sum adds the corpus count of the pair over all links.  Texts without tokens (null,
    empty, or spelled otherwise by a side) have zeros and an empty digest.  Repeated rows count
    and are returned each, null keys are kept, an empty table gives an empty result and further
    columns are ignored.  Texts are encoded once; only id pairs and their counts are shuffled.
    """
    spark = docs.sparkSession
    v = vocabularies(a_name, b_name)
    width, code_type = len(v.b_bytes), v.code_type
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("t"))
    parts = staged(src.mapInArrow(_summaries(a_name, b_name, code_type), f"rid long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                                                         f"code array<{code_type}>, n array<long>"), "alignments")
    counts = staged(pair_counts(parts, width), "pairs")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.where(F.col("n") >= HEAD_SHARE * total).orderBy("code").toArrow()  # at most 1 / HEAD_SHARE rows
    head = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("code", "n", "best")))
    rows = parts.where("rid IS NOT NULL")
    seen = staged(rows.select("rid", "code", "n").mapInArrow(_look_up(head, None), f"rid long, best long, sum long, code array<{code_type}>, n array<long>"), "lookups")
    rest = seen.where(F.size("code") > 0).select("rid", F.explode(F.arrays_zip("code", "n")).alias("p")).select("rid", F.col("p.code").alias("code"), F.col("p.n").alias("k"))
    rest = rest.join(counts, "code").groupBy("rid").agg(F.sum(F.col("k") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"))
    zero = F.lit(0).cast("long")
    return rows.drop("code", "n").join(seen.select("rid", "best", "sum"), "rid").join(rest, "rid", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("sum") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256")
