"""Byte-level BPE as a finite-state transducer that is made deterministic while it reads.

The encoding of a string is the one sequence of tokens that spells it and whose neighbours are
compatible: two tokens are if encoding the bytes of both gives the two again.  (Merges inside a
stretch that no merge crosses are those of the stretch alone, so the first merge over the border
of two tokens would also happen with nothing around them.)  That makes BPE a nondeterministic
transducer: it stands in a trie of all tokens, may leave it wherever a token ends that fits the
one before, and writes that token.  A deterministic state is the set of places where it can
stand, each with its last token; each step says from which place every place of the next state
comes and what is written on the way.  A place dies once no token goes on with the bytes read,
so after a few bytes all places come from one; what was written up to there is certain and is
emitted.  States and steps are made when a text first needs them.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Steps and words that a Python worker keeps before it starts afresh, and characters of a word that is kept at most.
KEPT_STEPS, KEPT_WORDS, KEPT_CHARS = 1_000_000, 400_000, 64
#: Bytes behind which what has become certain is passed on.
LOOKAHEAD = 64
#: Ids that the decoder turns into text at once.
CHUNK_IDS = 256
#: Texts with one of these are split by the full pattern; in all others \s, \w and \d of ``re`` say the same.
BEYOND = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe৴-\U0010ffff]")


def vocabulary_path(name: str) -> str:
    """Place of a vocabulary: a path as it is, a bare file name among the public tokenizers of this machine."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def split_patterns() -> tuple:
    """The public split pattern for ``regex``, with white space as Unicode has it, and for ``re`` on plain texts."""
    import public_tokenizers
    import regex

    given = public_tokenizers.PATTERN
    rich = given.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    short, rest = given.split("| ?", 1)
    letters, numbers, others = f" ?{rest}".split("|", 2)
    given = "|".join([letters, numbers, short, others])  # letters come first: what begins with a quote is no letter or number
    plain = given.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return regex.compile(rich), re.compile(plain)


class Transducer:
    """A vocabulary of ranks as a trie, and the deterministic states found so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token, self.inner = [-1], [True]  # token that ends in a node, and whether longer ones go on
        for token, i in sorted(ranks.items()):
            node = 0
            for b in token:
                self.inner[node] = True
                to = self.child.get(node << 8 | b)
                if to is None:
                    to = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = i
        self.bits = len(self.bytes_of).bit_length()
        self.ids = list(range(len(self.bytes_of)))  # one object for each id
        self.fits: list[dict[int, bool] | None] = [None] * (len(self.bytes_of) + 1)  # by last token + 1
        self.split: dict[int, tuple[int, int] | None] = {}
        self.last: list[bytes] | None = None
        self.forget()

    @classmethod
    def of_file(cls, name: str) -> Transducer:
        with open(vocabulary_path(name), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))})

    def forget(self) -> None:
        #: A state is a tuple of places, two entries each: last token + 1, and node of the trie; one place is at the root.
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.root: list[int] = []  # which place of a state is at the root
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        self.moves: dict[int, tuple] = {}  # the same -> for each place behind it, the place it comes from << bits | token written + 1
        self._state([0, 0])

    def _state(self, places: list[int]) -> int:
        key = tuple(places)
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.state)
            self.state.append(key)
            nodes = key[1::2]
            self.root.append(nodes.index(0) if 0 in nodes else 0)
        return at

    def merged(self, data: bytes) -> list[bytes]:
        """Merges one after another, lowest rank first: what defines the vocabulary, used on one or two tokens only."""
        parts, ranks = [data[i:i + 1] for i in range(len(data))], self.ranks
        self.last = None
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, len(ranks) << 8), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if parts[i] + parts[i + 1] not in ranks:
                break
            self.last = parts[i:i + 2]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one, (token, token) for a byte, None if merging its bytes does not
        make it, or makes it after a merge of a higher rank."""
        known = self.split.get(token, 0)
        if known == 0:
            b = self.bytes_of[token]
            if len(b) == 1:
                known = (token, token)
            elif self.merged(b) != [b]:
                known = None
            else:
                x, y = map(self.ranks.__getitem__, self.last)
                known = (x, y) if self.halves(x) and self.halves(y) and (len(self.bytes_of[x]) == 1 or x < token) and (len(self.bytes_of[y]) == 1 or y < token) else None
            self.split[token] = known
        return known

    def fit(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand behind ``left`` (-1: at the start of a word).

        The merges of both tokens are taken back from the last one on.  What stood on either side of
        the border must not have a merge of its own that came before the one just taken back; a merge
        on the left of the border goes before one of the same rank on it, one on the right after.
        """
        known = self.fits[left + 1]
        if known is None:
            known = self.fits[left + 1] = {}
        if right not in known:
            known[right] = self._fit(left, right)
        return known[right]

    def _fit(self, left: int, right: int) -> bool:
        names, ranks = self.bytes_of, self.ranks
        if left < 0:
            return self.merged(names[right]) == [names[right]]
        if self.halves(left) is None or self.halves(right) is None:
            return self.merged(names[left] + names[right]) == [names[left], names[right]]
        none = limit = len(names)
        split = self.split
        while True:
            if ranks.get(names[left] + names[right], none) < limit:
                return False
            x, y = (split.get(left) or self.halves(left))[1], (split.get(right) or self.halves(right))[0]
            if x == left and y == right:
                return True
            if y == right or (x != left and left > right):
                limit, left = left, x
            else:
                limit, right = right + 1, y

    def _make(self, key: int) -> int:
        """The step of a state and a byte: follow every place."""
        byte, places, moves, inner, token, child, bits = key & 255, [], [], self.inner, self.token, self.child, self.bits
        old = iter(self.state[key >> 8])
        for j, (last, node) in enumerate(zip(old, old)):
            to = child.get(node << 8 | byte)
            if to is not None:
                if inner[to]:
                    places += (last, to)
                    moves.append(j << bits)
                t = token[to]
                if t >= 0:
                    known = self.fits[last]
                    fit = known.get(t) if known else None
                    if self.fit(last - 1, t) if fit is None else fit:
                        places += (t + 1, 0)
                        moves.append(j << bits | t + 1)
        if not places:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        self.moves[key] = tuple(moves)
        to = self.step[key] = self._state(places)
        return to

    def _written(self, keys: list[int], place: int) -> list[int]:
        """What was written over these steps by the way that ends in ``place``."""
        out, moves, bits, ids = [], self.moves, self.bits, self.ids
        mask = (1 << bits) - 1
        for key in reversed(keys):
            move = moves[key][place]
            place = move >> bits
            move &= mask
            if move:
                out.append(ids[move - 1])
        out.reverse()
        return out

    def _settled(self, keys: list[int], state: int) -> tuple[int, int]:
        """How many of these steps are certain, and the place that all ways go through behind them."""
        alive, moves, bits = set(range(len(self.state[state]) // 2)), self.moves, self.bits
        for i in range(len(keys) - 1, 0, -1):
            move = moves[keys[i]]
            alive = {move[j] >> bits for j in alive}
            if len(alive) == 1:
                return i, alive.pop()
        return 0, 0

    def read(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one word that comes in pieces; they are passed on as soon as enough bytes make them certain."""
        state, step, keys, limit = 0, self.step, [], LOOKAHEAD
        for data in chunks:
            for byte in data:
                key = state << 8 | byte
                state = step.get(key)
                if state is None:
                    state = self._make(key)
                keys.append(key)
                if len(keys) > limit:
                    n, place = self._settled(keys, state)
                    if n:
                        yield self._written(keys[:n], place)
                        keys = keys[n:]
                    limit = 2 * len(keys) + LOOKAHEAD
        yield self._written(keys, self.root[state])

    def word(self, data: bytes) -> list[int]:
        """Tokens of one pretoken: itself if the vocabulary has it, else what the transducer writes."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.step) > KEPT_STEPS:
            self.forget()
        if len(data) > LOOKAHEAD:
            return [t for some in self.read((data,)) for t in some]
        state, step, keys = 0, self.step, []
        for byte in data:
            key = state << 8 | byte
            keys.append(key)
            state = step.get(key)
            if state is None:
                state = self._make(key)
        return self._written(keys, self.root[state])


class Words(dict):
    """Tokens of the words met so far; a missing one goes through the transducer.

    Words are kept in two generations: a full one becomes the old one, from which words in use
    come back, so frequent words are never lost."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst, self.old = fst, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.fst.word(word.encode("utf-8", "replace")))
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Splits texts by the public pattern and sends each new word through the transducer."""

    def __init__(self, name: str):
        self.fst = Transducer.of_file(name)
        self.rich, self.plain = split_patterns()
        self.known = Words(self.fst)

    def encode(self, text: str) -> list[int]:
        words = (self.rich if BEYOND.search(text) else self.plain).findall(text)
        return list(chain.from_iterable(map(self.known.__getitem__, words)))


def _utf8_rules() -> dict[tuple[int, int, int], list[tuple[int, int, tuple[int, int, int]]]]:
    """Steps of the UTF-8 machine.  A state says how many bytes are to come and between what the next one lies;
    each step is a range of bytes and the state behind it."""
    tail = [(k, 0x80, 0xBF) for k in range(4)]
    start = (0, 0, 0)
    return {start: [(0x00, 0x7F, start), (0xC2, 0xDF, tail[1]), (0xE0, 0xE0, (2, 0xA0, 0xBF)), (0xE1, 0xEC, tail[2]), (0xED, 0xED, (2, 0x80, 0x9F)),
                    (0xEE, 0xEF, tail[2]), (0xF0, 0xF0, (3, 0x90, 0xBF)), (0xF1, 0xF3, tail[3]), (0xF4, 0xF4, (3, 0x80, 0x8F))],
            **{s: [(s[1], s[2], tail[s[0] - 1] if s[0] > 1 else start)]
               for s in (*tail[1:], (2, 0xA0, 0xBF), (2, 0x80, 0x9F), (3, 0x90, 0xBF), (3, 0x80, 0x8F))}}


class Utf8Machine:
    """Incremental UTF-8: bytes go in as they come, whole characters come out, what is open stays in the state.

    A run of bytes that begins no character becomes one replacement character for each of its
    longest beginnings of a character, as in Python's decoder.
    """

    def __init__(self):
        rules = _utf8_rules()
        names = list(rules)
        self.step = [[-1] * 256 for _ in names]
        for s, steps in rules.items():
            for low, high, to in steps:
                self.step[names.index(s)][low:high + 1] = [names.index(to)] * (high - low + 1)
        self.start = names.index((0, 0, 0))

    def feed(self, state: int, held: bytes, data: bytes) -> tuple[str, int, bytes]:
        """(characters, state, bytes of the open character) after ``data``."""
        out, start = [], self.start
        for b in data:
            to = self.step[state][b]
            if to < 0 and state != start:  # the open character ends here; this byte begins anew
                out.append("�")
                held, state = b"", start
                to = self.step[start][b]
            if to < 0:
                out.append("�")
            elif to == start:
                out.append((held + bytes((b,))).decode("utf-8"))
                held, state = b"", start
            else:
                held, state = held + bytes((b,)), to
        return "".join(out), state, held


class Decoder:
    """The UTF-8 machine lifted to tokens: what a token writes in a state is worked out once."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.machine = bytes_of, Utf8Machine()
        self.memo: dict[bytes, dict[int, tuple[str, int, bytes]]] = {}
        #: What a token writes where no character is open, if it leaves none open.
        self.whole = [t if not held else None for t, _, held in (self.machine.feed(self.machine.start, b"", b) for b in bytes_of)]

    def texts(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text as the ids come; a character that stays open at the end is one replacement character."""
        state, held, ids = self.machine.start, b"", iter(ids)
        while some := list(islice(ids, CHUNK_IDS)):
            if not held:
                whole = list(map(self.whole.__getitem__, some))
                if None not in whole:
                    yield "".join(whole)
                    continue
            out = []
            for i in some:
                memo = self.memo.setdefault(held, {})
                known = memo.get(i)
                if known is None:
                    known = memo[i] = self.machine.feed(state, held, self.bytes_of[i])
                text, state, held = known
                out.append(text)
            yield "".join(out)
        if held:
            yield "�"


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


@lru_cache(maxsize=2)
def decoder(name: str) -> Decoder:
    return Decoder(encoder(name).fst.bytes_of)


def encode(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids of every whole text by the ranks of ``name`` (a file of public tokenizers, or a path).

    Null and empty texts have no ids.  Rows stay as they are, repeated ones included, and a null key is
    kept; further columns are ignored.  A text of any length is read once, byte by byte.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name)
        for b in batches:
            for i, t in enumerate(b.column(1)):
                ids = pa.array([e.encode(t.as_py() or "")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), ids], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids); null and empty ids give an empty text, bytes that are no UTF-8 replacement characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(name)
        for b in batches:
            texts = ["".join(d.texts(x.as_py() or ())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip_digest(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text: both ways in one pass, as in ``encode`` and ``decode``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, d = encoder(name), decoder(name)
        shown = list(map(str, range(len(e.fst.bytes_of))))
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids = e.encode(t.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                h = hashlib.sha256()
                for piece in d.texts(ids):
                    h.update(piece.encode())
                of_text.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                                             ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
