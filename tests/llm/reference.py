"""Plain versions of the operators over Python lists, to test against."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def fingerprint(text, size=3):
    w = words(text)
    if not w:
        return 0
    k = min(size, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def shingles(text, size):
    w = words(text)
    k = min(size, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(ids, linked):
    """Smallest id of each one's component; ``linked`` says whether two places link."""
    low = list(ids)
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(a):
                if low[a] != low[b] and linked(a, b):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return low


def repeats(rows, least=50):
    """Per row: which bytes go."""
    low = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - least + 1):
            g = b[p:p + least]
            low[g] = min(i, low.get(g, i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if low[b[p:p + least]] < i:
                gone[p:p + least] = b"\1" * least
        out.append((b, gone))
    return out


def repeat_digest(rows, least=50):
    out = []
    for b, gone in repeats(rows, least):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def without_repeats(rows, least=50):
    """Texts without the characters of which all bytes go."""
    out = []
    for (i, t), (b, gone) in zip(rows, repeats(rows, least)):
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at:at + n]):
                kept.append(c)
            at += n
        out.append(None if t is None else "".join(kept))
    return out


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(items):
    found = {}
    for i, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            found.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    return found


def bench_hits(text, found):
    w = BENCH_WORD.findall((text or "").translate(LOWER))
    hit, items = [False] * len(w), set()
    for size in {len(k) for k in found}:
        for k in range(len(w) - size + 1):
            named = found.get(tuple(w[k:k + size]))
            if named:
                items |= named
                hit[k:k + size] = [True] * size
    return w, hit, items


def bench_clean(text, found, most=0.5):
    """The cleaned text, or False if the document goes."""
    w, hit, _ = bench_hits(text, found)
    if not any(hit):
        return text
    if sum(hit) > most * len(hit):
        return False
    spans = [m.span() for m in BENCH_WORD.finditer(text.translate(LOWER))]
    out, at, k = [], 0, 0
    while k < len(w):
        if hit[k]:
            e = k
            while e + 1 < len(w) and hit[e + 1]:
                e += 1
            out.append(text[at:spans[k][0]])
            at, k = spans[e][1], e
        k += 1
    return "".join(out) + text[at:]


def unigram(rows, held):
    """train_tokens and (n_tokens, n_known, base score) per row."""
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words(t), "\n"])
    n = sum(c.values())
    whole = n + len(c) + 1
    return n, [(len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), "\n"]), sum(log10((c[w] + 1) / whole) for w in [*words(t), "\n"])) for _, t in rows]


def fold_is(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold
