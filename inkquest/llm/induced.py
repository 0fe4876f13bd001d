"""Suffix arrays by induced sorting, and common prefixes in text order.

Suffixes are smaller (S) or larger (L) than their right neighbour; a leftmost-smaller (LMS)
position is an S behind an L.  LMS substrings are sorted by one round of inducing, named, and
the string of names is sorted level by level; a second round induces all suffixes.  Over bytes a
round works bucket by bucket on whole arrays, which keeps the order of the scan because what a
bucket induces lands in later buckets or behind itself.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end counts as smallest."""
    n = len(t)
    less = np.zeros(n, bool)
    if n > 1:
        less[:-1] = t[:-1] < t[1:]
        change = np.flatnonzero(np.r_[t[:-1] != t[1:], True])
        less = np.repeat(less[change], np.diff(np.r_[-1, change]))
    return less


def _push(lists: list[list[np.ndarray]], at: np.ndarray, sym: np.ndarray) -> None:
    """Append positions to the lists of their symbols, in order."""
    if not len(at):
        return
    order = np.argsort(sym, kind="stable")
    at, sym = at[order], sym[order]
    cut = np.flatnonzero(sym[1:] != sym[:-1]) + 1
    for s, part in zip(sym[np.r_[0, cut]].tolist(), np.split(at, cut)):
        lists[s].append(part)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order from the order of LMS positions (exact if theirs is, else by LMS substring)."""
    none = np.empty(0, np.int64)
    starts: list[list[np.ndarray]] = [[] for _ in range(256)]
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    _push(starts, lms, t[lms])
    large[int(t[-1])].append(np.array([len(t) - 1]))
    l_part = [none] * 256
    for c in range(256):
        waves, cur = [], np.concatenate(large[c]) if large[c] else none
        while len(cur):
            waves.append(cur)
            j = cur[cur > 0] - 1
            j = j[~small[j]]
            sym = t[j]
            here = sym == c
            _push(large, j[~here], sym[~here])
            cur = j[here]
        if waves:
            l_part[c] = np.concatenate(waves)
        if starts[c]:
            j = np.concatenate(starts[c]) - 1
            _push(large, j, t[j])
    less: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(255, -1, -1):
        waves, cur = [], np.concatenate(less[c]) if less[c] else none
        while len(cur):
            waves.append(cur)
            j = cur[cur > 0] - 1
            j = j[small[j]]
            sym = t[j]
            here = sym == c
            _push(less, j[~here], sym[~here])
            cur = j[here]
        j = l_part[c][::-1]
        out += [np.concatenate(waves) if waves else none, j]
        j = j[j > 0] - 1
        j = j[small[j]]
        _push(less, j, t[j])
    return np.concatenate(out)[::-1]


def words_at(t: np.ndarray) -> np.ndarray:
    """Eight bytes from every position as one number that orders like them, zeros behind the end."""
    padded = np.r_[t, np.zeros(8, np.uint8)]
    w = np.zeros(len(t), np.uint64)
    for k in range(8):
        w = (w << np.uint64(8)) | padded[k:k + len(t)]
    return w


def common_prefix(word: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common bytes at pairs of positions, counted up to ``most``; both must have that many bytes, or end differently."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for step in range(0, most, 8):
        x, y = a[live] + step, b[live] + step
        inside = (x < len(word)) & (y < len(word))
        live, x, y = live[inside], x[inside], y[inside]
        diff = word[x] ^ word[y]
        same = diff == 0
        part = diff[~same]
        zero = np.zeros(len(part), np.int64)
        for k in range(7):
            zero += (part >> np.uint64(56 - 8 * k)) == 0
        out[live[~same]] = step + zero
        out[live[same]] = step + 8
        live = live[same]
    return np.minimum(out, most)


def _names(t: np.ndarray, order: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring in ``order``; equal ones share it."""
    a, b = order[:-1], order[1:]
    n = size[a]
    same = n == size[b]
    at = np.flatnonzero(same)
    step = 0
    while len(at):
        left = n[at] - step
        shift = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        eq = (word[a[at] + step] ^ word[b[at] + step]) >> shift == 0
        same[at[~eq]] = False
        at = at[eq & (left > 8)]
        step += 8
    return np.r_[0, np.cumsum(~same)]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of a byte array in the order of their suffixes."""
    if len(t) < 2:
        return np.arange(len(t))
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        sa = _induce(t, small, lms)
        order = sa[is_lms[sa]]
        size = np.zeros(len(t), np.int64)
        size[lms] = np.r_[np.diff(lms) + 1, len(t) - lms[-1]]
        rank = _names(t, order, size, words_at(t))
        # The last LMS substring runs to the end, so it equals no other even if its bytes do.
        last = np.flatnonzero(order == lms[-1])[0]
        rank = rank + np.r_[0, np.cumsum((np.arange(1, len(rank)) == last) & (np.diff(rank) == 0) | (np.arange(1, len(rank)) == last + 1) & (np.diff(rank) == 0))]
        name = np.empty(len(t), np.int64)
        name[order] = rank
        reduced = name[lms]
        if rank[-1] + 1 < len(lms):
            lms = lms[_reduced_array(reduced, int(rank[-1]) + 1)]
        else:
            lms = order
    return _induce(t, small, lms)


def _reduced_array(names: np.ndarray, k: int) -> np.ndarray:
    """Positions of a string of names below ``k`` in the order of their suffixes.

    Each level names pairs of blocks of the level below, over the suffixes that still tie: a
    rank is the place of the first suffix of its group, so a suffix alone has its final place.
    (Inducing over so large an alphabet is one scalar step per name and took most of the time.)
    """
    n = len(names)
    rank = np.r_[0, np.cumsum(np.bincount(names, minlength=k))][names]
    live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    h = 1
    while len(live):
        after = np.zeros(len(live), np.int64)
        inside = live + h < n
        after[inside] = rank[live[inside] + h] + 1
        key = rank[live] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        old = rank[live]
        spot = np.arange(len(live))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], spot, 0))
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], spot, 0))
        rank[live] = old + first - group
        same = key[1:] == key[:-1]
        live = live[np.r_[False, same] | np.r_[same, False]]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out
