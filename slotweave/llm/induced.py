"""Suffix array of one shard by induced sorting, and its permuted common prefixes.

The order of suffixes is induced linearly from that of the leftmost smaller (LMS) ones: a walk up the array puts the descending (L) suffix in front of
each one at the head of its bucket, a walk down the ascending (S) one at the tail. A stretch of the array up to the first place that it fills itself
is final, so numpy deals it out at once; where stretches are short, as in runs of one symbol, a plain loop goes on.
"""

from __future__ import annotations

from array import array

import numpy as np

#: A stretch of fewer places is left to the plain loop, which then goes on for LOOP of them, for twice as many each time up to REACH.
STRETCH, LOOP, REACH = 128, 256, 1 << 16


def _ascending(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol is the least and unique."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    at = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    up = np.append(s[:-1] < s[1:], True)
    return up[nearest]


def _compact(values: np.ndarray) -> tuple[array, np.ndarray]:
    """Whole numbers as a typed array, which loops read as fast as a list, and a numpy view of it."""
    out = array("h" if values.dtype == np.int16 else "i")
    out.frombytes(values.astype(values.dtype if values.dtype == np.int16 else np.int32).tobytes())
    return out, np.frombuffer(out, out.typecode)


def _before(s: np.ndarray, of_type: np.ndarray, kind: type) -> tuple[array, np.ndarray]:
    """For each suffix the symbol of the one before it, if that is of the type; else -1. One more -1 stands for an empty place (-1)."""
    return _compact(np.concatenate([[-1], np.where(of_type[:-1], s[:-1], -1), [-1]]).astype(kind))


def _deal(order: np.ndarray, place: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Put suffixes, in the order given, into the buckets of their symbols: from the head up (1) or from the tail down (-1)."""
    by = symbols.argsort(kind="stable")
    own = symbols[by]
    first = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
    size, own = np.diff(first, append=len(by)), own[first]
    rank = np.arange(len(by)) - np.repeat(first, size)
    begin = np.repeat(place[own], size)
    order[begin + rank if step > 0 else begin - 1 - rank] = suffixes[by]
    place[own] += step * size


def _walk(order: array, place: array, before: array, views: tuple[np.ndarray, ...], step: int) -> None:
    """Visit all places, up (1) or down (-1), and put the suffix before each one, if ``before`` has its symbol, at its bucket's next place."""
    own, places, symbol = views
    n, done, reach, loop = len(order), 0, 1024, LOOP
    while done < n:
        ahead = min(reach, n - done)
        suffixes = own[done : done + ahead] if step > 0 else own[n - done - ahead : n - done][::-1]
        symbols = symbol[suffixes]
        at = np.flatnonzero(symbols >= 0)
        symbols = symbols[at]
        final = ahead
        if len(at):  # all of them stand further on; what stands before the nearest is not filled any more
            final = min(ahead, (int(places[symbols].min()) if step > 0 else n - int(places[symbols].max())) - done)
        if final < min(STRETCH, ahead):
            until = min(done + loop, n)
            if step > 0:
                for k in range(done, until):
                    i = order[k]
                    c = before[i]
                    if c >= 0:
                        to = place[c]
                        order[to] = i - 1
                        place[c] = to + 1
            else:
                for k in range(n - done - 1, n - until - 1, -1):
                    i = order[k]
                    c = before[i]
                    if c >= 0:
                        place[c] = to = place[c] - 1
                        order[to] = i - 1
            done, reach, loop = until, 1024, min(2 * loop, REACH)
            continue
        if final < ahead:
            k = int(np.searchsorted(at, final))
            at, symbols = at[:k], symbols[:k]
        if len(at):
            _deal(own, places, symbols, suffixes[at] - 1, step)
        done, reach, loop = done + final, min(max(2 * final, 1024), REACH), LOOP


def _induce(s: np.ndarray, up: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix array from the given order of LMS suffixes. ``bounds`` has the begin of each symbol's bucket, and the end of the last one."""
    kind = np.int16 if len(bounds) < 1 << 15 else np.int32  # short numbers are sorted by counting
    order, own = _compact(np.full(len(s), -1))
    last = lms[::-1]
    _deal(own, bounds[1:].copy(), s[last].astype(kind), last, -1)
    for bucket, of_type, step in ((bounds[:-1], ~up, 1), (bounds[1:], up, -1)):
        place, places = _compact(bucket)
        before, symbol = _before(s, of_type, kind)
        _walk(order, place, before, (own, places, symbol), step)
    return own.astype(np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of a sequence of small non-negative integers whose last one is the least and occurs once."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1]
    up = _ascending(s)
    counts = np.bincount(s)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    is_lms = up.copy()
    is_lms[0] = False
    is_lms[1:] &= ~up[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) < 2:
        return _induce(s, up, lms, bounds)
    first = _induce(s, up, lms, bounds)
    order = first[is_lms[first]]  # by LMS substring
    ends = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = ends - lms
    a, b = order[:-1], order[1:]
    differs = length[a] != length[b]
    left = np.flatnonzero(~differs)
    k = 0
    while len(left):
        unequal = s[a[left] + k] != s[b[left] + k]
        differs[left[unequal]] = True
        left = left[~unequal]
        k += 1
        left = left[length[a[left]] >= k]
    names = np.concatenate([[0], np.cumsum(differs)])
    if names[-1] + 1 == len(lms):
        return _induce(s, up, order, bounds)
    name = np.empty(n, np.int64)
    name[order] = names
    return _induce(s, up, lms[suffix_array(name[lms])], bounds)


def common_prefixes(s: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order, the suffix before it in the array (-1: none) and the length they share.

    Only irreducible lengths are compared symbol by symbol; the others are one less than their left neighbour's.
    """
    n = len(s)
    before = np.full(n, -1)
    before[suffixes[1:]] = suffixes[:-1]
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (before[1:] == before[:-1] + 1)
    reducible[1:] &= s[np.maximum(before[1:] - 1, 0)] == s[:-1]
    first = np.flatnonzero(~reducible)
    shared = np.zeros(n, np.int64)
    left, k = first[before[first] >= 0], 0
    while len(left):
        left = left[(left + k < n) & (before[left] + k < n)]
        left = left[s[left + k] == s[before[left] + k]]
        k += 1
        shared[left] = k
    source = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    return before, np.maximum(shared[source] - (np.arange(n) - source), 0)
