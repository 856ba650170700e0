"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS)
substrings, recurses on their names where these repeat, and induces the whole
array from the sorted LMS suffixes. The induction goes bucket by bucket in
numpy, which needs many suffixes a bucket; a recursion whose names are too many
for that ranks its suffixes by doubling instead (going on suffix by suffix gives
the same array, and was measured to take four times as long for a shard of text).
"""

from __future__ import annotations

import numpy as np

DENSE = 64                   # suffixes per symbol from which on a recursion induces bucket by bucket


def smaller_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol is
    a unique smallest one."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)                # the next place where neighbours differ decides
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(at, n - 2)] > 0
    return out


def _deal(out: np.ndarray, edge: np.ndarray, symbols: np.ndarray, items: np.ndarray, up: bool) -> None:
    """Put items behind (or before) the edge of their symbol's bucket, in order."""
    if not len(items):
        return
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    rank = np.arange(len(s)) - np.repeat(first, size)
    if up:
        out[edge[s] + rank] = items[order]
        edge[s[first]] += size
    else:
        out[edge[s] - 1 - rank] = items[order]
        edge[s[first]] -= size


def _induce_buckets(t, small, seeds, heads, tails):
    n, sigma = len(t), len(heads)
    sa = np.full(n, -1, np.int64)
    edge = heads.copy()
    sym = t[seeds]
    first = np.searchsorted(sym, np.arange(sigma + 1))
    for c in range(sigma):
        lo = heads[c]
        while True:                                              # a bucket's larger suffixes, also those it adds to itself
            hi = edge[c]
            if lo == hi:
                break
            p = sa[lo:hi] - 1
            p = p[p >= 0]
            p = p[~small[p]]
            lo = hi
            _deal(sa, edge, t[p], p, True)
        p = seeds[first[c]:first[c + 1]] - 1
        p = p[p >= 0]
        p = p[~small[p]]
        _deal(sa, edge, t[p], p, True)
    end_of_large = edge
    edge = tails.copy()
    for c in range(sigma - 1, -1, -1):
        hi = tails[c]
        while True:
            lo = edge[c]
            if lo == hi:
                break
            p = sa[lo:hi][::-1] - 1
            p = p[p >= 0]
            p = p[small[p]]
            hi = lo
            _deal(sa, edge, t[p], p, False)
        p = sa[heads[c]:end_of_large[c]][::-1] - 1
        p = p[p >= 0]
        p = p[small[p]]
        _deal(sa, edge, t[p], p, False)
    sa[0] = n - 1
    return sa


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text with many symbols: ranks by 1, 2, 4, ...
    symbols until all differ."""
    n, rank, reach = len(t), t, 1
    bits = max(1, int(n).bit_length())
    while True:
        after = np.zeros(n, np.int64)
        after[:n - reach] = rank[reach:] + 1
        if 3 * bits + 1 <= 63:                                   # key and place in one number: a plain sort does
            key = np.sort((rank << (2 * bits + 1)) | (after << bits) | np.arange(n))
            order, key = key & ((1 << bits) - 1), key >> bits
        else:
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if new[-1] == n - 1 or reach >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        reach *= 2


def _induce(t, small, seeds, sigma):
    """All suffixes in order, given the LMS suffixes ``seeds`` in order (if
    these are sorted by first symbol only, LMS substrings come out in order)."""
    size = np.bincount(t, minlength=sigma)
    tails = np.cumsum(size)
    heads = tails - size
    return _induce_buckets(t, small, seeds, heads, tails)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of symbols 0 to sigma - 1, of which 0 occurs at the end and
    only there."""
    t = t.astype(np.int64)
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = smaller_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, lms[np.argsort(t[lms], kind="stable")], sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = sa[is_lms[sa]]
    names = _names(t, lms, by_substring)
    reduced = np.empty(n, np.int64)
    reduced[by_substring] = names
    reduced = reduced[lms]
    if names[-1] + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        kinds = int(names[-1]) + 1
        order = suffix_array(reduced, kinds) if len(lms) >= DENSE * kinds else _by_doubling(reduced)
    return _induce(t, small, lms[order], sigma)


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the sorted LMS substrings; equal ones have the same."""
    following = np.empty(len(t), np.int64)
    following[lms] = np.append(lms[1:], lms[-1])
    size = following[order] - order + 1
    same = size[1:] == size[:-1]
    a, b, k = order[:-1][same], order[1:][same], size[1:][same]
    if len(a):
        at = np.cumsum(k) - k
        step = np.arange(int(k.sum())) - np.repeat(at, k)
        equal = t[np.repeat(a, k) + step] == t[np.repeat(b, k) + step]
        same[same] = np.logical_and.reduceat(equal, at)
    return np.concatenate([[0], np.cumsum(~same)])


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each text position the length of its suffix's common prefix with the
    suffix before it in order. Where the symbols before both agree, it is one
    less than that of the position before; the rest are compared, eight
    symbols at a time (``t`` holds bytes and ends in a unique one)."""
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = n
    padded = np.concatenate([t.astype(np.uint64), np.zeros(16, np.uint64)])
    eight = padded[:n + 8].copy()
    for k in range(1, 8):
        eight |= padded[k:n + 8 + k] << np.uint64(8 * k)
    before = np.concatenate([[256], t.astype(np.int64)])         # before[i] stands in front of position i
    other = before[np.minimum(phi, n)]
    starts = np.flatnonzero((before[:n] != other) | (phi == n) | (phi == 0) | (np.arange(n) == 0))
    length = np.zeros(n, np.int64)
    active = starts[phi[starts] < n]
    done = np.zeros(len(active), np.int64)
    while len(active):
        x = eight[np.minimum(active + done, n + 7)] ^ eight[np.minimum(phi[active] + done, n + 7)]
        low = x & (~x + np.uint64(1))
        first = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        done += first
        length[active] = done
        go = (x == 0) & (np.maximum(active, phi[active]) + done < n)
        active, done = active[go], done[go]
    last = np.zeros(n, np.int64)
    last[starts] = starts
    last = np.maximum.accumulate(last)
    return length[last] - (np.arange(n) - last)


def repeated_windows(pieces: list[bytes], size: int) -> list[np.ndarray]:
    """For each piece (UTF-8 or other bytes without 0xFF) a flag for every
    start of ``size`` bytes in it: whether these bytes also start elsewhere in
    the pieces."""
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    t = np.concatenate([joined.astype(np.int64) + 1, [0]])
    sa = suffix_array(t, 257)
    # The end mark is no byte; behind the last separator a zero byte stands for it.
    lcp = permuted_common_prefixes(np.concatenate([joined, np.zeros(1, np.uint8)]), sa)
    far = lcp[sa] >= size
    hit = np.zeros(len(t), bool)
    hit[sa[far]] = True
    hit[sa[np.flatnonzero(far) - 1]] = True
    out, at = [], 0
    for p in pieces:
        out.append(hit[at:at + max(0, len(p) - size + 1)])
        at += len(p) + 1
    return out
