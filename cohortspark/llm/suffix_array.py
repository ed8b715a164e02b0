"""Suffix array of a shard by induced sorting, and its permuted longest common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. The leftmost S suffixes (LMS) of the shard are sorted by their substrings, which get names;
where names repeat, the string of names is sorted recursively. Then the L suffixes are induced from the sorted LMS ones from left to right and the S suffixes from right to
left. Over bytes, whole character buckets are induced at once by arrays; over names, of which there are many, one suffix after another. Linear either way.
"""

from __future__ import annotations

import numpy as np

FEW, SIZE = 1024, 40  # up to so many characters, and for so many suffixes in each, buckets are induced by arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last character is the smallest and unique."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # where the character changes next
    return np.concatenate([np.concatenate([step, [1]])[nxt] > 0, [True]])


def _edges(t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    return end - size, end


def _placed(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, suffixes: np.ndarray, k: int, down: bool) -> None:
    """Put ``suffixes`` into their buckets in this order, from the heads on or from the tails down."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    size = np.bincount(c, minlength=k)
    rank = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    sa[at[c] - 1 - rank if down else at[c] + rank] = suffixes[order]
    if down:
        at -= size
    else:
        at += size


def _induced_by_buckets(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array, from the LMS suffixes in their order."""
    begin, end = _edges(t, k)
    sa, narrow = np.full(len(t), -1, np.int64), t.astype(np.uint16)
    seeds_end = np.cumsum(np.bincount(t[lms], minlength=k))
    seeds = lms[np.argsort(narrow[lms], kind="stable")]
    head = begin.copy()
    for c in range(k):
        low = begin[c]
        while low < head[c]:  # the bucket's own characters come in further rounds
            high = head[c]
            own, low = sa[low:high] - 1, high
            own = own[own >= 0]
            own = own[~small[own]]
            _placed(sa, head, narrow[own], own, k, False)
        own = seeds[seeds_end[c - 1] if c else 0 : seeds_end[c]] - 1
        own = own[own >= 0]
        _placed(sa, head, narrow[own], own, k, False)
    tail = end.copy()
    for c in range(k - 1, -1, -1):
        high = end[c]
        while high > tail[c]:
            low = tail[c]
            own, high = sa[low:high][::-1] - 1, low
            own = own[own >= 0]
            own = own[small[own]]
            _placed(sa, tail, narrow[own], own, k, True)
        own = sa[begin[c] : head[c]][::-1] - 1
        own = own[own >= 0]
        own = own[small[own]]
        _placed(sa, tail, narrow[own], own, k, True)
    sa[0] = len(t) - 1  # no suffix induces the last one
    return sa


def _induced_one_by_one(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    begin, end = _edges(t, k)
    chars, is_small, sa = t.tolist(), small.tolist(), [0] * len(t)  # a 0 has no suffix before it, so it induces nothing
    at = end.tolist()
    for i in lms[::-1].tolist():
        c = chars[i]
        at[c] -= 1
        sa[at[c]] = i
    at = begin.tolist()
    for x in sa:
        if x and not is_small[x - 1]:
            c = chars[x - 1]
            sa[at[c]] = x - 1
            at[c] += 1
    at = end.tolist()
    for i in range(len(sa) - 1, -1, -1):
        x = sa[i]
        if x and is_small[x - 1]:
            c = chars[x - 1]
            at[c] -= 1
            sa[at[c]] = x - 1
    sa[0] = len(t) - 1
    return np.array(sa, np.int64)


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """For the LMS suffixes in text order the rank of their substring (up to the next one, inclusive)."""
    size = np.empty(len(t), np.int64)
    size[lms] = np.diff(np.concatenate([lms, [len(t) - 1]])) + 1
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    length = size[a][same]
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    equal = t[np.repeat(a[same], length) + inside] == t[np.repeat(b[same], length) + inside]
    if len(length):
        same[same] = np.logical_and.reduceat(equal, np.cumsum(length) - length)
    name = np.empty(len(t), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes in their order. ``t``: integers below ``k``, of which the last is 0 and the only 0."""
    if len(t) < 3:
        return np.arange(len(t))[::-1]
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induced = _induced_by_buckets if k <= min(FEW, len(t) // SIZE) else _induced_one_by_one
    sa = induced(t, small, lms, k)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    names = _names(t, lms, ordered)
    if (n := int(names.max()) + 1) < len(lms):
        ordered = lms[suffix_array(names, n)]
    return induced(t, small, ordered, k)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place the length of the longest common prefix of its suffix and the one before it in the order, in text order.

    Where the two characters before are equal the length is one less than that of the place before; only the others are compared.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    own = phi >= 0
    own[1:] &= (phi[1:] <= 0) | (t[:-1] != t[phi[1:] - 1])
    first = at[own]
    length = np.zeros(len(first), np.int64)
    wide = np.concatenate([t.astype(np.int64), np.full(1, -1)])
    open_ = np.arange(len(first))
    while len(open_):
        i, j = first[open_] + length[open_], phi[first[open_]] + length[open_]
        equal = wide[np.minimum(i, n)] == wide[np.minimum(j, n)]
        equal &= (i < n) & (j < n)
        open_ = open_[equal]
        length[open_] += 1
    out = np.zeros(n, np.int64)
    out[first] = length + first
    out = np.maximum.accumulate(out) - at  # the sum of place and length never falls
    return np.where(phi >= 0, np.maximum(out, 0), 0)
