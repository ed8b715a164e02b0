"""Weighted acyclic automata over words: transducers from the n-grams of a sorted list (of one to three words) to their counts.

A state is a list of arcs (word, count of the n-gram that ends there, next state); the start state comes last. Sorted n-grams are added from their ends: the arc lists behind each prefix are
closed one level after another, and equal lists become one state, so n-grams with equal continuations share it. All steps are array operations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import zstandard

_MIX = np.uint64(0x9E3779B97F4A7C15)
ORDER = 3
EMPTY = np.zeros(0, np.int64)


def codes(cols: np.ndarray, words: int) -> np.ndarray | None:
    """One number for each n-gram, in the same order; None where 63 bits are too few."""
    if (words + 1) ** ORDER >= 1 << 63:
        return None
    code = cols[0] + 1
    for c in cols[1:]:
        code *= words + 1
        code += c + 1
    return code


def decoded(code: np.ndarray, words: int) -> np.ndarray:
    rest, low = np.divmod(code, words + 1)
    high, middle = np.divmod(rest, words + 1)
    return np.stack([high, middle, low]) - 1


def summed(cols: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different n-grams of ``cols`` (for each place the ids below ``words``, -1 behind the end) and the sums of their counts."""
    if not len(n):
        return cols, n
    if (code := codes(cols, words)) is not None:
        order = np.argsort(code, kind="stable")  # merges what is sorted already
        code = code[order]
        new = np.concatenate([[True], code[1:] != code[:-1]])
    else:
        order = np.lexsort(cols[::-1])
        new = np.concatenate([[True], (cols[:, order[1:]] != cols[:, order[:-1]]).any(0)])
    first = np.flatnonzero(new)
    return cols[:, order[first]], np.add.reduceat(n[order], first)


def _registered(begin: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each arc list (rows ``begin[i]`` to ``begin[i + 1]`` of ``arcs``) the list that stands for it, and which lists stand for themselves."""
    size = np.diff(np.append(begin, len(arcs)))
    h = np.zeros(len(arcs), np.uint64)
    for c in arcs.T:
        h = (h ^ c.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    total = np.add.reduceat(h, begin) + size.astype(np.uint64) * _MIX
    _, first, which = np.unique(total, return_index=True, return_inverse=True)
    same = first[which]
    # Equal hashes are not enough: the lists are compared.
    fits = size[same] == size
    a = np.flatnonzero(fits & (same != np.arange(len(begin))))
    if len(a):
        n = size[a]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = (arcs[np.repeat(begin[a], n) + inside] == arcs[np.repeat(begin[same[a]], n) + inside]).all(1)
        fits[a] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    same = np.where(fits, same, np.arange(len(begin)))
    return same, np.flatnonzero(same == np.arange(len(begin)))


class CountAutomaton:
    def __init__(self, words: list[bytes], first: np.ndarray, label: np.ndarray, target: np.ndarray, weight: np.ndarray):
        self.words, self.first, self.label, self.target, self.weight = words, first, label, target, weight

    @classmethod
    def of(cls, words: list[bytes], cols: np.ndarray, n: np.ndarray) -> CountAutomaton:
        """From sorted different n-grams (for each place the word ids, -1 behind the end) and counts; ``words`` is sorted."""
        if not len(n):
            return cls([], np.array([0, 0], np.int64), EMPTY, EMPTY, EMPTY)
        used = np.zeros(len(words) + 1, bool)
        for c in cols:
            used[c] = True
        used[-1] = False
        names = np.where(used, np.cumsum(used) - 1, -1)
        words, cols = [words[i] for i in np.flatnonzero(used).tolist()], names[cols]
        differs = [c[1:] != c[:-1] for c in cols]
        for k in range(1, ORDER):
            differs[k] |= differs[k - 1]  # from the n-gram before, in the first words
        start = np.concatenate([[0], np.arange(1, len(n))])
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        states, target_of = 0, None
        for level in range(ORDER, 0, -1):
            # One arc for each prefix of this length; its own row, if there is one, comes before those of its continuations.
            new = np.concatenate([[True], differs[level - 1]]) & (cols[level - 1] >= 0)
            at = start[new]
            if not len(at):
                continue
            ends = (cols[level][at] < 0) if level < ORDER else np.ones(len(at), bool)
            target = np.full(len(at), -1, np.int64)
            if target_of is not None:
                prefix, state = target_of
                target[np.searchsorted(at, prefix, "right") - 1] = state  # the arc that these rows continue
            arcs = np.stack([cols[level - 1][at], np.where(ends, n[at], 0), target], 1)
            if level > 1:
                a = np.concatenate([[0], np.cumsum(differs[level - 2])])[at]
                begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            else:
                begin = np.array([0])
            same, kept = _registered(begin, arcs)
            number = np.empty(len(begin), np.int64)
            number[kept] = np.arange(len(kept)) + states
            size = np.diff(np.append(begin, len(arcs)))
            stays = np.zeros(len(begin), bool)
            stays[kept] = True
            parts.append((size[kept], arcs[np.repeat(stays, size)]))
            states += len(kept)
            target_of = at[begin], number[same]
        size = np.concatenate([p[0] for p in parts])
        arcs = np.concatenate([p[1] for p in parts])
        return cls(words, np.concatenate([[0], np.cumsum(size)]), arcs[:, 0], arcs[:, 2], arcs[:, 1])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams, sorted (for each place the word ids), and their counts."""
        rows, counts = [], []
        prefix, state = [], np.array([len(self.first) - 2])
        for level in range(1, ORDER + 1):
            n = self.first[state + 1] - self.first[state]
            arc = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[state], n)
            prefix = [*(np.repeat(c, n) for c in prefix), self.label[arc]]
            weight, target = self.weight[arc], self.target[arc]
            ends = weight > 0
            rows.append(np.stack([c[ends] for c in prefix] + [np.full(ends.sum(), -1)] * (ORDER - level)))
            counts.append(weight[ends])
            more = target >= 0
            prefix, state = [c[more] for c in prefix], target[more]
        return summed(np.concatenate(rows, 1), np.concatenate(counts), len(self.words))

    def composed(self, asked: CountAutomaton) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of ``asked`` (its word ids) and their counts here; 0 for those that are not here. Both are walked side by side."""
        rows, _ = asked.paths()
        number = {w: i for i, w in enumerate(self.words)}
        known = np.array([number.get(w, -1) for w in asked.words] + [-1], np.int64)
        key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * (len(self.words) + 1) + self.label
        state, count = np.full(rows.shape[1], len(self.first) - 2), np.zeros(rows.shape[1], np.int64)
        for level in range(ORDER):
            word = known[rows[level]]
            on = (rows[level] >= 0) & (state >= 0) & (word >= 0)
            want = state * (len(self.words) + 1) + word
            arc = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
            on &= key[arc] == want if len(key) else False
            last = on & ((rows[level + 1] < 0) if level + 1 < ORDER else True)
            count[last] = self.weight[arc[last]]
            state = np.where(on, self.target[arc] if len(key) else -1, -1)
        return rows, count

    def dump(self) -> bytes:
        words = b" ".join(self.words)  # no word has a space
        head = np.array([len(words), len(self.words), len(self.first), len(self.label)], np.int64)
        return zstandard.compress(b"".join([head.tobytes(), words, *(x.astype(np.int32).tobytes() for x in (self.first, self.label, self.target)), self.weight.astype(np.int64).tobytes()]), 1)

    @classmethod
    def load(cls, data: bytes) -> CountAutomaton:
        data = zstandard.decompress(data)
        n, words, states, arcs = np.frombuffer(data, np.int64, 4).tolist()
        at = [32 + n]
        take = lambda k, kind: (np.frombuffer(data, kind, k, at[0]).astype(np.int64), at.__setitem__(0, at[0] + k * np.dtype(kind).itemsize))[0]
        first, label, target, weight = take(states, np.int32), take(arcs, np.int32), take(arcs, np.int32), take(arcs, np.int64)
        return cls(data[32 : 32 + n].split(b" ") if words else [], first, label, target, weight)


class Loaded(Sequence):
    """Automata that are loaded when they are asked for, and not kept."""

    def __init__(self, data: Sequence[bytes]):
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, i: int) -> CountAutomaton:
        return CountAutomaton.load(self.data[i])


def union(automata: Sequence[CountAutomaton]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, n-grams and summed counts of all; each is asked for twice."""
    words = sorted({w for a in automata for w in a.words})
    number = {w: i for i, w in enumerate(words)}
    rows, counts = [np.zeros((ORDER, 0), np.int64)], [EMPTY]
    for a in automata:
        own = np.array([number[w] for w in a.words] + [-1], np.int64)
        cols, n = a.paths()
        rows.append(own[cols])
        counts.append(n)
    return words, *summed(np.concatenate(rows, 1), np.concatenate(counts), len(words))
