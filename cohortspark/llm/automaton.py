"""Regexes over bytes -> one minimal deterministic automaton held in transition arrays.

``re``'s own parser gives the syntax tree; from it come a Thompson NFA, the subset construction over
byte classes and Moore's minimisation. ``scan`` feeds whole texts through the arrays.
"""

from __future__ import annotations

import re._constants as K
import re._parser as sre
from collections.abc import Sequence

import numpy as np

ALL = (1 << 256) - 1


class _Nfa:
    def __init__(self, backward: bool = False):
        self.backward = backward  # the regex read from its end
        self.moves: list[list[tuple[int, int]]] = []  # (set of bytes as a bit mask, target)
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, tree, at: int) -> int:
        for op, arg in reversed(tree) if self.backward else tree:
            at = self._one(op, arg, at)
        return at

    def _one(self, op, arg, at: int) -> int:
        if op in (K.LITERAL, K.NOT_LITERAL, K.IN, K.ANY):
            end = self.state()
            self.moves[at].append((_bytes(op, arg), end))
            return end
        if op is K.SUBPATTERN:
            return self.build(arg[3], at)
        if op is K.BRANCH:
            end = self.state()
            for choice in arg[1]:
                begin = self.state()
                self.free[at].append(begin)
                self.free[self.build(choice, begin)].append(end)
            return end
        if op is K.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                at = self.build(inner, at)
            if high is K.MAXREPEAT:
                loop = self.state()
                self.free[at].append(loop)
                self.free[self.build(inner, loop)].append(loop)
                return loop
            end = self.state()
            for _ in range(high - low):
                self.free[at].append(end)
                at = self.build(inner, at)
            self.free[at].append(end)
            return end
        raise ValueError(f"unsupported in a rule: {op}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes(op, arg) -> int:
    if op is K.LITERAL:
        return 1 << arg
    if op is K.NOT_LITERAL:
        return ALL ^ (1 << arg)
    if op is K.ANY:
        return ALL ^ (1 << 10)
    mask, negate = 0, False
    for kind, x in arg:
        if kind is K.NEGATE:
            negate = True
        elif kind is K.LITERAL:
            mask |= 1 << x
        elif kind is K.RANGE:
            mask |= ((1 << (x[1] + 1)) - 1) ^ ((1 << x[0]) - 1)
        else:
            raise ValueError(f"unsupported in a class: {kind}")
    return ALL ^ mask if negate else mask


class Automaton:
    """``table[state * n_classes + class]`` -> state; ``accept[state]`` -> bit mask of rules. State 0 starts.

    ``search=True`` restarts at every byte, so that a mask tells which rules have matched somewhere so far;
    ``search=False`` is anchored at the first byte, and ``dead`` is the state that cannot match any more. ``backward=True`` reads from the end: fed with the bytes
    in reverse, a mask tells which rules have a match that begins here.
    """

    def __init__(self, patterns: Sequence[bytes], search: bool, backward: bool = False):
        nfa = _Nfa(backward)
        root, ends = nfa.state(), {}
        for i, p in enumerate(patterns):
            begin = nfa.state()
            nfa.free[root].append(begin)
            ends[nfa.build(sre.parse(p), begin)] = 1 << i
        sets = {m for moves in nfa.moves for m, _ in moves}
        kinds: dict[tuple[bool, ...], int] = {}
        ordered = sorted(sets)
        self.classes = np.array([kinds.setdefault(tuple(bool(m >> b & 1) for m in ordered), len(kinds)) for b in range(256)], np.uint8)
        example = [int(np.flatnonzero(self.classes == c)[0]) for c in range(len(kinds))]
        first = nfa.closure([root])
        number, todo, rows = {first: 0}, [first], []
        while todo:
            here, row = todo.pop(0), []
            for b in example:
                there = {t for s in here for m, t in nfa.moves[s] if m >> b & 1}
                nxt = nfa.closure(there | {root} if search else there)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            rows.append(row)
        table = np.array(rows, np.int64)
        accept = np.array([sum({ends[s] for s in states if s in ends}) for states in number], np.int64)
        dead = number.get(frozenset(), -1)
        self.table, self.accept, self.dead = _minimise(table, accept, dead)
        self.n_classes = table.shape[1]
        self.flat = np.ascontiguousarray(self.table).ravel().astype(np.int32)
        self.hits = self.accept.tolist()
        ahead = self.accept.copy()  # rules that can still match from a state
        while not np.array_equal(new := ahead | np.bitwise_or.reduce(ahead[self.table], axis=1), ahead):
            ahead = new
        self.ahead = ahead.tolist()
        resets = (self.table == 0).all(axis=0)
        self.sync = resets[self.classes]  # bytes after which every state is the start again
        self._rows = None

    def rows(self) -> list[list[int]]:
        """The table over raw bytes as lists, for short walks in Python."""
        if self._rows is None:
            self._rows = self.table[:, self.classes].tolist()
        return self._rows

    def begins(self, data: bytes) -> list[int]:
        """Of a backward search: for each place of ``data`` the mask of the rules that have a match from there on."""
        rows, hits, state, out = self.rows(), self.hits, 0, [0] * len(data)
        for i in range(len(data) - 1, -1, -1):
            state = rows[state][data[i]]
            out[i] = hits[state]
        return out

    def longest(self, data: bytes, at: int, rule: int) -> int:
        """End of the rule's longest match that begins at ``at`` (-1: none)."""
        rows, hits, state, end = self.rows(), self.hits, 0, -1
        for i in range(at, len(data)):
            state = rows[state][data[i]]
            if hits[state] & rule:
                end = i + 1
            elif not self.ahead[state] & rule:
                break
        return end


def _minimise(table: np.ndarray, accept: np.ndarray, dead: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Moore's refinement: split blocks by (block, blocks of the successors) until nothing splits."""
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    first = {}
    for s, b in enumerate(block.tolist()):
        first.setdefault(b, s)
    order = sorted(first, key=first.get)  # the start state's block stays number 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keep = [first[b] for b in order]
    return rank[block[table[keep]]], accept[keep], int(rank[block[dead]]) if dead >= 0 else -1


def scan(auto: Automaton, buffer: np.ndarray, few: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over ``buffer`` (uint8): starts, lengths and rule masks of the stretches in which a rule matched.

    Stretches lie between bytes that reset the automaton, so all of them advance side by side; the last
    ``few`` long ones are walked singly.
    """
    cut = np.flatnonzero(auto.sync[buffer])
    starts = np.concatenate([[0], cut + 1])
    lengths = np.concatenate([cut, [len(buffer)]]) - starts
    order = np.argsort(-lengths, kind="stable")
    order = order[: np.searchsorted(-lengths[order], 0, "left")]
    starts, lengths = starts[order], lengths[order]
    classes = auto.classes[buffer]
    state, mask = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
    flat, accept, width = auto.flat, auto.accept, auto.n_classes
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    step = 0
    while step < len(alive) and alive[step] > few:
        k = alive[step]
        now = flat[state[:k] * width + classes[starts[:k] + step]]
        state[:k] = now
        mask[:k] |= accept[now]
        step += 1
    rows, hits = auto.rows() if step < len(alive) else None, auto.hits
    for lane in range(int(alive[step]) if step < len(alive) else 0):
        s, m = int(state[lane]), int(mask[lane])
        for b in buffer[starts[lane] + step : starts[lane] + lengths[lane]].tobytes():
            s = rows[s][b]
            m |= hits[s]
        mask[lane] = m
    found = np.flatnonzero(mask)
    return starts[found], lengths[found], mask[found]
