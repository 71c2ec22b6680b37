"""Minimal acyclic transducer: a shared-suffix automaton of words whose outputs are token id lists.

Sorted words are added one at a time; suffix states that became final in form are replaced by
equal registered ones, so equal suffixes are stored once.  Each edge carries the number of words
that sort before it, so the edges of a path sum to the word's rank, and the rank indexes the id
lists.  The automaton is laid out as a double array (base/check), written as one block of bytes
that a worker memory-maps.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable

import numpy as np

_MAGIC = 0x4E504C58


def build(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Compile (word, ids) pairs; words are distinct and not empty."""
    entries = sorted(entries)
    edges: list[list[tuple[int, int]]] = [[]]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]  # states of the word added last

    def settle(down_to: int, word: bytes) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            state, parent = path[depth], path[depth - 1]
            form = (final[state], tuple(edges[state]))
            kept = register.setdefault(form, state)
            if kept != state:
                edges[parent][-1] = (word[depth - 1], kept)
        del path[down_to + 1 :]

    last = b""
    for word, _ in entries:
        common = 0
        while common < len(word) and common < len(last) and word[common] == last[common]:
            common += 1
        settle(common, last)
        for byte in word[common:]:
            edges.append([])
            final.append(False)
            edges[path[-1]].append((byte, len(edges) - 1))
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    settle(0, last)

    order, words_below = [], {}
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            words_below[state] = int(final[state]) + sum(words_below[t] for _, t in edges[state])
            order.append(state)
        elif state not in words_below:
            words_below[state] = -1
            stack.append((state, True))
            stack.extend((t, False) for _, t in edges[state] if t not in words_below)
    number = {s: i for i, s in enumerate(reversed(order))}
    size = 256 * 2
    check, target, skip = [-1] * size, [0] * size, [0] * size
    base, accept = [0] * len(order), [0] * len(order)
    free, hints = 256, {}  # next cell for single edges; where the search began last, by number of edges

    def room(at: int) -> None:
        while at + 512 > len(check):
            grow = len(check)
            check.extend([-1] * grow)
            target.extend([0] * grow)
            skip.extend([0] * grow)

    for state in sorted(number, key=lambda s: -len(edges[s])):
        out = edges[state]
        accept[number[state]] = int(final[state])
        if not out:
            continue
        if len(out) == 1:
            while check[free] != -1:
                free += 1
                room(free)
            at = free - out[0][0]
        else:
            at, tries = hints.get(len(out), 0), 0
            while any(check[at + b] != -1 for b, _ in out):
                at += 1
                tries += 1
                room(at)
            hints[len(out)] = at + (tries > 64) * 16
        room(at)
        base[number[state]] = at
        below = int(final[state])
        for b, t in out:
            check[at + b], target[at + b], skip[at + b] = number[state], number[t], below
            below += words_below[t]
    lists = [ids for _, ids in entries]
    starts = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    ids = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(starts[-1]))
    parts = [np.asarray(x, dtype="<i4") for x in (base, accept, check, target, skip, starts, ids)]
    head = np.asarray([_MAGIC, *map(len, parts)], dtype="<i4")
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled automaton read through a memory map."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:  # the map outlives the name; nothing is left behind
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        words = memoryview(self._map).cast("i")
        if words[0] != _MAGIC:
            raise ValueError("not a compiled lexicon")
        at, parts = 8, []
        for n in words[1:8]:
            parts.append(words[at : at + n])
            at += n
        self._base, self._accept, self._check, self._target, self._skip, self._starts, self._ids = parts

    def rank(self, word: bytes) -> int:
        """Index of the word among the sorted words, or -1."""
        base, check, target, skip = self._base, self._check, self._target, self._skip
        state = rank = 0
        for byte in word:
            at = base[state] + byte
            if check[at] != state:
                return -1
            rank += skip[at]
            state = target[at]
        return rank if self._accept[state] else -1

    def get(self, word: bytes) -> list[int] | None:
        rank = self.rank(word)
        return None if rank < 0 else self._ids[self._starts[rank] : self._starts[rank + 1]].tolist()
