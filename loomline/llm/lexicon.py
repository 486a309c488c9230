"""A minimal acyclic transducer from words to token ids, as flat arrays that workers map into memory.

States with the same continuations are shared, so common suffixes are stored once. Every arc carries the number
of words that sort before it at its state; the sum along a word's path is the word's index, and the index
names its ids in one flat array. Minimality doesn't suffer, for the ids are not on the arcs.
"""

from __future__ import annotations

import io
import mmap

import numpy as np

_MAGIC = b"LOOMLEX1"
_PARTS = ("first", "keys", "target", "skip", "final", "start", "ids")


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of the words (not empty) of entries, as bytes. Words are added in order; each leaves the
    states behind it, which can't change any more, merged with equal ones (Daciuk's construction)."""
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple]] = []  # (final, ((label, state), ...))

    def freeze(state: list) -> int:
        sign = (state[0], tuple(state[1]))
        if sign not in register:
            register[sign] = len(frozen)
            frozen.append(sign)
        return register[sign]

    path: list[list] = [[False, []]]  # open states along the last word: [final, arcs]
    last = b""
    for w in words:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        while len(path) > k + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(done)))
        for _ in w[k:]:
            path.append([False, []])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(done)))
    root = freeze(path[0])
    below = [0] * len(frozen)
    keys, target, skip = [], [], []
    for s, (final, arcs) in enumerate(frozen):  # targets are frozen before their sources
        seen = int(final)
        for label, t in arcs:
            keys.append(s * 256 + label)
            target.append(t)
            skip.append(seen)
            seen += below[t]
        below[s] = seen
    start = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(entries[w]) for w in words], out=start[1:])
    parts = {
        "first": np.array([root], np.int64), "keys": np.array(keys, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64),
        "final": np.array([f for f, _ in frozen], np.int64), "start": start, "ids": np.array([i for w in words for i in entries[w]], np.int64),
    }
    out = io.BytesIO()
    out.write(_MAGIC + np.array([len(parts[p]) for p in _PARTS], np.int64).tobytes())
    for p in _PARTS:
        out.write(parts[p].tobytes())
    return out.getvalue()


class Lexicon:
    """Read-only view of a compiled lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        sizes = np.frombuffer(self._map, np.int64, len(_PARTS), 8)
        at = 8 + 8 * len(_PARTS)
        for p, n in zip(_PARTS, sizes):
            setattr(self, p, np.frombuffer(self._map, np.int64, int(n), at))
            at += 8 * int(n)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 for words that the lexicon doesn't have. All words step together."""
        n = len(words)
        state, index = np.full(n, self.first[0] if len(self.keys) else -1), np.zeros(n, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        live = np.flatnonzero((sizes > 0) & (state >= 0))
        state[sizes == 0] = -1
        for k in range(int(sizes.max()) if n else 0):
            live = live[sizes[live] > k]
            if not len(live):
                break
            key = state[live] * 256 + flat[begin[live] + k]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            ok = self.keys[arc] == key
            state[live[~ok]] = -1
            live, arc = live[ok], arc[ok]
            state[live] = self.target[arc]
            index[live] += self.skip[arc]
        good = state >= 0
        good[good] = self.final[state[good]] == 1
        index[~good] = -1
        return index

    def ids_of(self, index: int) -> list[int]:
        return self.ids[self.start[index] : self.start[index + 1]].tolist()
