"""A minimal acyclic transducer: words to id sequences, in one memory-mapped file.

States with the same remaining words are shared, prefixes and suffixes alike. Each
edge carries how many words come before those through it, so a walk also yields the
word's number, and the number finds its ids in a flat table.
"""

import mmap
import struct

import numpy as np

_MAGIC = b"FQLEX001"


def build(words: dict[bytes, bytes]) -> bytes:
    """File content for words with their ids (unsigned 32-bit, little-endian).

    Words are added in byte order; a state is frozen and shared as soon as no later
    word can pass it.
    """
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states of the last word: [final, edges]
    last = b""

    def freeze(state) -> int:
        key = (state[0], tuple(state[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(frozen)
            frozen.append(key)
        return at

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(done)))

    ordered = sorted(words)
    for w in ordered:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in w[same:])
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0])
    below = np.zeros(len(frozen), np.uint32)  # targets are frozen before their sources
    first, label, target, skip = [0], [], [], []
    for i, (final, edges) in enumerate(frozen):
        seen = int(final)
        for c, t in edges:
            label.append(c)
            target.append(t)
            skip.append(seen)
            seen += int(below[t])
        below[i] = seen
        first.append(len(label))
    offsets, at = [0], 0
    for w in ordered:
        at += len(words[w]) // 4
        offsets.append(at)
    parts = [
        np.array(first, "<u4").tobytes(),
        np.array([f for f, _ in frozen], "u1").tobytes(),
        np.array(label, "u1").tobytes(),
        np.array(target, "<u4").tobytes(),
        np.array(skip, "<u4").tobytes(),
        np.array(offsets, "<u4").tobytes(),
        b"".join(words[w] for w in ordered),
    ]
    return _MAGIC + struct.pack("<5I", root, len(frozen), len(label), len(ordered), at) + b"".join(p + b"\0" * (-len(p) % 4) for p in parts)


class Lexicon:
    def __init__(self, data):
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not a lexicon file")
        self.root, states, edges, words, ids = struct.unpack_from("<5I", data, 8)
        self.words, self.states, self.edges, at = words, states, edges, 28
        self.known: dict = {}
        got = []
        for n, kind in ((states + 1, "<u4"), (states, "u1"), (edges, "u1"), (edges, "<u4"), (edges, "<u4"), (words + 1, "<u4"), (ids, "<u4")):
            got.append(memoryview(np.frombuffer(data, kind, n, at)))
            at += got[-1].nbytes + (-got[-1].nbytes % 4)
        self.first, self.final, self.label, self.target, self.skip, self.offsets, self.ids = got

    @classmethod
    def open(cls, file: str) -> "Lexicon":
        with open(file, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _edges(self, state: int) -> dict[int, tuple[int, int]]:
        """A state's edges by label, kept once read: no more than the file's states."""
        lo, hi = self.first[state], self.first[state + 1]
        got = self.known[state] = {self.label[i]: (self.target[i], self.skip[i]) for i in range(lo, hi)}
        return got

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word, or None if the lexicon doesn't have it."""
        known, state, number = self.known, self.root, 0
        for c in word:
            edges = known.get(state)
            step = (self._edges(state) if edges is None else edges).get(c)
            if step is None:
                return None
            state = step[0]
            number += step[1]
        if not self.final[state]:
            return None
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tobytes()
