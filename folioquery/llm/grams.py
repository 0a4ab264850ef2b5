"""Word n-grams of Arrow text columns as numpy arrays: places, 128-bit names, strings.

ASCII capitals are lower-cased. Bytes of BREAKS end a piece, blanks end a word, all
others belong to words, so UTF-8 letters need no decoding. A text longer than a block is
cut at a break, or where there is none at a blank, with the next words in sight, so that
every n-gram is counted once in the block that its first word starts in.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
BLOCK = 1 << 22

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")
_STOP = re.compile(b"[" + re.escape(BREAKS + BLANKS) + b"]")
_NEXT = b"(?:[" + re.escape(BLANKS) + b"]+[^" + re.escape(BREAKS + BLANKS) + b"]+){0,%d}"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all its bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the two bases and of their inverses modulo 2 ** 64, as many as were asked for."""

    def __init__(self):
        self.held: list = [(np.ones(1, _U), np.ones(1, _U))] * 2

    def upto(self, n: int):
        if len(self.held[0][0]) < n:
            size = max(n, BLOCK + 4096)
            fill = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]))
            self.held = [(fill(b), fill(pow(b, -1, 1 << 64))) for b in _BASES]
        return self.held


_powers = _Powers()


class Block:
    """Words of some consecutive texts. lang: each text's number, salt: each number's 64 bits."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, core: int):
        self.data, n = _LOW[data], len(data)
        kind = _KIND[self.data]
        word = kind == 0
        first = np.zeros(n + 1, bool)  # a text's first byte
        first[offsets[:-1]] = True
        before = np.concatenate([[False], word[:-1]])
        starts = np.flatnonzero(word & (~before | first[:n]))
        after = np.concatenate([word[1:], [False]])
        ends = np.flatnonzero(word & (~after | first[1 : n + 1])) + 1
        text = np.searchsorted(offsets, starts, "right") - 1
        broken = np.cumsum(kind == 2, dtype=np.int32)
        self.starts, self.ends = starts, ends
        self.piece = broken[starts] + text
        self.lang = lang[text]
        self.core = int(np.searchsorted(starts, core))
        self.names = []
        for power, inverse in _powers.upto(n + 1):
            sums = np.concatenate([np.zeros(1, _U), np.cumsum((self.data.astype(_U) + _U(1)) * power[:n], dtype=_U)])
            self.names.append(mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U)))

    def grams(self, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether k words of one piece start at each word, and the two halves of their name
        (of no meaning where none start)."""
        n = max(len(self.starts) - k + 1, 0)
        inside = self.piece[:n] == self.piece[k - 1 :]
        out = []
        for h in self.names:
            g = h[:n].copy()
            for j in range(1, k):
                g = mixed(g * _U(0xFF51AFD7ED558CCD) + h[j : j + n])
            out.append(g)
        return inside, out

    def strings(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words that start at each of the words ``at``, space-joined."""
        words = at[:, None] + np.arange(k)
        starts, size = self.starts[words].ravel(), (self.ends[words] - self.starts[words] + 1).ravel()
        to = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(to[-1]) + np.repeat(starts - to[:-1], size)
        out = self.data[np.minimum(source, len(self.data) - 1)] if len(source) else np.zeros(0, np.uint8)
        out[to[1:] - 1] = 32
        keep = np.ones(len(out), bool)
        keep[to[k::k] - 1] = False  # no space after a phrase
        ends = to[::k] - np.arange(len(at) + 1)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out[keep].tobytes()))


def blocks(texts: pa.Array, lang: np.ndarray, ahead: int, block: int = BLOCK) -> Iterator[Block]:
    """The column's texts in order. lang: a number for each text; ``ahead`` more words are
    seen where a text without breaks is cut."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1, i + 1)
        j = min(j, n)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= block:
            if b > a:
                yield Block(data[a:b], offsets[i : j + 1] - a, lang[i:j], b - a)
        else:  # one long text
            raw = data[a:b].tobytes()
            for s, c, x in _cuts(raw, ahead, block):
                yield Block(data[a + s : a + x], np.array([0, x - s]), lang[i:j], c - s)
        i = j


def _cuts(raw: bytes, ahead: int, block: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, end with the words ahead) of each part of one text."""
    s, look = 0, re.compile(_NEXT % ahead)
    while len(raw) - s > block:
        c = max(raw.rfind(bytes([b]), s + block // 2, s + block) for b in BREAKS) + 1
        if c:
            yield s, c, c
        else:
            stop = _STOP.search(raw, s + block)
            if stop is None:
                break
            c = stop.start()
            yield s, c, look.match(raw, c).end()
        s = c
    yield s, len(raw), len(raw)


def spots(name: np.ndarray, salt: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each name; buckets: a power of two."""
    return mixed(name + salt) & _U(buckets - 1)
