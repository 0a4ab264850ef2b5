"""Byte-level BPE over whole texts, on the driver's or a worker's Python side.

A text falls into chunks before each single space that a non-space follows; the
pre-tokenizer never joins such neighbours, so chunks are encoded alone and remembered.
The ids of a chunk, or of its word where marks follow the word, come from a lexicon, if
one is given, else from exact merges.
"""

import heapq
import json
import re
import struct

import public_tokenizers
import tiktoken
from tokenizers import pre_tokenizers

TOKENIZER = "byte_bpe_50k.json"
#: Entries of a worker's memory before they become old ones, and the longest that is kept.
MEMO, MEMO_CHARS = 120_000, 64
#: A blank, Latin letters, then ASCII marks: two pre-tokens, or one without marks.
_SIMPLE = re.compile(r"( [A-Za-zÀ-ÖØ-öø-ſ]+)([!-/:-@\[-`{-~]*)\Z")
#: A space before white space or the end: such texts are cut by pattern instead.
_ODD = re.compile(r" (?=[\s\x1c-\x1f\x85᠎​﻿]|\Z)")
_CUT = re.compile(r"(?= [^\s\x1c-\x1f\x85᠎​﻿])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_NONE, _ID = 1 << 62, (1 << 32) - 1


class _Memo(dict):
    """Results of make() by key. When full, the entries become the old ones, from which what
    is asked for again moves back; older ones are forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def lexicon_key(chunk: str) -> str:
    """What is looked up for a chunk: its word without marks, else all of it."""
    simple = _SIMPLE.match(chunk)
    return simple.group(1) if simple else chunk


class Encoder:
    """ids as little-endian unsigned 32-bit integers, equal to the tokenizers library's."""

    def __init__(self, path: str, lexicon=None):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {(vocab[a], vocab[b]): i << 32 | vocab[a + b] for i, (a, b) in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        self.first = {b: vocab[c] for c, b in self.alphabet.items()}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.token_bytes = {i: bytes(self.alphabet[c] for c in t) for t, i in vocab.items()}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.lexicon = lexicon
        # ids are in order of merges, so they serve as ranks; merge() below does the same
        ranks = {v: k for k, v in self.token_bytes.items() if k not in self.special.values()}
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merge_piece = self.library._encode_single_piece
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = _Memo(self._merge_word)
        self.raw = _Memo(self._chunk)
        self.spaced = _Memo(lambda s: self._chunk(" " + s))

    def _chunk(self, chunk: str) -> bytes:
        simple = _SIMPLE.match(chunk)
        if simple:
            word, marks = simple.groups()
            return self.words[word] + self.words[marks] if marks else self.words[word]
        found = self._known(chunk)
        if found is not None:
            return found
        return b"".join([self._merge_bytes(bytes(map(self.alphabet.__getitem__, w))) for w, _ in self.split(chunk)])

    def _known(self, chunk: str) -> bytes | None:
        return None if self.lexicon is None else self.lexicon.get(chunk.encode("utf-8", "surrogatepass"))

    def _merge_word(self, word: str) -> bytes:
        found = self._known(word)
        return self._merge_bytes(word.encode()) if found is None else found

    def _merge_bytes(self, word: bytes) -> bytes:
        ids = self.merge_piece(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._special is not None and self._special.search(text):
            parts = self._special.split(text)
            return b"".join(struct.pack("<I", self.special[p]) if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return b"".join(map(self.raw.__getitem__, _CUT.split(text)))
        first, *rest = text.split(" ")
        head = self.raw[first] if first else b""
        return head + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        n = memoryview(ids).cast("I") if ids else []
        return b"".join(map(self.token_bytes.__getitem__, n)).decode("utf-8", "replace")


def merge(ids: list[int], rank: dict) -> list[int]:
    """Merges of lowest rank first, leftmost first, until none applies. rank: pair to
    rank * 2**32 + new id."""
    if len(ids) > 200:
        return _merge_long(ids, rank)
    get = rank.get
    best = [get(p, _NONE) for p in zip(ids, ids[1:])]
    while best:
        low = min(best)
        if low == _NONE:
            break
        i = best.index(low)
        ids[i] = low & _ID
        del ids[i + 1], best[i]
        if i:
            best[i - 1] = get((ids[i - 1], ids[i]), _NONE)
        if i < len(best):
            best[i] = get((ids[i], ids[i + 1]), _NONE)
    return ids


def _merge_long(ids: list[int], rank: dict) -> list[int]:
    """The same with a queue over a linked list: n log n for runs without white space."""
    ids, n = list(ids), len(ids)
    left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    queue = [(rank[p] >> 32, i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
    heapq.heapify(queue)
    while queue:
        _, i, pair = heapq.heappop(queue)
        j = right[i]
        if not live[i] or j >= n or (ids[i], ids[j]) != pair:
            continue
        ids[i], live[j], right[i] = rank[pair] & _ID, False, right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (p := (ids[a], ids[b])) in rank:
                heapq.heappush(queue, (rank[p] >> 32, a, p))
    return [x for x, ok in zip(ids, live) if ok]


_held: dict = {}


def encoder(path: str | None = None, lexicon_file: str | None = None) -> Encoder:
    """This process's encoder for a vocabulary file and a lexicon file. Of encoders with a
    lexicon only the last is held, as workers outlive the query that made a lexicon."""
    key = (path or public_tokenizers.path(TOKENIZER), lexicon_file)
    if key not in _held:
        from folioquery.llm.lexicon import Lexicon

        for old in [k for k in _held if k[1]]:
            del _held[old]
        _held[key] = Encoder(key[0], Lexicon.open(lexicon_file) if lexicon_file else None)
    return _held[key]
