"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists every vocabulary piece at every place of a word; one
pass of dynamic programming carries the best score and its number of pieces.

The tokenizer that is counted: text is cut before each blank and a blank is put first
(word mark U+2581); the path with the largest sum of log-probabilities wins; of equal
sums, the one whose last piece starts first, as in the tokenizers library, which only
replaces a path by a better one while it walks starts from left to right. A character
that no piece matches costs the least score less 10 and counts as its UTF-8 bytes, or
as one piece a run without ``byte_fallback``.

The vocabulary file holds merge ranks rather than log-probabilities, so pieces get
Zipf's: log(1 / (rank + 1)) less the logarithm of their sum.
"""

import math

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

VOCABULARY = "piece_bpe_32k.model"
MARK, PENALTY, MEMO = "▁", 10.0, 200_000


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, log-probability) by id; pieces that aren't text rank last."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    n = sp.get_piece_size()
    text = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
    total = math.log(math.fsum(1 / (r + 1) for r in range(n)))
    rank, out = 0, []
    for i in range(n):
        out.append((sp.id_to_piece(i), -math.log((rank if text[i] else n - 1) + 1) - total))
        rank += text[i]
    return out


class Counter(dict):
    """Word without its mark: (pieces, score). Remembers up to MEMO words of up to 64 characters."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, unknown: int = 0):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for i, (p, s) in enumerate(pieces):
            self.automaton.add_word(p, (len(p), s, i == unknown))  # the unknown piece's own name counts as unknown text
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.byte_fallback, self.name = byte_fallback, len(pieces[unknown][0].encode())

    def __missing__(self, word: str) -> tuple[int, float]:
        value = self.count(MARK + word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value

    def count(self, word: str) -> tuple[int, float]:
        n = len(word)
        score, pieces, unk, begin = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        single = [False] * n
        at = 0

        def put(a: int, b: int, s: float, unknown: bool) -> None:
            # unk: 0 known, 1 a run of unknown text, 2 the unknown piece's name alone, which is one piece
            more, state = 1, 0
            if unknown and self.byte_fallback:
                state = 2 if b - a == self.name and not unk[a] else 1
                if state == 1:
                    more = len(word[a:b].encode("utf-8", "surrogatepass")) + (self.name - 1) * (unk[a] == 2)
            elif unknown:
                more, state = int(not unk[a]), 1
            score[b], pieces[b], unk[b], begin[b] = s, pieces[a] + more, state, a

        def settle(upto: int) -> None:
            """Close the ends before ``upto``: unknown characters compete as well."""
            nonlocal at
            while at < upto:
                if not single[at]:
                    s = score[at] + self.unknown
                    if begin[at + 1] < 0 or s > score[at + 1]:
                        put(at, at + 1, s, True)
                at += 1

        for end, (size, s, unknown) in self.automaton.iter(word):
            settle(end)
            start = end + 1 - size
            s += score[start]
            if size == 1:
                single[end] = True
            if begin[end + 1] < 0 or s > score[end + 1] or (s == score[end + 1] and start < begin[end + 1]):
                put(start, end + 1, s, unknown)
        settle(n)
        return pieces[n], score[n]

    def text(self, text: str | None) -> tuple[int, float]:
        words = (text or "").replace(MARK, " ").split(" ")
        if len(words) > 1 and not words[0]:
            del words[0]
        got = list(map(self.__getitem__, words)) if text else []
        return sum(g[0] for g in got), math.fsum(g[1] for g in got)


_held: dict = {}


def _counter(path: str | None, byte_fallback: bool) -> Counter:
    key = (path, byte_fallback)
    if key not in _held:
        _held[key] = Counter(vocabulary(path), byte_fallback)
    return _held[key]


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, byte_fallback: bool = True, keep: str = "doc_id", pieces: list[tuple[str, float]] | None = None, unknown: int = 0) -> DataFrame:
    """(doc_id, n_tokens, score) for every row; null and empty texts have no tokens.

    pieces: (piece, log-probability) by id of a unigram model, of which piece ``unknown``
    stands for unknown text; without them the vocabulary file's pieces with Zipf's.
    byte_fallback: the vocabulary has a piece for each byte.

    Rows stay apart, also with equal or null ids; other columns are ignored.
    """

    def work(batches):
        c = Counter(pieces, byte_fallback, unknown) if pieces else _counter(path, byte_fallback)
        for b in batches:
            got = [c.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], [keep, "n_tokens", "score"])

    return docs.select(keep, text).mapInArrow(work, f"`{keep}` {dict(docs.dtypes)[keep]}, n_tokens bigint, score double")
