"""Toxic spans and document scores from a linear-chain conditional random field.

Labels of documents give labelled tokens: in training rows, words and word beginnings and
ends that toxic documents use far more than others are cues; a token with a cue in a
toxic document is labelled toxic, every other token clean. The field (two tags, cue
weights, bias, transitions) is fitted to those tokens. For every document,
forward-backward marginals give each cue token its probability of being toxic; their sum
gives the document's score by a two-parameter calibration on the training rows, and the
likely ones are the offending spans.

The fit reads at most about ``rows`` labelled rows, picked by hash, for cues and
calibration, and at most about ``windows`` sequences of tokens around cues for the field.
Every cue of those rows that passes counts. Labels, language, source and id are never
inputs of a score.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.plans.workspace import Workspace

ROWS, FIELD_ROWS, WINDOWS = 40_000, 6_000, 200_000
#: Least occurrences in toxic text and least log-odds ratio of a cue; chosen on a fifth of the
#: training rows, held back from the fit.
LEAST, ODDS = 5, 3.0
_WORD = re.compile(r"[^\W_]+")
_MEMO = 200_000
EDGE = 2


def parts(word: str) -> list[str]:
    """A word's possible cues: itself and, from 6 characters on, its beginnings and end."""
    if len(word) < 6:
        return ["w:" + word]
    return ["w:" + word, "4:" + word[:4], "5:" + word[:5], "e:" + word[-4:]]


class Field:
    """Two tags, 0 clean and 1 toxic. Scores: bias and cue weights for tag 1, move[a, b]."""

    def __init__(self, cues: list[str], weight=None, bias: float = -4.0, move=None):
        self.index = {c: i for i, c in enumerate(cues)}
        self.weight = np.zeros(len(cues)) if weight is None else weight
        self.bias, self.move = bias, np.zeros((2, 2)) if move is None else move

    def cues_of(self, word: str) -> list[int]:
        return [i for p in parts(word) if (i := self.index.get(p)) is not None]

    def fit(self, windows: list[tuple[list[list[int]], list[int]]], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> "Field":
        """windows: (cues, tag) of the tokens of short sequences. Adam on the mean log-likelihood."""
        windows = [w for w in windows if w[0]]
        if not windows or not self.index:
            return self
        n, most = len(windows), max(len(w[0]) for w in windows)
        tag, real = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
        row, col, cue = [], [], []
        for i, (cs, ts) in enumerate(windows):
            tag[i, : len(ts)], real[i, : len(ts)] = ts, True
            for j, c in enumerate(cs):
                row += [i] * len(c)
                col += [j] * len(c)
                cue += c
        row, col, cue = np.array(row, int), np.array(col, int), np.array(cue, int)
        state = np.concatenate([self.weight, [self.bias], self.move.ravel()])
        m, v, k = np.zeros_like(state), np.zeros_like(state), len(self.weight)
        for step in range(1, rounds + 1):
            emit = np.full((n, most), state[k])
            np.add.at(emit, (row, col), state[cue])
            one, two = _marginals(emit, state[k + 1 :].reshape(2, 2), real)
            off = np.where(real, one - tag, 0.0)
            grad = np.zeros_like(state)
            np.add.at(grad, cue, off[row, col])
            grad[k] = off.sum()
            seen = real[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    grad[k + 1 + 2 * a + b] = np.where(seen, two[:, :, a, b] - ((tag[:, :-1] == a) & (tag[:, 1:] == b)), 0).sum()
            grad = grad / n + ridge * state
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            state = state - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weight, self.bias, self.move = state[:k], float(state[k]), state[k + 1 :].reshape(2, 2)
        return self


def _marginals(emit: np.ndarray, move: np.ndarray, real: np.ndarray):
    """P(tag 1) at each place and P(pair of tags) of neighbours, for padded sequences."""
    n, most = emit.shape
    e = np.stack([np.zeros_like(emit), emit], 2)
    fwd, back = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    fwd[:, 0] = e[:, 0]
    for j in range(1, most):
        new = np.logaddexp(fwd[:, j - 1, 0, None] + move[0], fwd[:, j - 1, 1, None] + move[1]) + e[:, j]
        fwd[:, j] = np.where(real[:, j, None], new, fwd[:, j - 1])
    for j in range(most - 2, -1, -1):
        nxt = e[:, j + 1] + back[:, j + 1]
        new = np.logaddexp(move[:, 0] + nxt[:, 0, None], move[:, 1] + nxt[:, 1, None])
        back[:, j] = np.where(real[:, j + 1, None], new, 0.0)
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    one = np.exp(fwd[:, :, 1] + back[:, :, 1] - z[:, None])
    pair = fwd[:, :-1, :, None] + move + (e + back)[:, 1:, None, :] - z[:, None, None, None]
    return one, np.exp(np.where(real[:, 1:, None, None], pair, -np.inf))


class Tagger:
    """Marginals of whole documents. Tokens without a cue share one 2 x 2 step, so a run of
    them is a power of it, and only cue tokens are visited."""

    def __init__(self, field: Field):
        self.field = field
        self.step = np.exp(field.move) * np.array([1.0, math.exp(field.bias)])
        self.powers = {0: (np.eye(2).ravel().tolist(), 0.0)}
        self.memo: dict = {}

    def _run(self, r: int):
        """The step's r-th power, scaled, as a flat list; scales don't change marginals."""
        got = self.powers.get(r)
        if got is None:
            out, base, k = np.eye(2), self.step / self.step.max(), r
            while k:
                if k & 1:
                    out = out @ base
                    out /= out.max()
                base = base @ base
                base /= base.max()
                k >>= 1
            got = (out.ravel().tolist(), 0.0)
            if len(self.powers) < 100_000:
                self.powers[r] = got
        return got[0]

    def lift(self, word: str) -> float | None:
        """exp(sum of cue weights), None without cues."""
        got = self.memo.get(word, 0)
        if got == 0:
            cues = self.field.cues_of(word)
            got = math.exp(min(50.0, sum(self.field.weight[c] for c in cues))) if cues else None
            if len(word) <= 64:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(place, P(toxic)) of the cue tokens."""
        lift = self.lift
        at = [(i, x) for i, x in enumerate(map(lift, words)) if x is not None]
        if not at:
            return []
        bias, fwd, last = math.exp(self.field.bias), [], -1
        a0, a1 = 1.0, 1.0  # before the first token both tags are free
        for i, x in at:
            gap = i - last - 1
            if last < 0:
                if i:
                    p = self._run(i - 1)
                    b0, b1 = 1.0, bias
                    a0, a1 = b0 * p[0] + b1 * p[2], b0 * p[1] + b1 * p[3]
                    a0, a1 = self._move(a0, a1)
                a1 *= bias * x
            else:
                p = self._run(gap)
                a0, a1 = a0 * p[0] + a1 * p[2], a0 * p[1] + a1 * p[3]
                a0, a1 = self._move(a0, a1)
                a1 *= bias * x
            s = a0 + a1
            a0, a1 = a0 / s, a1 / s
            fwd.append((a0, a1))
            last = i
        p = self._run(len(words) - 1 - last)
        b0, b1 = p[0] + p[1], p[2] + p[3]
        out = []
        for k in range(len(at) - 1, -1, -1):
            f0, f1 = fwd[k]
            m = f1 * b1 / (f0 * b0 + f1 * b1)
            out.append((at[k][0], m))
            if k:
                x = at[k][1]
                c0, c1 = b0, b1 * bias * x
                mv = self._moves
                d0, d1 = mv[0] * c0 + mv[1] * c1, mv[2] * c0 + mv[3] * c1
                p = self._run(at[k][0] - at[k - 1][0] - 1)
                b0, b1 = p[0] * d0 + p[1] * d1, p[2] * d0 + p[3] * d1
                s = b0 + b1
                b0, b1 = b0 / s, b1 / s
        return out[::-1]

    @property
    def _moves(self):
        got = self.__dict__.get("_mv")
        if got is None:
            got = self.__dict__["_mv"] = np.exp(self.field.move).ravel().tolist()
        return got

    def _move(self, a0: float, a1: float):
        m = self._moves
        return a0 * m[0] + a1 * m[2], a0 * m[1] + a1 * m[3]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def held_out(doc_id) -> F.col:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", rows: int = ROWS) -> DataFrame:
    """(text, toxic, h): labelled rows that aren't held out, each text once, about ``rows``
    of them, by hash. A document with several labels counts as toxic if one says so."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(label).alias("toxic"))
    n = marks.count()
    share = min(1.0, rows / n) if n else 1.0
    h = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000))
    marks = marks.withColumn("h", h).where(F.col("h") < int(1_000_000 * share))
    texts = docs.select("doc_id", F.col(text).alias("text")).join(marks, "doc_id").where("text is not null")
    return texts.select("text", "toxic", (F.col("h") / F.lit(1_000_000 * share)).alias("h")).dropDuplicates(["text"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", rows: int = ROWS, field_rows: int = FIELD_ROWS, n_windows: int = WINDOWS):
    """(Field, (intercept, slope)). Without labels of both kinds the field is empty and the
    intercept is the share of toxic rows."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    train = ws.table(training_rows(docs, labels, text, label, rows), "train")

    def tally(batches):
        for b in batches:
            counts: dict = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                y = int(y > 0)
                for w in words_of(t):
                    for p in parts(w):
                        c = counts.get(p)
                        if c is None:
                            c = counts[p] = [0, 0]
                        c[y] += 1
            # only cues seen in toxic text can be chosen; totals are told apart under ""
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["cue", "t", "c"])

    counts = train.select("text", "toxic").mapInArrow(tally, "cue string, t long, c long").groupBy("cue").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = ws.table(counts.where("t > 0"), "counts")
    kinds = {int(r[0]): r["count"] for r in train.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    yes, no = kinds.get(1, 0), kinds.get(0, 0)
    if not yes or not no:
        return Field([]), (math.log((yes + 0.5) / (no + 0.5)), 0.0)
    total = counts.where("cue like 'w:%'").agg(F.sum("t"), F.sum("c")).first()
    toxic, clean = int(total[0]), max(1, int(total[1]), int(total[0] * no / yes))
    # those of at most ``rows`` rows, so their number doesn't grow with the corpus
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    cues = sorted(r["cue"] for r in counts.where((F.col("t") >= LEAST) & (odds >= ODDS)).select("cue").collect())
    field = Field(cues)
    some = F.col("h") <= min(1.0, field_rows / (yes + no))

    def windows(batches):
        for b in batches:
            out = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws_ = words_of(t)
                cs = [field.cues_of(w) for w in ws_]
                hot, k = [i for i, c in enumerate(cs) if c], 0
                while k < len(hot):
                    a = z = hot[k]
                    k += 1
                    while k < len(hot) and hot[k] - z <= 2 * EDGE and hot[k] - a < 40:
                        z = hot[k]
                        k += 1
                    lo, hi = max(0, a - EDGE), min(len(ws_), z + EDGE + 1)
                    out.append(([[int(c) for c in x] for x in cs[lo:hi]], [int(bool(x) and y > 0) for x in cs[lo:hi]]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.list_(pa.int32()))), pa.array([o[1] for o in out], pa.list_(pa.int32()))], ["cues", "tags"])

    found = ws.table(train.where(some).select("text", "toxic").mapInArrow(windows, "cues array<array<int>>, tags array<int>"), "windows")
    n = found.count()
    if n > n_windows:
        found = found.where(F.rand(17) < n_windows / n)
    got = found.collect()
    field.fit([(r["cues"], r["tags"]) for r in got])

    def sums(batches):
        tagger = Tagger(field)
        for b in batches:
            x = [math.log(1e-3 + sum(m for _, m in tagger.marginals(words_of(t)))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([round(v, 1) for v in x], pa.float64()), b.column(1).cast(pa.int32())], ["x", "toxic"])

    points = train.select("text", "toxic").mapInArrow(sums, "x double, toxic int").groupBy("x").agg(F.sum((F.col("toxic") > 0).cast("int")).alias("y"), F.count("*").alias("n")).collect()
    return field, _logistic([(r["x"], r["y"], r["n"]) for r in points])


def _logistic(points: list[tuple[float, int, int]], ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton's method; points: x, positives, rows."""
    x, y, n = (np.array(c, float) for c in zip(*sorted(points)))
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n * p - y) + ridge * beta
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge * np.eye(2), grad)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def tag(docs: DataFrame, model, text: str = "text", keep: str = "doc_id", likely: float = 0.5) -> DataFrame:
    """(doc_id, score, spans) for every row; spans: start, end (code points) and probability
    of the tokens that are likely toxic. Null and empty texts have the score of a text
    without cues. Rows stay apart, also with equal or null ids."""
    field, (base, slope) = model

    def work(batches):
        tagger = Tagger(field)
        for b in batches:
            score, spans = [], []
            for t in b.column(1).to_pylist():
                got = tagger.marginals(words_of(t))
                x = base + slope * math.log(1e-3 + sum(m for _, m in got))
                score.append(1 / (1 + math.exp(-max(-500.0, min(500.0, x)))))
                hot, own = {i: m for i, m in got if m >= likely}, []
                if hot:
                    place = _places(t)
                    own = [{"start": place[i][0], "end": place[i][1], "p": m} for i, m in hot.items()]
                spans.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))], [keep, "score", "spans"])

    return docs.select(keep, text).mapInArrow(work, f"`{keep}` {dict(docs.dtypes)[keep]}, score double, spans array<struct<start:int,end:int,p:double>>")


def _places(text: str) -> list[tuple[int, int]]:
    """Offsets of the words in the text as it is, also where lower case is longer."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _WORD.finditer(low)]
    back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(back[m.start()], back[m.end() - 1] + 1) for m in _WORD.finditer(low)]


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_spans for every row; null, empty and
    wordless texts have the score of a text without cues; without labels of both kinds all
    rows have the same score; rows without an id aren't held out."""
    scored = tag(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
