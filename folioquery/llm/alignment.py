"""Tokens of two tokenizers aligned by bytes, and how often their ids meet in the corpus.

A text's tokens of either side cover the same bytes. Where tokens of both end, a group
ends; every pair of an A and a B token of one group is linked. A pair of ids counts the
documents that have it linked.

  1. Documents are encoded where they lie. A task writes each document's own figures and its
     distinct pairs, sorted by A id and cut by stripes of STRIPE ids of that side.
  2. Pairs are dealt by stripe. A task adds them up in a dense matrix of STRIPE rows, whose size
     depends on the vocabularies alone; nonzero cells are written.
  3. The same deal brings each stripe's cells and its pairs together again: maxima of the rows
     say which B ids are best, and the pairs' figures are summed by document.

A stripe with more than PAIRS_A_TASK pairs is dealt by part of the corpus as well; its
partial matrices are added before step 3. Rows are streamed, so a task holds one matrix.
"""

import hashlib
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.bytelevel import TOKENIZER, byte_alphabet, encoder
from folioquery.llm.token_count import VOCABULARY
from folioquery.plans.workspace import Workspace

STRIPE = 64
#: Pairs of a stripe that one task adds up.
PAIRS_A_TASK = 4_000_000
#: Characters and rows of a part, pairs of a row, cells of a row, links made at once.
PART_CHARS, PART_ROWS, ROW_PAIRS, ROW_CELLS, LINKS = 1 << 21, 1 << 16, 1 << 12, 1 << 16, 1 << 21
#: In a group with more links than this each side's equal ids are taken together first.
WIDE = 4096
LONG = 100_000
_SEPARATORS = [b",", b"|", b";", b""]


class Pair:
    """The two tokenizers: ids and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.fast = encoder(path_a).library
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, n = byte_alphabet(), self.a.get_vocab_size()
        entry = lambda t: bytes(map(alphabet.__getitem__, t)) if all(c in alphabet for c in t) else t.encode()
        self.bytes_a = [entry(self.a.id_to_token(i) or "") for i in range(n)]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.written = [str(i).encode() + s for i in range(max(n, len(self.bytes_b))) for s in _SEPARATORS]

    def ids_a(self, text: str) -> np.ndarray:
        """Ids of a space and the text. The same vocabulary in a faster library; texts over LONG characters
        go to the tokenizer's own, as the other's pattern engine stops on a million blanks in a row."""
        if len(text) > LONG:
            return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(" " + text, disallowed_special=())

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Both sides' ids; none where a side doesn't cover exactly a space and the text."""
        some = [i for i, t in enumerate(texts) if t]
        a, b = [np.zeros(0, np.uint32)] * len(texts), [[]] * len(texts)
        for i, y in zip(some, self.b.encode([texts[i] for i in some], num_threads=1)):
            want, x = (" " + texts[i]).encode(), self.ids_a(texts[i])
            if b"".join(map(self.bytes_b.__getitem__, y)) == want and b"".join(map(self.bytes_a.__getitem__, x.tolist())) == want:
                a[i], b[i] = x, y
        return a, b


_held: dict = {}


def _pair(path_a: str | None, path_b: str | None) -> Pair:
    key = (path_a or public_tokenizers.path(TOKENIZER), path_b or public_tokenizers.path(VOCABULARY))
    if key not in _held:
        _held[key] = Pair(*key)
    return _held[key]


def _spread(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Groups:
    """Groups of some documents' tokens, in order."""

    def __init__(self, pair: Pair, texts: list[str]):
        a, b = pair.encode(texts)
        self.n_docs = len(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a = np.concatenate(a).astype(np.int64)
        self.b = np.fromiter((i for x in b for i in x), np.int64, int(self.n_b.sum()))
        ends_a, ends_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[ends_a], in_b[ends_b] = True, True
        self.last_a, self.last_b = in_b[ends_a], in_a[ends_b]  # documents end on both sides
        self.group_a, self.group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        n = int(self.last_a.sum())
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.start_a, self.start_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        self.doc = np.repeat(np.arange(self.n_docs), self.n_a)[self.last_a]
        self.links = self.size_a * self.size_b
        self.n_groups, self.n_links = np.bincount(self.doc, minlength=self.n_docs), np.zeros(self.n_docs, np.int64)
        np.add.at(self.n_links, self.doc, self.links)

    def digests(self, written: list[bytes]) -> list[str]:
        """sha256 of each document's groups as text; '' without tokens."""
        n_a, n_b = len(self.a), len(self.b)
        order = np.empty(n_a + n_b, np.int64)
        order[np.arange(n_a) + self.start_b[self.group_a]] = self.a * 4 + self.last_a
        order[np.arange(n_b) + (self.start_a + self.size_a)[self.group_b]] = self.b * 4 + 2 * self.last_b
        stops = np.cumsum(self.n_a + self.n_b)
        full = stops[self.n_a > 0]
        order[full - 1] += 1  # nothing after a document's last token
        out, at = [], 0
        for stop in stops.tolist():
            out.append(hashlib.sha256(b"".join(map(written.__getitem__, order[at:stop].tolist()))).hexdigest() if stop > at else "")
            at = stop
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (A id, B id, document) as one number each, in order, and their links."""
        keys, weights = [], []
        wide = self.links > WIDE
        a, b, sa, sb = self.a, self.b, self.start_a, self.start_b
        some = np.flatnonzero(~wide)
        edges = np.searchsorted(np.cumsum(self.links[some]), np.arange(LINKS, self.links[some].sum() + LINKS, LINKS), "right")
        at = 0
        for stop in edges.tolist():
            g, at = some[at : max(stop, at)], max(stop, at)
            left = np.repeat(sa[g], self.size_a[g]) + _spread(self.size_a[g])
            width = np.repeat(self.size_b[g], self.size_a[g])
            right = np.repeat(np.repeat(sb[g], self.size_a[g]), width) + _spread(width)
            doc = np.repeat(self.doc[g], self.links[g])
            k, n = np.unique(np.repeat(a[left], width) << 47 | b[right] << 31 | doc, return_counts=True)
            keys.append(k)
            weights.append(n)
        for g in np.flatnonzero(wide).tolist():
            xs, nx = np.unique(a[sa[g] : sa[g] + self.size_a[g]], return_counts=True)
            ys, ny = np.unique(b[sb[g] : sb[g] + self.size_b[g]], return_counts=True)
            step = max(LINKS // len(ys), 1)
            for s in range(0, len(xs), step):
                keys.append(((xs[s : s + step, None] << 47) | (ys << 31) | self.doc[g]).ravel())
                weights.append((nx[s : s + step, None] * ny).ravel())
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys) == 1:
            return keys[0], weights[0]
        k, w = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(k, kind="stable")
        k, w = k[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(w, first)


def _parts(texts: list[str]):
    """(start, end) of runs of whole texts of bounded characters and rows."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (held + len(t) > PART_CHARS or i - start >= PART_ROWS):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


_LINK = "part long, rows int, stripe int, docs binary, a binary, b binary, links binary"
_FIGURES = "row int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _columns(schema: str) -> dict:
    return {n: _ARROW[t] for n, t in (c.split(" ") for c in schema.split(", "))}


def aligned(docs: DataFrame, text: str = "text", keep: str = "doc_id", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Rows of two kinds: figures of each document (kept, part, row, ..), and, with a stripe,
    distinct pairs of a part's documents: place of the document in the part (16 bits), A id
    in the stripe (8), B id (16), links (64; none if each is 1). To be written, and read from there."""
    names = {"kept": None} | _columns(_LINK) | _columns(_FIGURES)

    def batch(rows: dict, n: int, kind) -> pa.RecordBatch:
        types = names | {"kept": kind}
        return pa.RecordBatch.from_arrays([rows[c] if c in rows else pa.nulls(n, t) for c, t in types.items()], names=list(types))

    def work(batches):
        pair, made, task = _pair(path_a, path_b), 0, TaskContext.get().partitionId()
        for got in batches:
            texts = [t or "" for t in got.column(1).to_pylist()]
            for s, e in _parts(texts):
                part, made = task << 32 | made, made + 1
                g, n, kind = Groups(pair, texts[s:e]), e - s, got.column(0).type
                figures = [pa.array(x, pa.int64()) for x in (g.n_a, g.n_b, g.n_groups, g.n_links)]
                own = [pa.array(np.full(n, part)), pa.array(np.arange(n), pa.int32()), *figures, pa.array(g.digests(pair.written))]
                yield batch({"kept": got.column(0).slice(s, n)} | dict(zip(["part", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"], own)), n, kind)
                found = list(_link_rows(*g.pairs()))
                if found:
                    cols = dict(zip(["stripe", "docs", "a", "b", "links"], zip(*found)))
                    rows = {c: pa.array(v, names[c]) for c, v in cols.items()}
                    m = len(found)
                    yield batch(rows | {"part": pa.array(np.full(m, part)), "rows": pa.array(np.full(m, n), pa.int32())}, m, kind)

    kind = dict(docs.dtypes)[keep]
    return docs.select(keep, text).mapInArrow(work, f"kept {kind}, {_LINK}, {_FIGURES}")


def _link_rows(keys: np.ndarray, links: np.ndarray):
    a = keys >> 47
    stripe = a // STRIPE
    cut = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])) if len(keys) else []
    docs, local, b = (keys & (1 << 31) - 1).astype(np.uint16), (a % STRIPE).astype(np.uint8), (keys >> 31 & 0xFFFF).astype(np.uint16)
    for s, e in zip(cut, [*cut[1:], len(keys)]):
        for x in range(s, e, ROW_PAIRS):
            y = min(x + ROW_PAIRS, e)
            n = links[x:y]
            yield int(stripe[s]), docs[x:y].tobytes(), local[x:y].tobytes(), b[x:y].tobytes(), b"" if (n == 1).all() else n.tobytes()


def _of(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _cells(stripe: int, block: np.ndarray):
    at = np.flatnonzero(block)
    for s in range(0, len(at), ROW_CELLS):
        x = at[s : s + ROW_CELLS]
        yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([x.astype(np.uint32).tobytes()], pa.binary()), pa.array([block[x].tobytes()], pa.binary())], names=["stripe", "cells", "counts"])


def _summed(rows: DataFrame, deal: list[str], width: int, add) -> DataFrame:
    """Dense matrices of ``rows``, one for each value of ``deal``, as (stripe, cells, counts)."""

    def work(batches):
        now, block = None, np.zeros(STRIPE * width, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                key = tuple(b.column(j)[i].as_py() for j in range(len(deal)))
                if key != now:
                    if now is not None:
                        yield from _cells(now[0], block)
                        block[:] = 0
                    now = key
                add(block, b.column(len(deal))[i], b.column(len(deal) + 1)[i])
        if now is not None:
            yield from _cells(now[0], block)

    return rows.repartition(*deal).sortWithinPartitions(*deal).mapInArrow(work, "stripe int, cells binary, counts binary")


def _dealt(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link rows with a deal, and each stripe's number of deals: at most one row for each stripe of
    the vocabulary, so it may be broadcast."""
    rows = table.where("stripe is not null").select("stripe", "part", "rows", "docs", "a", "b", "links")
    deals = rows.groupBy("stripe").agg(F.ceil(F.sum(F.octet_length("a")) / PAIRS_A_TASK).alias("deals"))
    rows = rows.join(F.broadcast(deals), "stripe").withColumn("deal", F.pmod(F.xxhash64("part"), F.col("deals"))).drop("deals")
    return rows, deals


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(stripe, cells, counts) over all documents. A cell is A id in the stripe times ``width`` plus B id."""

    def one(block, a, b):
        np.add.at(block, _of(a, np.uint8).astype(np.int64) * width + _of(b, np.uint16), 1)

    def more(block, cells, counts):
        block[_of(cells, np.uint32)] += _of(counts, np.int64)

    partial = _summed(rows.select("stripe", "deal", "a", "b"), ["stripe", "deal"], width, one)
    return _summed(partial, ["stripe"], width, more)


def best_pairs(counts: DataFrame, width: int) -> DataFrame:
    """(a, b, documents, best) of each pair of ids that is ever linked; best: no B id has more for this A id."""

    def work(batches):
        for rows in batches:
            for s, cells, n in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2)):
                cells, n = _of(cells, np.uint32).astype(np.int64), _of(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s * STRIPE + cells // width), pa.array(cells % width), pa.array(n)], names=["a", "b", "documents"])

    each = counts.mapInArrow(work, "a long, b long, documents long")
    top = each.groupBy("a").agg(F.max("documents").alias("top"))
    return each.join(top, "a").select("a", "b", "documents", (F.col("documents") == F.col("top")).alias("best"))


def _scored(rows: DataFrame, deals: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(part, row, n_best, count_sum) of every document with pairs."""
    none = F.lit(None).cast("binary")
    each = counts.join(F.broadcast(deals), "stripe").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    each = each.select("stripe", "deal", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("int").alias("rows"), F.col("cells").alias("x"), F.col("counts").alias("y"), none.alias("b"), none.alias("links"))
    both = each.union(rows.select("stripe", "deal", F.lit(1), "part", "rows", "docs", "a", "b", "links"))
    both = both.repartition("stripe", "deal").sortWithinPartitions("stripe", "deal", "kind")

    def emit(held):
        for part, (best, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([best.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["part", "best", "total"])

    def score(batches):
        now, block, top, held, size = None, np.zeros(STRIPE * width, np.int64), None, {}, 0
        for b in batches:
            for i in range(b.num_rows):
                key = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                x, y = b.column(5)[i], b.column(6)[i]
                if key != now:
                    block[:] = 0
                    now, top = key, None
                if b.column(2)[i].as_py() == 0:
                    block[_of(x, np.uint32)] = _of(y, np.int64)
                    continue
                if top is None:
                    top = block.reshape(STRIPE, width).max(1)
                docs, a, part = _of(x, np.uint16), _of(y, np.uint8), b.column(3)[i].as_py()
                n = block[a.astype(np.int64) * width + _of(b.column(7)[i], np.uint16)]
                m = _of(b.column(8)[i], np.int64)
                m = m if len(m) else np.ones(len(n), np.int64)
                if part not in held:
                    rows_ = b.column(4)[i].as_py()
                    if size + rows_ > 1 << 22:
                        yield from emit(held)
                        held, size = {}, 0
                    held[part], size = (np.zeros(rows_, np.int64), np.zeros(rows_, np.int64)), size + rows_
                best, total = held[part]
                np.add.at(best, docs, m * (n == top[a]))
                np.add.at(total, docs, m * n)
        yield from emit(held)

    def add(batches):
        done = lambda p, x, y: pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p)), pa.array(np.arange(len(x)), pa.int32()), pa.array(x), pa.array(y)], names=["part", "row", "n_best", "count_sum"])
        now, best, total = None, None, None
        for b in batches:
            for p, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                x, y = _of(x, np.int64), _of(y, np.int64)
                if p == now:
                    best, total = best + x, total + y
                    continue
                if now is not None:
                    yield done(now, best, total)
                now, best, total = p, x, y
        if now is not None:
            yield done(now, best, total)

    sums = both.mapInArrow(score, "part long, best binary, total binary").repartition("part").sortWithinPartitions("part")
    return sums.mapInArrow(add, "part long, row int, n_best long, count_sum long")


def align(docs: DataFrame, text: str = "text", keep: str = "doc_id", path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Figures of every row (kept id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256),
    and best_pairs() of the corpus.

    Null and empty texts, and texts that either side doesn't cover exactly, have no tokens: zeros
    and ''. Rows stay apart, also with equal or null ids, each a document of its own in the counts;
    other columns are ignored; an empty table gives empty tables. A text's tokens lie in memory
    at once, however long it is; a group's links never do.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "alignment")
    width = len(_pair(path_a, path_b).bytes_b)
    table = ws.table(aligned(docs, text, keep, path_a, path_b), "aligned")
    rows, deals = _dealt(table)
    deals = ws.table(deals, "deals")
    counts = ws.table(pair_counts(rows, width), "counts")
    sums = _scored(rows, deals, counts, width)
    own = table.where("stripe is null").select("kept", "part", *_columns(_FIGURES))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = own.join(sums, ["part", "row"], "left").select(F.col("kept").alias(keep), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    return out, best_pairs(counts, width)


def alignment_query(docs: DataFrame) -> DataFrame:
    """The contract's columns; cases as in align()."""
    return align(docs)[0]
