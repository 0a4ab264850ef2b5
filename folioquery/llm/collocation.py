"""Phrase collocations by hashed passes over the corpus.

Pass k counts phrases of k words exactly, and in the same reading counts the buckets that
phrases of k + 1 words hash to. A bucket below the least count holds no frequent phrase.
So pass k + 1 looks only at phrases whose bucket reached it and whose two parts of k
words are frequent; the latter is asked of a bit array of the exact result of pass k.
Both bit arrays have BUCKETS bits whatever the input, and are all that is broadcast. They
can only let too much through; what they let through is counted by its text.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.grams import blocks, spots
from folioquery.plans.workspace import Workspace

LEAST, LONGEST, TOP = 30, 4, 2000
#: Bits of a broadcast array, 2 MB; a task's counts are 64 MB. A power of two.
BUCKETS, STRIPE = 1 << 24, 1 << 16
#: Copies of each word's count in the join with two-word phrases, as words can be in very many.
SALTS = 16
_RAW = "lang string, phrase string, n long, stripe int, idx binary, cnt binary"
_NAMES = ["lang", "phrase", "n", "stripe", "idx", "cnt"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _read(batch: pa.RecordBatch, ahead: int):
    """Blocks of a batch of (lang, text), each with its languages' names and salts."""
    coded = batch.column(0).dictionary_encode()
    names = coded.dictionary.to_pylist()
    salts = _salts(names)
    for b in blocks(batch.column(1), coded.indices.to_numpy(zero_copy_only=False), ahead):
        yield b, coded.dictionary, salts[b.lang]


def _striped(counts: np.ndarray, most: int):
    """Rows (stripe, idx, cnt) of bucket counts, cut off at ``most``; few are listed, many lie side by side."""
    kind = np.uint8 if most < 256 else np.uint32
    counts = np.minimum(counts, most).astype(kind)
    for s in range(0, len(counts), STRIPE):
        part = counts[s : s + STRIPE]
        at = np.flatnonzero(part)
        if len(at) * 3 < len(part):
            if len(at):
                yield s // STRIPE, at.astype(np.uint16).tobytes(), part[at].tobytes()
        else:
            yield s // STRIPE, b"", part.tobytes()


def _batch(rows: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows[c] if c in rows else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _stripe_batches(found):
    for s, idx, cnt in found:
        yield _batch({"stripe": pa.array([s], pa.int32()), "idx": pa.array([idx], pa.binary()), "cnt": pa.array([cnt], pa.binary())}, 1)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_pass(docs: DataFrame, k: int, last: bool, least: int, buckets: int, bucket_bits=None, part_bits=None) -> DataFrame:
    """One reading of docs(lang, text): rows (lang, phrase, n) of phrases of k words, summed by
    block, and rows (stripe, idx, cnt) of the buckets of k + 1 words.

    bucket_bits, part_bits: broadcast bit arrays for k words and for their parts of k - 1.
    """

    def work(batches):
        counts = None if last else np.zeros(buckets, np.uint32)
        for batch in batches:
            for b, names, salt in _read(batch, LONGEST):
                good, halves = b.grams(k)
                n = len(good)
                if part_bits is not None:
                    parts = _has(part_bits.value, spots(b.grams(k - 1)[1][0], salt[: n + 1], buckets))
                    good &= parts[:-1] & parts[1:]
                    good[good] = _has(bucket_bits.value, spots(halves[0][good], salt[:n][good], buckets))
                if counts is not None and n > 1:
                    more, (longer, _) = b.grams(k + 1)
                    more &= good[:-1] & good[1:]
                    more[b.core :] = False
                    np.add.at(counts, spots(longer[more], salt[: n - 1][more], buckets).astype(np.int64), 1)
                good[b.core :] = False
                at = np.flatnonzero(good)
                if len(at):
                    yield _counted(b, names, at, k, halves, salt)
        if counts is not None:
            yield from _stripe_batches(_striped(counts, least))

    return docs.mapInArrow(work, _RAW)


def _counted(b, names: pa.Array, at: np.ndarray, k: int, halves: list, salt: np.ndarray) -> pa.RecordBatch:
    """Phrases of a block with how often they occur in it; equal are those whose two names are."""
    key = halves[0][at] + salt[at]
    order = np.argsort(key, kind="stable")
    key, second, at = key[order], (halves[1][at] + salt[at])[order], at[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (second[1:] != second[:-1])])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(at)]]))
    rows = {"lang": names.take(pa.array(b.lang[at[first]])), "phrase": b.strings(at[first], k), "n": pa.array(n, pa.int64())}
    return _batch(rows, len(first))


def _bits(striped: DataFrame, least: int, buckets: int):
    """Broadcast bit array of the buckets whose counts add up to ``least`` or more. The sum of
    a stripe is taken row by row; the driver gets buckets / 8 bytes."""
    kind = np.uint8 if least < 256 else np.uint32
    size = min(STRIPE, buckets)

    def work(batches):
        now, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["stripe", "bits"])
        for b in batches:
            for s, idx, cnt in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if s != now:
                    if now is not None:
                        yield done()
                    now, total = s, np.zeros(size, np.int64)
                c = np.frombuffer(cnt.as_buffer(), kind)
                if len(c) == size:
                    total += c
                else:
                    total[np.frombuffer(idx.as_buffer(), np.uint16)] += c
        if now is not None:
            yield done()

    rows = striped.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(work, "stripe int, bits binary").collect()
    out = np.zeros(max(buckets // 8, 1), np.uint8)
    for r in rows:
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["stripe"] * size // 8 :][: len(part)] = part
    return striped.sparkSession.sparkContext.broadcast(out)


def _phrase_bits(phrases: DataFrame, k: int, buckets: int):
    """Bit array of the buckets of phrases(lang, phrase) of k words."""

    def work(batches):
        counts = np.zeros(buckets, np.uint8)
        for batch in batches:
            for b, _, salt in _read(batch, LONGEST):
                good, halves = b.grams(k)
                counts[spots(halves[0][good], salt[: len(good)][good], buckets).astype(np.int64)] = 1
        yield from _stripe_batches(_striped(counts, 1))

    marked = phrases.select("lang", "phrase").mapInArrow(work, _RAW)
    return _bits(marked.select("stripe", "idx", "cnt"), 1, buckets)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, ws: Workspace | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, a) of phrases of 1, 2, .. ``longest`` words that occur ``least`` times
    or more in docs(lang, text), and (lang, n) of all word occurrences."""
    ws = ws or Workspace(docs.sparkSession, "phrases")
    tables, bucket_bits, part_bits, totals = [], None, None, None
    for k in range(1, longest + 1):
        raw = ws.table(count_pass(docs, k, k == longest, least, buckets, bucket_bits, part_bits), f"pass{k}")
        counted = raw.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        if k == 1:
            totals = ws.table(raw.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        tables.append(ws.table(counted.where(F.col("a") >= least), f"words{k}"))
        if k < longest:
            bucket_bits = _bits(raw.where("stripe is not null").select("stripe", "idx", "cnt"), least, buckets)
            part_bits = _phrase_bits(tables[-1], k, buckets)
        ws.drop(raw)
    return tables, totals


def _slice(start: int, n: int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, n), " ")


def _exact(c) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(tables: list[DataFrame], ws: Workspace) -> list[DataFrame]:
    """For phrases of 2, 3, .. words: (lang, phrase, a, l, r, score) of the lowest-scoring cut. Each
    length takes the counts of its parts from the two phrases that are one word shorter. All joins
    are merges: a table's size on disk doesn't show its copies, and a broadcast is built in the driver."""
    out, held = [], None
    for k in range(2, len(tables) + 1):
        c = tables[k - 1].select("lang", "phrase", "a", _slice(1, k - 1).alias("head"), _slice(2, k - 1).alias("tail"))
        if k == 2:
            salted = tables[0].select("lang", F.col("phrase").alias("part"), F.array(F.col("a")).alias("counts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            c = c.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
            short = {"heads": salted, "tails": salted}
        else:
            short = {side: held.select("lang", F.col("phrase").alias("part"), F.concat(F.col(side), F.array("a")).alias("counts")) for side in ("heads", "tails")}
        for side, part in (("heads", "head"), ("tails", "tail")):
            on = ["lang", part, *(["salt"] if k == 2 else [])]
            c = c.join(short[side].withColumnsRenamed({"part": part, "counts": side}).hint("merge"), on)
        # heads: counts of the first 1, 2, .. k - 1 words; tails: of the last 1, 2, .. k - 1
        held = ws.table(c.select("lang", "phrase", "a", "heads", "tails"), f"parts{k}")
        a = "cast(a as decimal(20,0)) * 2000000"
        cuts = ", ".join(
            f"struct(({a}) div (cast(heads[{i - 1}] as decimal(20,0)) + cast(tails[{k - i - 1}] as decimal(20,0))) as score, {i} as k, heads[{i - 1}] as l, tails[{k - i - 1}] as r)" for i in range(1, k)
        )
        out.append(held.select("lang", "phrase", "a", F.expr(f"array_min(array({cuts}))").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score.

    A phrase inside a longer frequent one with at least 80 % of its count is left out. As
    counts never grow with the length, the longer ones by one word decide.

    Null texts are empty, a null language is ``und``; repeated rows count each time; other
    columns are ignored; an empty table gives an empty table. Texts of any length count whole.
    """
    if buckets & (buckets - 1) or buckets < 8:
        raise ValueError("buckets: a power of two, 8 at least")
    spark = docs.sparkSession
    ws = Workspace(spark, "collocations")
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    tables, totals = frequent(rows, least, longest, buckets, ws)
    by_length = scored(tables, ws)
    kept = None
    for k, c in enumerate(by_length, 2):
        if k < longest:
            inside = by_length[k - 1].select("lang", "a", F.explode(F.array(_slice(1, k), _slice(2, k))).alias("phrase"))
            inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
            c = c.join(inside.hint("merge"), ["lang", "phrase"], "left")
            c = c.where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * 80)).drop("longer")
        kept = c if kept is None else kept.unionByName(c)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first ``top`` of each share of a language, then of the language
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def collocation_query(docs: DataFrame) -> DataFrame:
    """The contract's columns; cases as in collocations()."""
    return collocations(docs)


COLLOCATION_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM p, (VALUES (1), (2), (3), (4)) v(k), unnest(range(1, len(w) - k + 2)) t(i) GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, i, a, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y FROM c, unnest(range(1, k)) t(i)),
lx AS MATERIALIZED (SELECT cut.*, gx.f AS l FROM cut JOIN g gx ON gx.lang = cut.lang AND gx.phrase = cut.x),
s AS MATERIALIZED (SELECT lx.lang, lx.phrase, i, a, l, gy.f AS r, CAST(2000000 * a::HUGEINT // (l::HUGEINT + gy.f) AS BIGINT) AS score
  FROM lx JOIN g gy ON gy.lang = lx.lang AND gy.phrase = lx.y),
b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
i AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (2), (3)) v(m), unnest(range(1, k - m + 2)) t(j) WHERE m < k GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN tot ON tot.lang = o.lang WHERE rank <= 2000"""
