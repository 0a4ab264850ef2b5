"""Content-addressed store of token ids.

Each document's ids, with an end id, are cut into chunks where a rolling hash of the
last ids says so; equal chunks are stored once, by digest. Folder of a store:

  recipes/   parquet in ascending doc_id order, one file a part: part, place (in the part,
             from 0), doc_id, n_tokens, chunks (digest and length of each chunk, in order)
  data/      parquet: kind=chunk: key (the chunk's digest), payload (little-endian ids, 16
             bits wide if the vocabulary allows, else 32); kind=recipe: the recipes as made,
             keyed by their own hash, and how many documents have each
  manifest/  parquet: part, first_id, documents, tokens, root (Merkle root of the part's
             documents, each leaf the hash of a recipe)

Reading checks every payload against its digest and every part against its root.
"""

import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.bpe import encoder_path
from folioquery.llm.bytelevel import Encoder, encoder
from folioquery.plans.workspace import Workspace

END = 0
#: Chunk lengths in ids: a cut needs MASK bits of the hash of WINDOW ids (a power of 2) to be zero.
LEAST, MOST, WINDOW, MASK = 64, 4096, 16, 0xFF
_POLY = 0xEDB88320
#: Texts of more characters go to the exact encoder by chunks: the whole-text encoder's
#: pattern engine runs out of stack on a million blanks in a row.
LONG = 100_000


class FastEncoder:
    """The tokenizer file's vocabulary, merges and special tokens run by a library's whole-text
    encoder: ids in order of merges are its ranks. Texts over LONG characters go to Encoder."""

    def __init__(self, path: str):
        own = Encoder(path)
        self.path = path
        self.plain = own.library.encode_ordinary
        self.special, self.parts = own.special, own._special

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) > LONG:
            return np.frombuffer(encoder(self.path).encode(text), "<u4").tolist()
        if self.parts is None or not self.parts.search(text):
            return self.plain(text)
        return [i for k, p in enumerate(self.parts.split(text)) for i in ([self.special[p]] if k % 2 else self.plain(p))]


_held: dict = {}


def _encoder(path: str | None) -> FastEncoder:
    key = encoder_path(path)
    if key not in _held:
        _held[key] = FastEncoder(key)
    return _held[key]


_GEAR = np.frombuffer(b"".join(hashlib.blake2b(i.to_bytes(4, "little"), digest_size=4, person=b"gear").digest() for i in range(4096)), "<u4")


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids. Depends on these ids only."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    gear = _GEAR[ids % 4096] ^ (ids >> 12).astype(np.uint32) * np.uint32(2654435761)
    h, j = gear, 1
    while j < WINDOW:  # sums over j ids, each shifted by its distance; two of them give those over 2 * j
        h[j:] += h[:-j] << np.uint32(j)
        j *= 2
    spots = np.flatnonzero((h >> np.uint32(8)) & np.uint32(MASK) == 0) + 1
    out, last = [], 0
    for s in spots.tolist():
        while s - last > MOST:
            last += MOST
            out.append(last)
        if s - last >= LEAST:
            out.append(s)
            last = s
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _pieces(ids: list[int], width: int):
    """(digest, count, payload) of each chunk."""
    a = np.frombuffer(array("I", ids), np.uint32)
    data = a.astype(f"<u{width}").tobytes()
    start = 0
    for end in cuts(a):
        payload = data[start * width : end * width]
        yield hashlib.blake2b(payload, digest_size=16).digest(), end - start, payload
        start = end


def _width(path: str | None) -> int:
    import json

    with open(encoder_path(path), encoding="utf-8") as f:
        whole = json.load(f)
    top = max([*whole["model"]["vocab"].values(), *[t["id"] for t in whole["added_tokens"]]])
    return 2 if top < 1 << 16 else 4


def _leaf(doc_id, n: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"\0" + repr(doc_id).encode() + b":%d:" % n + b"".join(digests)).digest()


class _Merkle:
    """Root over leaves in order, holding one hash a level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, h: bytes) -> None:
        for i, x in enumerate(self.levels):
            if x is None:
                self.levels[i] = h
                return
            h = hashlib.sha256(b"\1" + x + h).digest()
            self.levels[i] = None
        self.levels.append(h)

    def root(self) -> bytes:
        top = b""
        for x in self.levels:
            if x is not None:
                top = hashlib.sha256(b"\1" + x + top).digest() if top else x
        return top


def write_store(docs: DataFrame, folder: str, text: str = "text", path: str | None = None) -> None:
    """Encode whole texts (null: empty) once and write the store.

    Repeated ids are separate recipes. Null ids come first. Each task sends a chunk on
    once; one shuffle drops the copies from different tasks. Keys are made from the rows
    alone, so a task that runs again sends each row where it went before.
    """
    width = _width(path)
    kind = dict(docs.dtypes)["doc_id"]
    listed = pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())]))

    def work(batches):
        enc, seen = _encoder(path), set()
        for b in batches:
            key, payload, ids_of, n, chunks = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, own = enc.ids(t), []
                ids.append(END)
                for digest, k, p in _pieces(ids, width):
                    own.append({"digest": digest, "n": k})
                    if digest not in seen:
                        if len(seen) >= 500_000:  # forgets; the shuffle finds the rest
                            seen.clear()
                        seen.add(digest)
                        for col, v in zip((key, payload, ids_of, n, chunks), (digest, p, None, None, None)):
                            col.append(v)
                for col, v in zip((key, payload, ids_of, n, chunks), (_leaf(d, len(ids), [c["digest"] for c in own]), None, d, len(ids), own)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.binary()), pa.array(payload, pa.binary()), pa.array(ids_of, b.column(0).type), pa.array(n, pa.int64()), pa.array(chunks, listed)],
                ["key", "payload", "doc_id", "n_tokens", "chunks"],
            )

    made = docs.select("doc_id", text).mapInArrow(work, f"key binary, payload binary, doc_id {kind}, n_tokens bigint, chunks array<struct<digest:binary,n:int>>")
    made = made.withColumn("kind", F.when(F.col("payload").isNull(), "recipe").otherwise("chunk"))
    once = made.repartition("kind", "key").groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in ("payload", "doc_id", "n_tokens", "chunks")], F.count("*").alias("copies"))
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/data")
    recipes = docs.sparkSession.read.schema(once.schema).parquet(f"{folder}/data").where("kind = 'recipe'")
    recipes = recipes.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_tokens", "key", "chunks")
    made = recipes.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "n_tokens", "key")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # its lower bits count the partition's rows
    made.select(F.spark_partition_id().alias("part"), place.alias("place"), "doc_id", "n_tokens", "chunks").write.parquet(f"{folder}/recipes")
    _part_roots(docs.sparkSession.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.schema("key binary, payload binary, kind string").parquet(f"{folder}/data")
    return stored.where("kind = 'chunk'").select(F.col("key").alias("digest"), "payload")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """Merkle roots by part. A part's leaves are hashed where they lie, then ordered and
    joined in one task a part; only 32 bytes a document move."""

    def leaves(batches):
        for b in batches:
            out = [_leaf(d, n, [x["digest"] for x in c]) for d, n, c in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], ["part", "place", "doc_id", "n_tokens", "leaf"])

    def roots(batches):
        part, tree, docs, tokens, first = None, None, 0, 0, None
        for b in batches:
            for p, d, n, leaf in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if p != part:
                    if tree is not None:
                        yield row(part, first, docs, tokens, tree)
                    part, tree, docs, tokens, first = p, _Merkle(), 0, 0, d
                tree.add(leaf)
                docs, tokens = docs + 1, tokens + n
        if tree is not None:
            yield row(part, first, docs, tokens, tree)

    def row(part, first, docs, tokens, tree):
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([None if first is None else str(first)], pa.string()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root().hex()], pa.string())],
            ["part", "first_id", "documents", "tokens", "root"],
        )

    kind = dict(recipes.dtypes)["doc_id"]
    hashed = recipes.select("part", "place", "doc_id", "n_tokens", "chunks").mapInArrow(leaves, f"part int, place bigint, doc_id {kind}, n_tokens bigint, leaf binary")
    ordered = hashed.repartition("part").sortWithinPartitions("part", "place")
    return ordered.mapInArrow(roots, "part int, first_id string, documents bigint, tokens bigint, root string")


def _payload_table(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """(digest, n, crc) of every stored chunk, checked; crc of its ids as 32-bit integers."""

    def work(batches):
        for b in batches:
            d, p = b.column(0).to_pylist(), b.column(1).to_pylist()
            n, crc = [], []
            for digest, payload in zip(d, p):
                if hashlib.blake2b(payload, digest_size=16).digest() != digest:
                    raise ValueError("a stored chunk doesn't match its digest")
                a = np.frombuffer(payload, f"<u{width}")
                n.append(len(a))
                crc.append(zlib.crc32(a.astype("<u4").tobytes() if width == 2 else payload))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return _chunks(spark, folder).mapInArrow(work, "digest binary, n int, crc bigint")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of CRC-32 polynomials, bits reflected."""
    out, a, b = np.zeros_like(a), a.copy(), b.copy()
    for _ in range(32):
        out ^= np.where(a & np.uint32(1 << 31), b, np.uint32(0))
        a <<= np.uint32(1)
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(_POLY), b >> np.uint32(1))
    return out


def _power(n: np.ndarray) -> np.ndarray:
    """x ** (8 * n) by squaring."""
    out, base, n = np.full(len(n), 1 << 31, np.uint32), np.full(1, 1 << 23, np.uint32), n.astype(np.int64)
    while n.any():
        out = np.where(n & 1, _times(out, np.broadcast_to(base, out.shape)), out)
        base, n = _times(base, base), n >> 1
    return out


def read_digests(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every recipe, from the files alone.

    The CRC of a document is joined from the CRCs of its chunks, each read and checked
    once, shifted by what follows it. A missing or wrong chunk or part is an error.
    """
    written = spark.read.parquet(f"{folder}/recipes")
    parts = spark.read.parquet(f"{folder}/manifest")
    now = _part_roots(written).select("part", F.col("root").alias("now"))
    broken = parts.join(now, "part", "full").where(F.col("now").isNull() | F.col("root").isNull() | (F.col("now") != F.col("root")))
    if broken.limit(1).count():
        raise ValueError("a part doesn't match its Merkle root")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    offset = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    starts = written.select("part", "place", "doc_id", "n_tokens", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("at"))
    starts = starts.join(offset, "part").select("part", "place", "doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens")

    def chunks(batches):
        for b in batches:
            listed = b.column(2)
            size, flat = listed.value_lengths().to_numpy(), listed.flatten()
            n = flat.field("n").to_numpy().astype(np.int64)
            ends, upto = np.cumsum(size), np.cumsum(n)
            last = np.repeat(upto[ends - 1], size) if len(n) else n
            row = np.repeat(np.arange(len(size)), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), flat.field("digest"), flat.field("n"), pa.array(last - upto)], ["part", "place", "digest", "k", "after"])

    each = written.select("part", "place", "chunks").mapInArrow(chunks, "part int, place bigint, digest binary, k int, after bigint")
    joined = each.join(_payload_table(spark, folder, _width(path)), "digest", "left")

    def shift(batches):
        for b in batches:
            part, place, k, after, n, crc = b.columns
            if crc.null_count or k.cast(pa.int64()) != n.cast(pa.int64()):
                raise ValueError("a recipe names a chunk that isn't stored as such")
            v = _times(crc.to_numpy(zero_copy_only=False).astype(np.uint32), _power(4 * after.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([part, place, pa.array(v.astype(np.int64))], ["part", "place", "v"])

    moved = joined.select("part", "place", "k", "after", "n", "crc").mapInArrow(shift, "part int, place bigint, v bigint")
    crc = moved.groupBy("part", "place").agg(F.bit_xor("v").alias("ids_crc32"))
    return starts.join(crc, ["part", "place"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary) of every recipe: chunks joined back in order, as 32-bit integers."""
    width = _width(path)
    rows = spark.read.parquet(f"{folder}/recipes").select("doc_id", "part", "place", F.posexplode("chunks").alias("i", "c"))
    chunks = _chunks(spark, folder)
    full = rows.select("part", "place", "doc_id", "i", F.col("c.digest").alias("digest")).join(chunks, "digest")
    whole = full.groupBy("part", "place", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "payload"))), lambda x: x["payload"]).alias("p"))

    def work(batches):
        for b in batches:
            out = [np.frombuffer(b"".join(p), f"<u{width}").astype("<u4").tobytes() for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    kind = dict(rows.dtypes)["doc_id"]
    return whole.select("doc_id", "p").mapInArrow(work, f"doc_id {kind}, ids binary")


def store_query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write a store of whole texts and read (doc_id, start, n_tokens, ids_crc32) back from
    its files. Null and empty texts have the end id alone; rows that share an id each have a
    place of their own, null ids first; an empty table gives an empty table."""
    ws = Workspace(docs.sparkSession, "token-store")
    write_store(docs, ws.root, path=path)
    return read_digests(docs.sparkSession, ws.root, path)
