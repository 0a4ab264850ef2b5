"""BPE encoding and decoding with a lexicon of the corpus's frequent words.

Words (space-delimited chunks) are counted over all documents. Those with at least
1/``share`` of all counted words, so at most ``share`` of them, are encoded on the
driver and compiled into a minimal acyclic transducer whose file every executor maps
into memory. All other words are merged exactly, so the lexicon changes speed only.
"""

import hashlib
import uuid

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm import lexicon
from folioquery.llm.bytelevel import Encoder, encoder, lexicon_key
from folioquery.plans.workspace import Workspace

SHARE = 50_000
#: Words seen fewer times than this aren't looked at for the lexicon.
SEEN = 20


def frequent_words(docs: DataFrame, text: str = "text", share: int = SHARE, seen: int = SEEN, ws: Workspace | None = None) -> list[str]:
    """Chunks with at least 1/share of all occurrences of chunks seen ``seen`` times or more."""
    ws = ws or Workspace(docs.sparkSession, "words")
    each = docs.select(F.explode(F.split(F.col(text), " ")).alias("word")).where((F.length("word") > 0) & (F.length("word") < 64))
    counts = ws.table(each.groupBy("word").count().where(F.col("count") >= seen), "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [r["word"] for r in counts.where(F.col("count") * share >= total).select("word").collect()]


def ship_lexicon(docs: DataFrame, text: str = "text", path: str | None = None, share: int = SHARE) -> str:
    """Build the lexicon of ``docs`` and hand it to every executor; returns its file name."""
    spark = docs.sparkSession
    ws = Workspace(spark, "lexicon")
    enc = Encoder(encoder_path(path))
    keys = {lexicon_key(" " + w) for w in frequent_words(docs, text, share, ws=ws)}
    words = {k.encode(): enc.raw[k] for k in keys}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(ws.write_bytes(name, lexicon.build(words)))
    return name


def encoder_path(path: str | None) -> str:
    import public_tokenizers

    from folioquery.llm.bytelevel import TOKENIZER

    return path or public_tokenizers.path(TOKENIZER)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, share: int = SHARE, keep: str = "doc_id") -> DataFrame:
    """(doc_id, ids binary, decoded string) for every row; ids as little-endian u32.

    Null texts count as empty. Rows stay apart, also with equal or null ids; other
    columns are ignored; an empty table gives an empty table.
    """
    return _run(docs, text, path, share, keep, f"`{keep}` {dict(docs.dtypes)[keep]}, ids binary, decoded string", lambda ids, enc: ([ids, enc.decode(ids)]))


def _run(docs, text, path, share, keep, schema, make):
    name = ship_lexicon(docs, text, path, share)
    n_out = len(schema.split(", ")) - 1

    def work(batches):
        enc = encoder(path, SparkFiles.get(name))
        for b in batches:
            rows = [make(enc.encode(t), enc) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[] for _ in range(n_out)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, kinds[i]) for i, c in enumerate(cols)]], names)

    import re

    names = [re.sub("`", "", s.strip().split(" ")[0]) for s in schema.split(", ")]
    arrow = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}
    kinds = [arrow[s.strip().split(" ")[1]] for s in schema.split(", ")[1:]]
    return docs.select(keep, text).mapInArrow(work, schema)


def _digest(ids: bytes, enc: Encoder) -> list:
    return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()]


def bpe_query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; cases as in encode()."""
    kind = dict(docs.dtypes)["doc_id"]
    return _run(docs, "text", path, SHARE, "doc_id", f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digest)
