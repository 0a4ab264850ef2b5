"""Encoding, the token store and token counts against the libraries."""

import hashlib
import math
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from folioquery.llm import bpe, lexicon, token_count, token_store
from folioquery.llm.bytelevel import Encoder, merge

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", " ", "  ", "\n", "\t", "\r\n", " \n", "'s", "<|endoftext|>", "é", "ß", "漢字", "😀", "​", "\x1c", "\x85", "12", "½", "_", "...", "the", " the", "aaaaaaaa", "́", "﻿", "᠎", " ", "'ll", " '", "\x00", "▁", "in", "<unk>", "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n=400, most=14):
    random.seed(seed)
    return ["".join(random.choice(PIECES) for _ in range(random.randrange(most))) for _ in range(n)]


def test_encoder_equals_library(library):
    e, fast = Encoder(PATH), token_store.FastEncoder(PATH)
    for t in [*texts(1), "".join(random.choice("abcdefgh") for _ in range(20_000)), "", " ", "a" * 5000]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids
        assert fast.ids(t) == ids
        assert e.decode(e.encode(t)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "one" + " " * 1_000_000 + "two<|endoftext|>", "the words of " * 9000 + " \u3000" * 500_000 + "end"])
def test_millions_of_blanks(library, text):
    assert token_store.FastEncoder(PATH).ids(text) == library.encode(text, add_special_tokens=False).ids


def test_long_texts_by_either_encoder(library, monkeypatch):
    monkeypatch.setattr(token_store, "LONG", 3)
    fast = token_store.FastEncoder(PATH)
    assert all(fast.ids(t) == library.encode(t, add_special_tokens=False).ids for t in texts(7))


def test_long_and_short_merges_agree():
    e = Encoder(PATH)
    random.seed(2)
    for _ in range(50):
        word = [e.first[random.choice(b"abcde ")] for _ in range(random.randrange(1, 190))]
        from folioquery.llm.bytelevel import _merge_long

        assert merge(list(word), e.rank) == _merge_long(list(word), e.rank) == e.merge_piece(b"".join(e.token_bytes[i] for i in word))


def test_lexicon_round_trip(tmp_path):
    random.seed(3)
    words = {"".join(random.choice("abc") for _ in range(random.randrange(1, 9))).encode(): struct.pack("<2I", i, i * 7) for i in range(2000)}
    file = tmp_path / "lexicon"
    file.write_bytes(lexicon.build(words))
    lex = lexicon.Lexicon.open(str(file))
    assert all(lex.get(w) == ids for w, ids in words.items())
    assert lex.get(b"") is None and lex.get(b"abcabcabcabc") is None and lex.get(b"zz") is None
    assert lex.states < sum(map(len, words)) / 2  # suffixes are shared
    assert lexicon.Lexicon(lexicon.build({})).get(b"a") is None


def test_bpe_query(edge, read, library):
    for docs in (edge, read("documents")):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = []
        for d, t in rows:
            ids = library.encode(t, add_special_tokens=False).ids
            raw = struct.pack(f"<{len(ids)}I", *ids)
            want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        got = [tuple(r) for r in bpe.bpe_query(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_general_interface(edge):
    for r in bpe.encode(edge).join(edge.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded == (r.text or "")


def test_frequent_words_are_bounded(spark):
    docs = spark.createDataFrame([(i, "alpha beta " * 20 + f"w{i}") for i in range(30)], "doc_id long, text string")
    assert set(bpe.frequent_words(docs)) == {"alpha", "beta"}
    assert len(bpe.frequent_words(docs, share=1)) <= 1


def expected_store(docs, library):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, len(library.encode(r[1], add_special_tokens=False).ids)))
    out, at = [], 0
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_store_query(edge, read, library):
    for docs in (edge, read("documents")):
        got = [tuple(r) for r in token_store.store_query(docs).collect()]
        assert sorted(got, key=str) == sorted(expected_store(docs, library), key=str)


def test_store_is_the_same_from_any_order(spark, tmp_path):
    """Lost tasks run again, perhaps over rows in another order: every row has the same place."""
    docs = spark.createDataFrame([(1, "one text"), (2, "two texts " * 90), (2, "two texts " * 90), (3, None), (None, "x"), (None, "y")], "doc_id long, text string")
    got = []
    for i, d in enumerate((docs.coalesce(1), docs.repartition(5), docs.orderBy(docs["doc_id"].desc()))):
        token_store.write_store(d, f"file://{tmp_path}/{i}")
        recipes = spark.read.parquet(f"file://{tmp_path}/{i}/recipes").orderBy("part", "place").select("doc_id", "n_tokens", "chunks").collect()
        data = spark.read.parquet(f"file://{tmp_path}/{i}/data").select("kind", "key", "copies").collect()
        got.append((recipes, sorted((r.kind, bytes(r.key), r.copies if r.kind == "recipe" else 1) for r in data)))
    assert got[0] == got[1] == got[2] and len(got[0][0]) == 6


def test_store_round_trip_and_damage(spark, read, library, tmp_path):
    docs = read("documents").union(read("documents").selectExpr("doc_id + 100000", "text", "lang", "source", "n_chars"))
    at = f"file://{tmp_path}/store"
    token_store.write_store(docs, at)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in token_store.read_ids(spark, at).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(text[r.doc_id], add_special_tokens=False).ids + [0]
    chunks = token_store._chunks(spark, at)
    assert chunks.count() == chunks.select("digest").distinct().count()  # copies are stored once
    recipes = spark.read.parquet(f"{at}/recipes")
    assert recipes.selectExpr("explode(chunks)").count() > chunks.count()
    for f in (tmp_path / "store" / "manifest").glob("part-*"):
        f.unlink()
    spark.read.parquet(f"{at}/recipes").selectExpr("part", "'x' first_id", "1L documents", "1L tokens", "'00' root").limit(1).write.mode("append").parquet(f"{at}/manifest")
    with pytest.raises(ValueError):
        token_store.read_digests(spark, at)


def test_cuts_are_content_defined():
    random.seed(5)
    ids = np.array([random.randrange(50_000) for _ in range(30_000)], np.uint32)
    a, b = token_store.cuts(ids), token_store.cuts(np.concatenate([ids[:100], ids]))
    assert a[-1] == len(ids) and all(token_store.LEAST <= y - x <= token_store.MOST for x, y in zip([0, *a[:-2]], a[:-1]))
    assert len({x + 100 for x in a} & set(b)) > 0.9 * len(a)
    assert token_store.cuts(ids[:0]) == [] and token_store.cuts(ids[:3]) == [3]


def test_cuts_by_few_passes():
    """The hash is the plain sum over the last ids, got by fewer passes than one for each of them."""
    random.seed(9)
    ids = np.array([random.randrange(50_000) for _ in range(300_000)], np.uint32)

    def plain(ids):
        gear, h = token_store._GEAR[ids % 4096] ^ (ids >> 12).astype(np.uint32) * np.uint32(2654435761), np.zeros(len(ids), np.uint32)
        for j in range(token_store.WINDOW):
            h[j:] += gear[: len(ids) - j] << np.uint32(j)
        return h

    def least_time(f):
        took = []
        for _ in range(9):
            start = time.perf_counter()
            f(ids)
            took.append(time.perf_counter() - start)
        return min(took)

    may = set((np.flatnonzero((plain(ids) >> np.uint32(8)) & np.uint32(token_store.MASK) == 0) + 1).tolist())
    got, last = [], 0
    for s in sorted(may):
        if s - last >= token_store.LEAST:
            assert s - last <= token_store.MOST
            got.append(s)
            last = s
    assert token_store.cuts(ids) == got + [len(ids)] * (last < len(ids))
    assert least_time(token_store.cuts) < least_time(plain)


def test_crc_of_joined_parts():
    random.seed(6)
    data = bytes(random.randrange(256) for _ in range(4000))
    for cut in (0, 4, 1000, 3996, 4000):
        a, b = np.array([zlib.crc32(data[:cut])], np.uint32), zlib.crc32(data[cut:])
        assert int(token_store._times(a, token_store._power(np.array([len(data) - cut])))[0]) ^ b == zlib.crc32(data)


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_library(fallback):
    pieces = token_count.vocabulary()
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    c = token_count.Counter(pieces, fallback)
    for s in texts(7, 1500):
        assert c.text(s)[0] == len(t.encode(s).ids), s


def test_count_ties():
    pieces = [("<unk>", 0.0)] + [(p, -1.0) for p in ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bab", "c"]]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    c = token_count.Counter(pieces, False)
    random.seed(8)
    for _ in range(2000):
        s = "".join(random.choice("aabbc d") for _ in range(random.randrange(14)))
        assert c.text(s)[0] == len(t.encode(s).ids)


def test_counts_of_a_model_with_real_scores(spark):
    """Pieces as (piece, log-probability), not in order of rank, unknown piece not first."""
    random.seed(12)
    names = sorted({"".join(random.choice("abcde\u2581é漢") for _ in range(random.randrange(1, 5))) for _ in range(300)})
    pieces = [(p, math.log(random.random() ** 4 + 1e-9)) for p in names]
    pieces.insert(7, ("<unk>", -20.0))
    pieces += [(f"<0x{b:02X}>", -25.0) for b in range(256)]
    for fallback in (True, False):
        t = Tokenizer(models.Unigram(pieces, unk_id=7, byte_fallback=fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
        rows = [(i, "".join(random.choice("abcde  é漢xy😀") for _ in range(random.randrange(40)))) for i in range(300)]
        got = token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), pieces=pieces, unknown=7, byte_fallback=fallback)
        assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(t.encode(s).ids) for i, s in rows}


def test_count_query(edge, empty):
    got = token_count.count_tokens(edge).collect()
    assert len(got) == edge.count()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert token_count.count_tokens(empty).count() == 0
    assert bpe.bpe_query(empty).count() == 0
    assert token_store.store_query(empty).count() == 0
