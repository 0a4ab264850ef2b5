"""Cross-tokenizer alignment against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import PROSE
from folioquery.llm import alignment as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


    return lambda token: decoders.ByteLevel().decode([token]), None


def groups_of(sides, text):
    if not text:
        return []
    t, sp = sides
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    e = t.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(shown[c] for c in w)) for i, w in zip(e.ids, e.tokens)]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return []
    def ends(side):
        at = 0
        for i, x in side:
            at += len(x)
            yield at, i
    a, b = list(ends(a)), list(ends(b))
    cuts, out = sorted({p for p, _ in a} & {p for p, _ in b}), []
    last = 0
    for c in cuts:
        out.append(([i for p, i in a if last < p <= c], [i for p, i in b if last < p <= c]))
        last = c
    return out


def plain(sides, rows):
    made, n = [], Counter()
    for d, t in rows:
        g = groups_of(sides, t)
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        n.update(set(links))
        made.append((d, g, links))
    top: dict = defaultdict(int)
    for (x, _), c in n.items():
        top[x] = max(top[x], c)
    out = []
    for d, g, links in made:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=str), {(x, y, c, c == top[x]) for (x, y), c in n.items()}


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


BITS = ["a", " ", "  ", "\n", "\t", "the", " the", "Zürich", "漢字", "😀", "<|endoftext|>", "</s>", "<0x0A>", "▁", "　", "xxxxxxxxxxxxxxxx", "1234567", "don't", "ﬁ", "\x00", "."]


def made(seed, n):
    random.seed(seed)
    return [(random.choice([i, i, 1, None]), random.choice([None, ""]) if i % 20 == 0 else "".join(random.choice(BITS) for _ in range(random.randrange(1, 12)))) for i in range(n)]


@pytest.mark.parametrize("pairs", [5, 20_000_000])
def test_equals_plain_version(spark, sides, monkeypatch, pairs):
    monkeypatch.setattr(A, "PAIRS_A_TASK", pairs)  # many deals for a stripe, or one
    rows = made(1, 400) + [(7, PROSE), (7, PROSE), (8, "ab" * 3000), (9, " ".join(["x" * 700, "y" * 701]))]
    df = spark.createDataFrame([(*r, 0, "z", b"") for r in rows], "doc_id long, text string, part int, stripe string, links binary").repartition(5)
    got, pairs_found = A.align(df)
    want, want_pairs = plain(sides, rows)
    assert as_rows(got) == want
    assert {tuple(r) for r in pairs_found.collect()} == want_pairs


def test_whole_table(spark, sides):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert as_rows(A.alignment_query(df)) == plain(sides, rows)[0]


@pytest.mark.parametrize(("wide", "links"), [(0, 3), (0, 1 << 21), (50, 7), (4096, 2)])
def test_pairs_of_wide_groups(sides, monkeypatch, wide, links):
    monkeypatch.setattr(A, "WIDE", wide)
    monkeypatch.setattr(A, "LINKS", links)
    texts = [t or "" for _, t in made(3, 60)]
    g = A.Groups(A._pair(None, None), texts)
    keys, n = g.pairs()
    got = {(int(k) >> 47, int(k) >> 31 & 0xFFFF, int(k) & (1 << 31) - 1): int(m) for k, m in zip(keys, n)}
    want = Counter((x, y, d) for d, t in enumerate(texts) for xs, ys in groups_of(sides, t) for x in xs for y in ys)
    assert got == want and (np.diff(keys) > 0).all()


def test_either_library_gives_the_same_ids(sides, monkeypatch):
    pair = A._pair(None, None)
    texts = [t for _, t in made(11, 300) if t] + ["<|endoftext|>" * 9, "word " * 25_000, " " * 300_000 + "end"]
    got = [pair.ids_a(t).tolist() for t in texts]
    monkeypatch.setattr(A, "LONG", 0)
    assert got == [pair.ids_a(t).tolist() for t in texts]


def test_parts_keep_every_row(monkeypatch):
    monkeypatch.setattr(A, "PART_CHARS", 10)
    texts = ["", "a" * 30, "bb", "", "c" * 9, "d"]
    assert [x for s, e in A._parts(texts) for x in range(s, e)] == list(range(6))
    assert list(A._parts([])) == []


def test_edges_and_empty_table(spark, sides, edge, empty):
    got = as_rows(A.alignment_query(edge))
    assert got == plain(sides, [(r["doc_id"], r["text"]) for r in edge.collect()])[0]
    assert A.alignment_query(empty).count() == 0
