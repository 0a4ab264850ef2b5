"""Collocations against a plain version; the SQL twin is tested with the others."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from folioquery.llm import collocation as C
from folioquery.llm import grams


def words_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def counted(texts, longest=4):
    return Counter(tuple(w[i : i + k]) for t in texts for w in words_of(t) for k in range(1, longest + 1) for i in range(len(w) - k + 1))


def plain(rows, least, top):
    out = []
    named = [("und" if la is None else la, t) for la, t in rows]
    for lang in {la for la, _ in named}:
        f = counted([t for la, t in named if la == lang])
        n = sum(v for p, v in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for q, a in cand.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inside[q[i : i + m]] = max(inside[q[i : i + m]], a)
        best = []
        for p, a in cand.items():
            if 100 * inside[p] >= 80 * a:
                continue
            s, _, la, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), la, r))
        best.sort()
        out += [(lang, i, b[2].decode(), -b[1], b[3], b[4], n, -b[0]) for i, b in enumerate(best[:top], 1)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(seed, n):
    random.seed(seed)
    bits = ["a", "B", "b", "c", "of the", "new\tyork", "é", "漢", "\x0c", ".", "x!", " ", " ", "\xa0", "red  green blue", ""]
    return [(random.choice(["en", "en", "de", None, "und", ""]), " ".join(random.choice(bits) for _ in range(random.randrange(30)))) for _ in range(n)]


@pytest.mark.parametrize("buckets", [8, 1 << 12, 1 << 18])
def test_equals_plain_version(spark, buckets):
    rows = made(buckets, 500) + [("en", None), ("en", ""), ("fr", "one two " * 3000), ("en", "Very Long " * 5 + "y" * 60_000)]
    df = spark.createDataFrame([(*r, 0, 0, "z") for r in rows], "lang string, text string, n long, stripe int, phrase string").repartition(3)
    assert as_rows(C.collocations(df, least=6, top=40, buckets=buckets)) == plain(rows, 6, 40)


@pytest.mark.parametrize("block", [16, 64, 1 << 22])
def test_blocks_count_each_phrase_once(block):
    texts = [t for _, t in made(5, 60)] + ["alpha beta gamma delta " * 200, None, "", "z" * 300, "no, " * 50]
    for k in (1, 2, 3, 4):
        got = Counter()
        for b in grams.blocks(pa.array(texts), np.zeros(len(texts), np.int32), 4, block):
            good, _ = b.grams(k)
            good[b.core :] = False
            got.update(tuple(s.split(" ")) for s in b.strings(np.flatnonzero(good), k).to_pylist())
        assert got == Counter({p: n for p, n in counted(texts).items() if len(p) == k})


def test_names_differ_where_phrases_do():
    texts = [t for _, t in made(9, 300)] + ["ab c", "a bc", "abc", "a\x01", "a"]
    for k in (1, 2, 3):
        seen: dict = {}
        for b in grams.blocks(pa.array(texts), np.zeros(len(texts), np.int32), 4):
            good, (x, y) = b.grams(k)
            at = np.flatnonzero(good)
            for s, name in zip(b.strings(at, k).to_pylist(), zip(x[at].tolist(), y[at].tolist())):
                assert seen.setdefault(s, name) == name
        assert len(set(seen.values())) == len(seen)


def test_large_counts_score_exactly(spark):
    from folioquery.plans.workspace import Workspace

    big = 4_611_686_018_427_387_905
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], "lang string, phrase string, a long")
    two = spark.createDataFrame([("en", "a b", big - 2)], "lang string, phrase string, a long")
    got = C.scored([one, two], Workspace(spark, "t"))[0].first()
    assert got["score"] == 2000000 * (big - 2) // (2 * big + 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert C.collocation_query(df).count() == 0


def test_phrase_tables_are_not_broadcast(spark, monkeypatch):
    """Small files can hold many phrases, and the two-word join repeats each word's row."""
    plans = []
    table = C.Workspace.table

    def seen(self, df, name="t"):
        if name.startswith("parts"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, name)

    monkeypatch.setattr(C.Workspace, "table", seen)
    docs = spark.createDataFrame([("en", "a b c d e")] * 5, "lang string, text string")
    C.collocations(docs, least=2, buckets=1 << 10)
    assert len(plans) == 3
    for plan in plans:
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
