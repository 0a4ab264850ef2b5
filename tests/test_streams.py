"""Whole-stream alignment against difflib over the whole streams."""

import difflib
import multiprocessing
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioquery.operators import cards
from folioquery.operators import stream as S
from folioquery.plans import catalog
from folioquery.plans.model import boxes, segments

FOLDER = "/root/testdata/sf0.001"


def plain_runs(a, b):
    return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


@pytest.mark.parametrize("grams", [(2, 4, 9), (3,), (12, 48)])
def test_runs_equal_difflib(monkeypatch, grams):
    monkeypatch.setattr(S, "GRAMS", grams)
    random.seed(len(grams))
    for t in range(1500):
        letters = "ab" if t % 3 else "abc de"
        a = "".join(random.choice(letters) for _ in range(random.randrange(60)))
        b = "".join(random.choice(letters) for _ in range(random.randrange(60))) if t % 2 else a[5:] + random.choice(letters) * 9 + a[:7]
        assert S.common_runs(a, b) == plain_runs(a, b)


def test_repeats_and_unlike_texts():
    assert len(S.common_runs("a" * 20_000, "ab" * 10_000)) == 10_000  # a run a letter
    assert S.common_runs("one two " * 5000, "one two " * 5000) == [(0, 0, 40_000)]
    assert S.common_runs("", "a") == S.common_runs("a", "") == S.common_runs("a", "b") == []


def test_memory_grows_with_the_length():
    random.seed(3)
    words = lambda n, letters: " ".join("".join(random.choice(letters) for _ in range(6)) for _ in range(n))
    a, b = words(20_000, "abcdefghijkl"), words(20_000, "mnopqrstuvwx")
    tracemalloc.start()
    start = time.time()
    got = S.common_runs(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and all(a[i : i + n] == b[j : j + n] for i, j, n in got)
    assert peak < 60e6 and time.time() - start < 120


def laid(rows):
    """Stream of (key, text) rows, and the key and place in its text of each character (blank after it: None)."""
    text, at = "", []
    for k, t in rows:
        text += t + " "
        at += [(k, i) for i in range(len(t))] + [(k, None)]
    return text, at


def by_document(spark, raw):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    segs = segments(docs)
    left, right = defaultdict(list), defaultdict(list)
    langs = {}
    for r in segs.orderBy("doc_id", "seg").collect():
        left[r.doc_id].append((r.seg, r.text.lower() if raw else r.norm))
        langs[r.doc_id] = r.lang
    for r in boxes(segs).orderBy("doc_id", "gold", "box").collect():
        right[r.doc_id].append((len(right[r.doc_id]) + 1, r.text, r.gold))
    return left, right, langs


def runs_of_all(pairs):
    """Plain runs of many pairs of streams, on all cores: each takes seconds."""
    with multiprocessing.get_context("fork").Pool() as pool:
        return pool.starmap(plain_runs, pairs, 1)


@pytest.fixture(scope="module")
def whole(spark):
    """Normalised streams of every document, both sides, with the plain runs."""
    left, right, langs = by_document(spark, False)
    sides = {d: (laid(rows), laid([r[:2] for r in right[d]])) for d, rows in left.items()}
    runs = dict(zip(sides, runs_of_all([(a[0], b[0]) for a, b in sides.values()])))
    return right, langs, sides, runs


def test_owners_equal_a_whole_diff_of_200_documents(spark, whole):
    right, langs, sides, runs = whole
    assert len(sides) == 200
    good, total = Counter(), Counter()
    for d, ((_, at_a), (_, at_b)) in sides.items():
        met = defaultdict(Counter)
        for i, j, n in runs[d]:
            for k in range(n):
                if at_b[j + k][1] is not None:
                    met[at_b[j + k][0]][at_a[i + k][0]] += 1
        for n, _, gold in right[d]:
            total[langs[d]] += 1
            if met[n]:
                owner = min(met[n], key=lambda s: (-met[n][s], s))
                good[langs[d]] += owner == gold
                good[langs[d], "owned"] += 1
    got = {r["lang"]: r for r in catalog.queries()["stream_align_owner"](spark, FOLDER).collect()}
    assert set(got) == set(total)
    for lang, r in got.items():
        assert (r["n_boxes"], r["owned"], r["correct"]) == (total[lang], good[lang, "owned"], good[lang])


def test_word_boxes_equal_a_whole_diff(spark, whole):
    _, _, sides, runs = whole
    got = {r["doc_id"]: tuple(r[1:]) for r in catalog.queries()["word_boxes"](spark, FOLDER).collect()}
    for d, ((a, _), (_, at_b)) in sides.items():
        where = {i + k: at_b[j + k][0] for i, j, n in runs[d] for k in range(n) if at_b[j + k][1] is not None}
        sizes = [len({where[i] for i in range(m.start(), m.end()) if i in where}) for m in re.finditer("[^ ]+", a)]
        assert got[d] == (len(sizes), sizes.count(0), sizes.count(1), sum(s > 1 for s in sizes))


def test_coverage_equals_a_whole_diff(spark):
    left, right, _ = by_document(spark, True)
    sides = {d: (laid(rows)[0], laid([r[:2] for r in right[d]])[0]) for d, rows in left.items()}
    runs = dict(zip(sides, runs_of_all(list(sides.values()))))
    got = {r["doc_id"]: (r["n_chars"], r["aligned"]) for r in catalog.queries()["stream_coverage"](spark, FOLDER).collect()}
    assert got == {d: (len(a), sum(n for _, _, n in runs[d])) for d, (a, _) in sides.items()}


def test_span_boxes(spark):
    segs = spark.createDataFrame([("x", 0, "alpha beta"), ("x", 1, "gamma " * 100), ("y", 0, "alone"), ("x", 2, None), ("x", 3, "")], "doc_id string, seg long, text string")
    page = spark.createDataFrame([("x", 0, "alpha be"), ("x", 1, "ta " + "gamma " * 60), ("x", 2, "gamma " * 40), ("z", 0, "other"), ("x", 9, None)], "doc_id string, box int, text string")
    pieces = S.stream_pieces(segs, page, F.col("text"), F.col("text"))
    spans = spark.createDataFrame([("x", 0, 0, 3), ("x", 0, 3, 10), ("x", 0, 3, 10), ("x", 1, 250, 500), ("x", 1, 7, 7), ("y", 0, 0, 5)], "doc_id string, seg long, start long, stop long")
    got = {(r.seg, r.start, r.box): (r.box_from, r.n) for r in S.span_boxes(pieces, spans).collect()}
    assert got[0, 0, 0] == (0, 3) and got[0, 3, 0] == (3, 5) and got[0, 3, 1] == (0, 2)
    assert sum(n for k, (_, n) in got.items() if k[0] == 1) == 250 and {k[2] for k in got if k[0] == 1} == {1, 2}
    assert S.stream_pieces(segs.limit(0), page, F.col("text"), F.col("text")).count() == 0
    rates = {r.doc_id: r.coverage for r in S.stream_coverage(segs, pieces, F.col("text")).collect()}
    assert rates["y"] == 0 and rates["x"] > 0.9


def test_word_distance():
    random.seed(6)
    for _ in range(800):
        a, b = ([random.choice("abcd") for _ in range(random.randrange(25))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
        assert cards.word_distance(a, b) == row[-1]
    long = [str(random.randrange(5000)) for _ in range(20_000)]
    assert cards.word_distance(long, [w for i, w in enumerate(long) if i % 10]) == 2000
    assert cards.word_distance(long, ["x"] * 20_000) == 20_000
