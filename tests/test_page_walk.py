"""Documents walked one by one: the passages and boxes of the tables, no row a word or box, all candidates."""

import random

import pytest
from folioquery.operators import align, placement, stream
from folioquery.plans import catalog
from folioquery.plans.model import boxes, page_walk, segments

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def no_rows_of_words(spark, name):
    text = plan(spark, name)
    assert "Join" not in text and "Window" not in text and "Generate" not in text and text.count("MapInArrow") == 1


def test_owners_of_streams_make_no_rows_of_words(spark):
    no_rows_of_words(spark, "stream_align_owner")


def test_coverage_makes_no_rows_of_words(spark):
    no_rows_of_words(spark, "stream_coverage")


def test_words_of_boxes_make_no_rows_of_words(spark):
    no_rows_of_words(spark, "word_boxes")


def test_placement_makes_no_rows_of_words(spark):
    no_rows_of_words(spark, "passage_placement")


def test_assignment_makes_no_rows_of_words(spark):
    no_rows_of_words(spark, "monotone_assignment")


def test_walk_has_the_passages_and_boxes_of_the_tables(spark):
    text = "One two three, four five six seven eight nine ten eleven twelve thirteen\n\n...\nÄ b  C\n" + "long" * 40 + " end of it"
    rows = [(7, "en", "s", text), (-3, "de", "s", text), (100, None, "s", "a"), (8, "en", "s", None), (None, "en", "s", text), (9, "fr", "s", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(1)
    segs = segments(docs)
    want_segs = sorted(((r.doc_id, r.seg, r.norm) for r in segs.collect()), key=str)
    want_page = sorted(((r.doc_id, r.lang, r.gold, r.box, r.text) for r in boxes(segs).collect()), key=str)
    flat = lambda doc, lang, segs, page: [(doc, lang, s, None, n) for s, n, _ in segs] + [(doc, lang, g, k, t) for g, k, t in page]
    got = page_walk(docs, flat, "doc_id long, lang string, a long, b long, t string").collect()
    assert sorted(((r.doc_id, r.a, r.t) for r in got if r.b is None), key=str) == want_segs
    assert sorted((tuple(r) for r in got if r.b is not None), key=str) == want_page


def plain_runs(a, b, i=0, j=0):
    n, _, _, p, q = max(((n, -p, -q, p, q) for p in range(len(a)) for q in range(len(b)) for n in [next((k for k in range(min(len(a) - p, len(b) - q)) if a[p + k] != b[q + k]), min(len(a) - p, len(b) - q))] if n), default=(0,) * 5)
    return plain_runs(a[:p], b[:q], i, j) + [(i + p, j + q, n)] + plain_runs(a[p + n :], b[q + n :], i + p + n, j + q + n) if n else []


@pytest.mark.parametrize(("small", "pieces", "met", "few"), [(200, (16, 48), 32, 64), (0, (2, 5), 32, 64), (0, (3,), 1000, 0), (0, (2, 4), 1, 3)])
def test_runs_by_pieces_equal_the_plain_rule(monkeypatch, small, pieces, met, few):
    for name, value in (("SMALL", small), ("PIECES", pieces), ("MET", met), ("FEW", few)):
        monkeypatch.setattr(stream, name, value)
    random.seed(8)
    for k in range(60):
        a = "".join(random.choices("ab c" if k % 2 else "é😀x", k=random.randrange(40)))
        b = "".join(c for c in a if random.random() < 0.85) if k % 3 else "".join(random.choices("abc ", k=30))
        want = []
        for i, j, n in plain_runs(a, b):
            if want and want[-1][0] + want[-1][2] == i and want[-1][1] + want[-1][2] == j:
                i, j, n = want[-1][0], want[-1][1], want.pop()[2] + n
            want.append((i, j, n))
        assert stream.common_runs(a, b) == want


def test_long_texts_are_not_searched_place_by_place(monkeypatch):
    searched, whole = [], stream.longest_run
    monkeypatch.setattr(stream, "longest_run", lambda a, a0, a1, b, b0, b1, bound: searched.append(a1 - a0) or whole(a, a0, a1, b, b0, b1, bound))
    random.seed(9)
    words = ["".join(random.choices("abcdefgh", k=random.randrange(2, 9))) for _ in range(3000)]
    a, b = " ".join(words), " ".join(w for i, w in enumerate(words) if i % 10)
    runs = stream.common_runs(a, b)
    assert sum(n for *_, n in runs) > 0.95 * len(b) and sum(searched) < len(a)


def test_spans_of_many_boxes():
    pieces = [(0, 0, 0, 0, 5), (0, 6, 1, 0, 4), (0, 10, 2, 0, 3), (2, 0, 2, 3, 9)]
    spans = [(0, 0, 5), (0, 5, 6), (0, 6, 12), (1, 0, 4), (2, 0, 3), (2, 8, 12)]
    assert stream.span_counts(pieces, spans) == [1, 0, 2, 0, 1, 1]


def test_assignment_has_all_candidates(spark):
    """The second box fits twelve passages better, but they lie before the first box's only one."""
    rows = [(1, 20, 50, 1, 40, 1.0), (1, 21, 50, 2, 40, 0.6)] + [(1, s, 50, 2, 40, 0.9) for s in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, seg long, seg_chars long, box long, box_chars long, score double")
    assert sorted((r.box, r.seg) for r in align.monotone_assignment(df).collect()) == [(1, 20), (2, 21)]


def test_bounded_assignment_equals_the_whole_search(monkeypatch):
    random.seed(6)
    for _ in range(200):
        rooms = [random.randrange(3, 30) for _ in range(6)]
        rows = []
        for b in range(12):
            size = random.randrange(1, 9)
            rows.append((b, [(s, size, rooms[s], random.choice([5001, 3000, random.randrange(1, 5002)])) for s in sorted(random.sample(range(6), random.randrange(7)))]))
        monkeypatch.setattr(align, "SOUGHT", 0)
        got = align.best_monotone(rows, 2.0)
        monkeypatch.setattr(align, "SOUGHT", 10_000)
        assert got == align.best_monotone(rows, 2.0)


def test_windows_that_cannot_be_better_are_not_compared(monkeypatch):
    """After a window with all of a text's characters no other is looked at."""
    compared, whole = [], placement.common_runs
    monkeypatch.setattr(placement, "common_runs", lambda a, b: compared.append(1) or whole(a, b))
    assert placement.best_window("zebra of zebu " * 30, "zebra zebu") == (0, 13, 1.0)
    assert len(compared) == 1
