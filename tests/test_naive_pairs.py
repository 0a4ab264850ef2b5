"""Pairs of passages and boxes: counted in blocks, equal to the plain rule, and few of them kept."""

import random

import pytest
from folioquery.operators import align
from folioquery.plans.model import boxes, segments


def plain(segs, texts, threshold):
    out = {}
    for i, b in enumerate(texts):
        for j, s in enumerate(segs):
            x, y = set(b.split()), set(s.split())
            score = 1.0 if b in s or s in b else len(x & y) / min(len(x), len(y))
            if score >= threshold:
                out[i, j] = score
    return out


@pytest.mark.parametrize("block", [1, 50, align.BLOCK])
def test_pairs_equal_the_plain_rule(monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    random.seed(5)
    words = ["a", "an", "ant", "tan", "plant", "go", "gone"]
    text = lambda n: " ".join(random.choices(words, k=random.randint(1, n)))
    for _ in range(40):
        segs, texts = [text(9) for _ in range(6)], [text(4) for _ in range(8)]
        want = plain(segs, texts, 0.5)
        assert {(i, j): s for i, j, s in align.naive_pairs(segs, texts, 0.5)} == want
        few = {(i, j): s for i, j, s in align.naive_pairs(segs, texts, 0.5, 2)}
        kept = {k for i in range(8) for k in sorted((k for k in want if k[0] == i), key=lambda k: (-want[k], k[1]))[:2]}
        kept |= {min((k for k in want if k[1] == j), key=lambda k: (-want[k], k[0])) for j in range(6) if any(k[1] == j for k in want)}
        assert few == {k: want[k] for k in kept}


def test_kept_pairs_grow_with_the_boxes_not_their_product(spark):
    """A document of like lines: every line fits every box, but owners need one pair a box and one a line."""
    docs = spark.createDataFrame([(7, "en", "s", "\n".join(["one two three four"] * 60))], "doc_id long, lang string, source string, text string")
    segs = segments(docs)
    page = boxes(segs)
    n = page.count()
    assert align.align_naive(segs, page).count() == 60 * n
    assert align.align_naive(segs, page, top=1).count() <= 60 + n


def test_boxes_of_long_words(spark):
    docs = spark.createDataFrame([(1, "en", "s", "ab " + "x" * 130 + " cd ef")], "doc_id long, lang string, source string, text string")
    got = [(r.box, r.text) for r in boxes(segments(docs), lost=0).orderBy("box").collect()]
    assert got == [(0, "ab " + "x" * 130), (2, "cd ef")]
