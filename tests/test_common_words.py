"""Words and passages in common, without joins of words."""

import random

from folioquery.operators import corpus, metrics


def test_similar_passages_equal_all_pairs(spark):
    rng = random.Random(6)
    text = {(d, s): " ".join(rng.choices("abcdefghij", k=rng.randrange(1, 14))) for d in range(6) for s in range(12)}
    segs = spark.createDataFrame([(d, s, t) for (d, s), t in text.items()], "doc_id long, seg long, norm string")
    pairs = spark.createDataFrame([(d, d + 1) for d in range(5)], "a long, b long")
    got = corpus.similar_passages(segs, pairs)
    plan = corpus.greedy_pairs(got, ["a", "b"], "i", "j")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan
    want = set()
    for a in range(5):
        for i in range(12):
            for j in range(12):
                x, y = set(text[a, i].split()), set(text[a + 1, j].split())
                if (score := round(len(x & y) / len(x | y), 4)) >= 0.6:
                    want.add((a, a + 1, i, j, score))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) > 30 and set(found) == want


def test_words_of_texts_are_counted_where_they_are(spark):
    ref = spark.createDataFrame([(1, "a a"), (1, "b"), (2, "c"), (3, None)], "d long, t string")
    hyp = spark.createDataFrame([(1, "a"), (1, "c"), (4, "d d"), (3, None)], "d long, t string")
    got = metrics.text_multiset_prf(ref, hyp, "d", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert {tuple(r) for r in got.collect()} == {(1, 3, 2, 1, 0.333333, 0.5), (2, 1, 0, 0, 0.0, None), (4, 0, 2, 0, None, 0.0)}
