"""Tokens go to the smallest box that holds them, without a row for a token or a pair of token and box."""

import random

import numpy as np
from folioquery.operators import placement
from folioquery.plans import catalog


def test_smallest_box_equals_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        points = [(rng.randrange(40) / 2, rng.randrange(40) / 2) for _ in range(rng.randrange(30))]
        boxes = [(x := rng.randrange(12), y := rng.randrange(12), x + rng.randrange(9), y + rng.randrange(9)) for _ in range(rng.randrange(12))]
        want = []
        for px, py in points:
            held = [((x1 - x0) * (y1 - y0), k) for k, (x0, y0, x1, y1) in enumerate(boxes) if x0 <= px <= x1 and y0 <= py <= y1]
            want.append(min(held)[1] if held else -1)
        x, y = np.array(points, float).reshape(-1, 2).T
        assert placement.smallest_box(x, y, np.array(boxes, float).reshape(-1, 4)).tolist() == want


def test_box_votes_makes_no_rows_of_tokens(spark, tmp_path):
    # a document of many passages: their product with its tokens is 900 million pairs
    texts = ["w\n" * 30_000, "one two\n\n--\nthree", "", "\n", None, "x" * 1_200 + " y\nz"]
    rows = [(d, t, "en", "src0") for d, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.queries()["box_votes"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    got = {(r.doc_id, r.seg): r.n_tokens for r in df.collect()}
    assert sum(n for (d, _), n in got.items() if d == 0) == 30_000
    assert {k: n for k, n in got.items() if k[0]} == {(1, 0): 2, (1, 3): 1, (5, 0): 1, (5, 1): 1}
