"""Swept areas against masks of cells."""

import random

import numpy as np

from folioquery.operators import areas, cards


def masks(boxes, cell=4):
    m = np.zeros((2, 80, 80), bool)
    for side, x0, y0, x1, y1 in boxes:
        m[side, y0 // cell : y1 // cell + 1, x0 // cell : x1 // cell + 1] = True
    return m


def made(n):
    out = []
    for _ in range(n):
        x, y = random.randrange(250), random.randrange(250)
        out.append((random.randrange(2), x, y, x + random.randrange(60), y + random.randrange(60)))
    return out


def test_swept_equals_masks(spark):
    random.seed(1)
    rows = [(i, *b) for i in range(150) for b in made(random.randrange(1, 12))]
    df = spark.createDataFrame([*rows, (999, 0, None, 1, 2, 3)], "k int, side int, x0 int, y0 int, x1 int, y1 int")
    got = {r.k: (r.n_a, r.n_b, r.common, r.iou) for r in areas.overlap_areas(df, ["k"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        a, b = masks([r[1:] for r in rows if r[0] == k])
        want[k] = (a.sum(), b.sum(), (a & b).sum(), round(float((a & b).sum() / (a | b).sum()), 6))
    assert got == want


def test_real_areas_and_no_area(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.0), (1, 0, 1.0, 1.0, 3.0, 2.0), (1, 1, 1.5, 0.0, 2.5, 9.0), (2, 0, 1.0, 1.0, 1.0, 5.0)], "k int, side int, x0 double, y0 double, x1 double, y1 double")
    got = {r.k: (r.n_a, r.n_b, r.common, r.iou) for r in areas.overlap_areas(df, ["k"], None).collect()}
    assert got == {1: (5.0, 9.0, 1.5, 0.12), 2: (0.0, 0.0, 0.0, None)}


def test_many_boxes_of_one_group():
    random.seed(2)
    n = 3000
    x, y = np.random.default_rng(1).integers(0, 10**6, (2, n))
    a, b, both = areas.swept(np.arange(n) % 2, x, y, x + 500, y + 500)
    assert 0 < both < a < n / 2 * 250_000 + 1 and b > 0


def test_localisation(spark):
    box = spark.createDataFrame([(1, b, p, x, 0, x + 40, 40) for b, p, x in ((0, 1, 0), (1, 1, 50), (2, 2, 0), (3, 1, 4))], "doc int, box int, page int, x0 int, y0 int, x1 int, y1 int")
    gold = spark.createDataFrame([(1, "same", 0), (1, "same", 1), (1, "near", 0), (1, "pages", 0), (1, "pages", 2), (1, "lost", 1), (1, "absent", None), (1, "claimed", None)], "doc int, node string, box int")
    pred = spark.createDataFrame([(1, "same", 1), (1, "same", 0), (1, "same", 0), (1, "near", 3), (1, "pages", 2), (1, "claimed", 1), (1, "other", 0)], "doc int, node string, box int")
    got = {r.node: (r.gold, r.pred, r.exact, r.iou) for r in areas.localisation(gold, pred, box, "doc").collect()}
    assert got == {"same": (2, 2, True, 1.0), "near": (1, 1, False, round(10 / 12, 6)), "pages": (2, 1, False, 0.5), "lost": (1, 0, False, 0.0), "absent": (0, 0, False, 0.0), "claimed": (0, 1, False, 0.0)}
    card = cards.node_card(areas.localisation(gold, pred, box, "doc"), []).first()
    assert (card.n_nodes, card.n_absent, card.n_absent_correct, card.n_missed, card.n_localized, card.n_exact) == (6, 2, 1, 1, 3, 1)


def test_groups_covered_together_equal_the_sweep(monkeypatch):
    rng = np.random.default_rng(6)
    groups = []
    for m in [0, 1, 2, 3, 5, 8, areas.FEW, areas.FEW + 1] * 20:
        x, y = rng.integers(-4, 9, m).astype(float), rng.integers(-4, 9, m).astype(float)
        groups.append((rng.integers(0, 2, m), x, y, x + rng.integers(-1, 5, m), y + rng.integers(-1, 5, m)))
    groups.append((np.array([0, 1]), np.array([0.0, np.nan]), np.zeros(2), np.ones(2), np.ones(2)))
    want = [areas.swept(*g) for g in groups]
    one_by_one, calls = areas.swept, []
    monkeypatch.setattr(areas, "swept", lambda *g: calls.append(len(g[0])) or one_by_one(*g))
    assert areas.swept_many(*zip(*groups)).tolist() == [list(w) for w in want]
    assert sorted(calls) == [2] + [areas.FEW + 1] * 20
