"""Links between labels and values against a walk over all pairs of a page."""

import random
import xml.etree.ElementTree as ET
from collections import defaultdict

import numpy as np
from folioquery.operators import links
from folioquery.plans import catalog
from folioquery.plans.q_layout import _form

FOLDER = "/root/testdata/sf0.001"
BOX = "page int, id long, x0 double, y0 double, x1 double, y1 double, text string"


def share(a0, a1, b0, b1):
    both, short = min(a1, b1) - max(a0, b0), min(a1 - a0, b1 - b0)
    return both / short if short > 0 and both > 0 else 0


def plain_links(values, labels):
    pairs = []
    for v in values:
        for q in labels:
            if share(v.y0, v.y1, q.y0, q.y1) > 0.5 and q.x1 <= v.x0 + 2 and v.x0 - q.x1 <= 250:
                pairs.append((float(v.x0 - q.x1), v.id, q.id))
            if share(v.x0, v.x1, q.x0, q.x1) > 0.3 and q.y1 <= v.y0 + 2 and v.y0 - q.y1 <= 40:
                pairs.append((float(v.y0 - q.y1), v.id, q.id))
    out: dict = {}
    for _, v, q in sorted(pairs):
        if v not in out and q not in out.values():
            out[v] = q
    return out


def test_fields_equal_plain_version(spark):
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    tables = _form(read)
    values, labels, headers = (defaultdict(list) for _ in range(3))
    for df, to in zip(tables, (values, labels, headers)):
        for r in df.orderBy("id").collect():
            to[r.page].append(r)
    got = {(r.page, r.id): r for r in links.fields(*tables, ["page"]).collect()}
    assert len(got) == sum(map(len, values.values()))
    linked = 0
    for page, vs in values.items():
        want, text = plain_links(vs, labels[page]), {q.id: q.text for q in labels[page]}
        for v in vs:
            r, above = got[page, v.id], [h for h in headers[page] if h.y1 <= v.y0 + 2]
            head = min(above, key=lambda h: (-h.y1, h.id)).text if above else None
            assert (r.label, r.header) == (text.get(want.get(v.id)), head)
            linked += v.id in want
    assert linked > 50


def test_xml_of_the_query(spark):
    pages = catalog.queries()["form_fields_xml"](spark, FOLDER).collect()
    n = sum(len([e for e in ET.fromstring(r.xml).iter() if not len(e) and e.tag != 'document' and e.get('role') is None]) for r in pages)
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    assert n == _form(read)[0].count()


def test_small_page(spark):
    make = lambda rows: spark.createDataFrame([(p, i, *map(float, box), t) for p, i, *box, t in rows], BOX)
    values = make([(1, 0, 100, 10, 140, 20, " 42 "), (1, 1, 20, 60, 60, 70, "a<b"), (1, 2, 600, 600, 610, 610, "far"), (2, 0, 0, 0, 1, 1, None)])
    labels = make([(1, 0, 20, 10, 60, 20, "2nd Grade:"), (1, 1, 20, 45, 60, 55, "Name"), (1, 2, 590, 570, 620, 580, "--")])
    headers = make([(1, 0, 0, 0, 300, 5, "Part A"), (1, 1, 0, 0, 300, 5, "Part B"), (1, 2, 0, 300, 9, 310, "?")])
    got = {(r.page, r.id): (r.name, r.label, r.text, r.section, r.header) for r in links.fields(values, labels, headers, ["page"]).collect()}
    assert got == {
        (1, 0): ("f_2nd_grade", "2nd Grade:", "42", "part_a", "Part A"),
        (1, 1): ("name", "Name", "a<b", "part_a", "Part A"),
        (1, 2): ("unkeyed", None, "far", None, None),
        (2, 0): ("unkeyed", None, None, None, None),
    }
    xml = {r.page: r.xml for r in links.fields_xml(links.fields(values, labels, headers, ["page"]), ["page"], "t").collect()}
    assert xml[1] == '<document source="t"><part_a role="header" label="Part A"><f_2nd_grade label="2nd Grade:">42</f_2nd_grade><name label="Name">a&lt;b</name></part_a><unkeyed>far</unkeyed></document>'
    assert links.fields(values.limit(0), labels, headers, ["page"]).count() == 0


def test_pairs_are_made_where_boxes_lie(spark):
    rng = random.Random(5)
    box = lambda: (x := rng.randrange(300), y := rng.randrange(400), x + rng.randrange(-3, 60), y + rng.choice([-2, 0, 9, 12, 30, 300]))
    make = lambda n: [(p, i, *map(float, box()), "") for p in (1, 2, None) for i in range(n)]
    values, labels = make(150), make(130)
    got = links.candidates(spark.createDataFrame(values, BOX), spark.createDataFrame(labels, BOX), ["page"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = []
    for p, v, a0, b0, a1, b1, _ in values:
        for r, q, c0, d0, c1, d1, _ in labels:
            if p and p == r:
                want += [(p, v, q, a0 - c1, "row")] * (share(b0, b1, d0, d1) > 0.5 and -2 <= a0 - c1 <= 250)
                want += [(p, v, q, b0 - d1, "above")] * (share(a0, a1, c0, c1) > 0.3 and -2 <= b0 - d1 <= 40)
    assert len(want) > 1000 and sorted(map(tuple, got.collect())) == sorted(want)


def test_pairs_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(links, "PAIRS", 7)
    b = np.array([[0, 0, 10, 10]] * 30 + [[12, 1, 20, 11]] * 3, float)
    kind = np.array([0] * 30 + [1] * 3)
    got = [(v, q) for vs, qs, _, below in links._linked(np.zeros(33, int), kind, np.zeros(33, int), b) for v, q in zip(vs, qs) if not below]
    assert sorted(got) == [(v, q) for v in (30, 31, 32) for q in range(30)]


def test_links_without_pairs_equal_those_of_all_pairs(spark, monkeypatch):
    """No row a pair; few pairs at once, one gap of very many pairs, gaps that lie close together."""
    random.seed(12)
    rows = []
    for p in range(30):
        step = random.choice([1, 10, 0.3])
        for i in range(60):
            x, y = random.randrange(40) * step, random.randrange(30 if p % 3 else 2) * step
            rows.append((p, i, i % 2, float(x), float(y), x + random.choice([4.0, 9.5]), y + random.choice([6.0, 8.0])))
    df = spark.createDataFrame(rows, "page int, id long, kind int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    values, labels = (df.where(f"kind = {k}").drop("kind") for k in (1, 0))
    want = sorted(map(tuple, links.one_to_one(links.candidates(values, labels, ["page"]), ["page"]).collect()))
    assert len(want) > 300 and sorted(map(tuple, links.nearest(values, labels, ["page"]).collect())) == want
    for most in (30, 3):
        monkeypatch.setattr(links, "MOST", most)
        got = []
        for p in range(6):
            v, q = (np.array([r[1:2] + r[3:] for r in rows if r[0] == p and r[2] == k]) for k in (1, 0))
            got += [(p, int(v[x, 0]), int(q[y, 0])) for x, y in links._nearest(v[:, 0], v[:, 1:].T, q[:, 0], q[:, 1:].T)]
        assert sorted(got) == [r for r in want if r[0] < 6]


def test_fields_make_no_row_a_pair(spark):
    plan = catalog.queries()["form_fields_xml"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "_band" not in plan and "gap" not in plan
