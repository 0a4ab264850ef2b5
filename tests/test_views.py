"""Views of texts and the way back, against a plain version."""

import random

from pyspark.sql import functions as F

from folioquery.functions import views
from folioquery.operators import records

BITS = ["a", "B", "é", "İ", "Σ", "漢", "😀", " ", "\n", "-", "**", "`", "“", r"\times", r"\leq", r"\le", r"\%", r"\$", r"\q", "\\", "$", "{", "1", "ab c", r"\dots", "×"]


def plain_view(text):
    """[(shown, start, stop)] character by character."""
    table, out, i = dict(views.ESCAPES), [], 0
    while i < len(text):
        escape = max((e for e in table if text.startswith(e, i)), key=len, default=None)
        if escape:
            out.append((table[escape], i, i + len(escape)))
        elif text[i] not in views.LEFT_OUT:
            out.append((text[i].translate({ord("İ"): "i", ord("Σ"): "σ"}).lower(), i, i + 1))
        i += len(escape) if escape else 1
    return out


def plain_ground(value, evidence, text):
    d, shown = plain_view(text or ""), lambda t: "".join(c for c, _, _ in plain_view(t or ""))
    dv, v, e = "".join(c for c, _, _ in d), shown(value), shown(evidence)
    ea = dv.find(e) if e else -1
    inside = dv.find(v, ea, ea + len(e)) if v and ea >= 0 else -1
    anywhere = dv.find(v) if v else -1
    for kind, at, n in (("in_evidence", inside, len(v)), ("in_document", anywhere, len(v)), ("evidence_only", ea, len(e))):
        if at >= 0:
            a, b = d[at][1], d[at + n - 1][2]
            return kind, a, b, text[a:b]
    return "none", None, None, None


def text(n):
    return "".join(random.choice(BITS) for _ in range(random.randrange(n)))


def test_views_equal_plain_version(spark):
    random.seed(1)
    made = [text(30) for _ in range(1000)] + [None, "", "\\", "$\\$"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", views.view(F.col("t")).alias("v")).collect()}
    assert got == {i: "".join(c for c, _, _ in plain_view(t or "")) for i, t in enumerate(made)}


def test_finds_map_back(spark):
    random.seed(2)
    rows = []
    for i in range(1000):
        t = text(40)
        v = plain_view(t)
        if v:
            a = random.randrange(len(v))
            b = random.randrange(a, len(v))
            rows.append((i, t, a, b - a + 1, v[a][1], v[b][2]))
    df = spark.createDataFrame(rows, "i int, t string, at int, n int, want0 int, want1 int")
    got = df.select("i", "t", "want0", "want1", views.source_span(views.pieces(F.col("t")), F.col("at"), F.col("n")).alias("s"))
    bad = got.where((F.col("s.start") != F.col("want0")) | (F.col("s.stop") != F.col("want1")) | F.col("s").isNull())
    assert bad.collect() == [] and len(rows) > 900


def test_grounding_equals_plain_version(spark):
    random.seed(3)
    rows = []
    for i in range(800):
        t = text(40)
        a, b = sorted((random.randrange(len(t) + 1), random.randrange(len(t) + 1)))
        c, d = sorted((random.randrange(a, b + 1), random.randrange(a, b + 1)))
        rows.append((i, random.choice([t[c:d], t[c:d], text(4), None]), random.choice([t[a:b], t[a:b].replace(" ", " - "), text(4), ""]), random.choice([t] * 9 + [None]), 0))
    df = spark.createDataFrame(rows, "i int, value string, evidence string, document string, _p int")
    got = {r.i: (r.grounded_by, r.start, r.stop, r.said) for r in records.ground(df.drop("_p"), "value", "evidence", "document").collect()}
    want = {i: plain_ground(v, e, t) for i, v, e, t, _ in rows}
    assert got == want and {k[0] for k in want.values()} == {"in_evidence", "in_document", "evidence_only", "none"}


def test_long_text(spark):
    t = "word - " * 60_000 + "needle **in** stack"
    df = spark.createDataFrame([(t, "needle in", "in stack")], "document string, value string, evidence string")
    r = records.ground(df, "value", "evidence", "document").first()
    assert (r.grounded_by, r.said) == ("in_document", "needle **in")
