"""A text is cut into few pieces, and places in its view are found across their ends."""

import random

from folioquery.functions import views
from folioquery.operators import records
from folioquery.plans import catalog
from pyspark.sql import functions as F
from test_views import BITS, plain_ground, plain_view


def test_plain_text_has_few_pieces(spark):
    t = "one - two **three** " * 500
    df = spark.createDataFrame([(t,), (t + "\\le\\",), (None,)], "t string").select("t", views.pieces(F.col("t")).alias("p"))
    got = df.select(F.size("p").alias("n"), F.array_join("p.source", "").alias("back"), "t").collect()
    assert [r.n for r in got] == [(n := -(-len(t) // 64)), n + 2, 0]
    assert all(r.back == (r.t or "") for r in got)


def test_long_texts_map_back(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice(BITS[:k]) for _ in range(rng.randrange(150, 600))) for k in (9, 12, 13, len(BITS)) for _ in range(60)]
    rows = []
    for i, t in enumerate(made):
        v = plain_view(t)
        a = rng.randrange(len(v))
        b = rng.randrange(a, len(v))
        rows.append((i, t, a, b - a + 1, v[a][1], v[b][2], "".join(c for c, _, _ in v)))
    df = spark.createDataFrame(rows, "i int, t string, at int, n int, want0 int, want1 int, view string").withColumn("p", views.pieces(F.col("t")))
    s = views.source_span(F.col("p"), F.col("at"), F.col("n"))
    good = df.select("*", s.alias("s"), views.shown(F.col("p")).alias("v")).where("s.start = want0 and s.stop = want1 and v = view")
    assert good.count() == len(rows)


def test_grounding_of_long_texts_equals_plain_version(spark):
    rng, rows = random.Random(5), []
    for i in range(200):
        t = "".join(rng.choice(BITS) for _ in range(rng.randrange(400)))
        a, b = sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)))
        c, d = sorted((rng.randrange(a, b + 1), rng.randrange(a, b + 1)))
        rows.append((i, rng.choice([t[c:d], t[c : c + 9], "no"]), rng.choice([t[a:b], t[a:b].replace(" ", " - "), "no"]), t))
    df = spark.createDataFrame(rows, "i int, value string, evidence string, document string")
    got = {r.i: (r.grounded_by, r.start, r.stop, r.said) for r in records.ground(df, "value", "evidence", "document").collect()}
    assert got == {i: plain_ground(v, e, t) for i, v, e, t in rows}


def test_documents_of_one_file_are_dealt(spark):
    df = catalog.queries()["grounded_spans"](spark, "/root/testdata/sf0.001")
    top, dealt, _ = df._jdf.queryExecution().optimizedPlan().toString().partition("RepartitionByExpression [doc_id")
    assert dealt and "regexp_extract_all" in top and df.count() == 200
