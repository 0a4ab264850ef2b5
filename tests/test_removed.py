"""Lines that a next version hasn't: a document's marks are made once and are dealt, not its text."""

import random

from folioquery.operators import corpus
from folioquery.plans import catalog
from pyspark.sql import functions as F


def plain(docs, pairs):
    for a, b in pairs:
        first = {m: i for i, m in reversed(list(enumerate(docs[b] or []))) if m is not None}
        anchor = None
        for i, m in enumerate(docs[a] or []):
            if m in first:
                anchor = first[m]
            elif m is not None:
                yield a, b, i, anchor


def test_removed_equals_plain_version(spark):
    rng = random.Random(6)
    docs = {d: [rng.choice("abcdefgh") if rng.random() < 0.8 else None for _ in range(rng.randrange(12))] for d in range(80)} | {80: None, 81: []}
    pairs = [(d, d + 1) for d in range(81)] + [(81, 0), (3, 3), (4, 9)]
    lines = spark.createDataFrame(list(docs.items()), "doc_id long, marks array<string>")
    got = corpus.removed(lines, spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(docs, pairs))) and got.count() > 100


def test_texts_are_normalised_once_and_not_joined(spark, read):
    df = catalog.queries()["diff_anchor_last_match"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "text" not in plan.split("Join")[0]
    assert df.select(F.max("seg")).first()[0] > 0
