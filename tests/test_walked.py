"""Groups walked in order while they stream by."""

from folioquery.operators import align, links, placement, stream
from folioquery.operators.folds import walked
from pyspark.sql import functions as F


def test_groups_come_whole_and_in_order(spark):
    rows = spark.range(40_000).select((F.col("id") % 4_000).alias("g"), F.when(F.col("id") >= 4_000, -F.col("id")).alias("k"))
    got = walked(rows, ["g"], ["k"], lambda r: [(r[0]["g"], len(r), [x["k"] for x in r] == sorted(x["k"] for x in r[:-1]) + [None])], "g long, n long, ok boolean")
    assert got.where("n = 10 and ok").count() == got.count() == 4_000


def test_no_step_makes_a_frame_a_group(spark):
    seg = spark.createDataFrame([(1, 0, "a few words here", "a few words here")], "doc_id long, seg long, norm string, needle string")
    page = spark.createDataFrame([(1, 0, "a few words")], "doc_id long, box long, text string")
    pairs = spark.createDataFrame([(1, 2, 3, 0.5), (1, 2, 4, 0.1)], "page long, value long, label long, gap double")
    made = [stream.stream_pieces(seg, page, F.col("norm"), F.col("text")), placement.place_passages(seg, page), links.one_to_one(pairs, ["page"])]
    for df in made:
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in made[2].collect()] == [(1, 2, 4)]
    assert [tuple(r) for r in made[0].collect()] == [(1, 0, 0, 0, 0, 12)]


def test_assignment_makes_no_frame_a_document(spark):
    rows = [(d, s, 20, b, 10, 0.9 if s == b // 2 else 0.6) for d in range(3) for b in range(8) for s in range(4)]
    df = align.monotone_assignment(spark.createDataFrame(rows, "doc_id long, seg long, seg_chars long, box long, box_chars long, score double"))
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [(d, b, b // 2) for d in range(3) for b in range(8)]
