"""Verdict merges by micro-batches: late and repeated rows, clears, restarts."""

import datetime
import random

from folioquery.streaming import verdicts as V

T0 = datetime.datetime(2024, 1, 1)


def row(doc, item, verdict, at, seq, boxes=None, node=None):
    return (doc, item, verdict, boxes, node, None, T0 + datetime.timedelta(seconds=at) if at is not None else None, seq)


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, V.LOG).coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder):
    stream = spark.readStream.schema(V.LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    V.run_verdicts(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return {(r.doc, r.id): r.verdict for r in V.current(spark, f"{folder}/out").collect()}


def test_late_repeated_and_cleared(spark, tmp_path):
    folder = f"file://{tmp_path}"
    put(spark, folder, [row("a", "audit:1", "accept", 10, 1), row("a", "audit:2", "skip", 5, 2), row("b", "null:1", "node", 5, 3, node="n1")], "b0")
    assert run(spark, folder) == {("a", "audit:1"): "accept", ("a", "audit:2"): "skip", ("b", "null:1"): "node"}
    put(spark, folder, [row("a", "audit:1", "clear", 20, 4), row("a", "audit:1", "clear", 20, 4), row("a", "audit:2", "reject", 1, 5)], "b1")
    assert run(spark, folder) == {("a", "audit:2"): "skip", ("b", "null:1"): "node"}
    put(spark, folder, [row("a", "audit:1", "reject", 15, 6)], "b2")  # older than the clear
    assert ("a", "audit:1") not in run(spark, folder)
    put(spark, folder, [row("a", "audit:1", "reject", 20, 9), row("c", "bogus:1", "skip", 1, 1), row("c", "audit:1", "boxes", 1, 2), row("c", "excluded:1", "boxes", 1, 3), row("c", "null:1", "node", 1, 4), row(None, "audit:1", "skip", 1, 5), row("c", "audit:9", "skip", None, 5)], "b3")
    assert run(spark, folder)["a", "audit:1"] == "reject"
    faults = spark.read.parquet(f"{folder}/out/faults")
    assert sorted(r.fault for r in faults.collect()) == ["bad_item", "bad_item", "bad_verdict", "needs_boxes", "needs_node", "no_time"]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    first = spark.createDataFrame([row("a", "audit:1", "accept", 10, 1)], V.LOG)
    second = spark.createDataFrame([row("a", "audit:1", "clear", 20, 2), row("b", "audit:1", "skip", 1, 1)], V.LOG)
    V.merge_batch(first, folder, 0)
    for _ in range(2):
        V.merge_batch(second, folder, 1)
        assert [(r.doc, r.verdict) for r in V.current(spark, folder).collect()] == [("b", "skip")]
    V.merge_batch(first, folder, 0)  # an earlier one too
    assert [(r.doc, r.verdict) for r in V.current(spark, folder).collect()] == [("b", "skip")]


def test_batches_equal_one_pass_over_the_log(spark, tmp_path):
    random.seed(5)
    log = [row(f"d{random.randrange(9)}", f"audit:{random.randrange(3)}", random.choice(["accept", "reject", "skip", "clear", "boxes"]), random.randrange(30), i) for i in range(150)]
    for n in range(5):
        V.merge_batch(spark.createDataFrame(random.sample(log[n * 30 : n * 30 + 30], 30) + log[:3], V.LOG), f"file://{tmp_path}/out", n)
    whole: dict = {}
    for r in log:
        if r[2] != "boxes":
            whole[r[:2]] = max(whole.get(r[:2], ((T0, -1), "clear")), ((r[6], r[7]), r[2]))
    got = {(r.doc, r.id): r.verdict for r in V.current(spark, f"file://{tmp_path}/out").collect()}
    assert got == {k: v for k, (_, v) in whole.items() if v != "clear"} and got


def test_working_set_and_progress(spark, tmp_path):
    assert V.current(spark, f"file://{tmp_path}/none").count() == 0
    items = spark.createDataFrame([("a", "audit:1", 3), ("a", "audit:2", 4), ("b", "audit:1", 5)], "doc string, id string, size int")
    held = V.last_verdicts(spark.createDataFrame([row("a", "audit:1", "accept", 1, 1), row("c", "audit:1", "skip", 1, 1)], V.LOG))
    assert {(r.doc, r.id): (r["size"], r.verdict) for r in V.working_set(items, held).collect()} == {("a", "audit:1"): (3, "accept"), ("a", "audit:2"): (4, None), ("b", "audit:1"): (5, None)}
    assert {r.doc: (r.n_items, r.n_annotated, r.n_open) for r in V.progress(items, held).collect()} == {"a": (2, 1, 1), "b": (1, 0, 1), "c": (0, 1, 0)}
