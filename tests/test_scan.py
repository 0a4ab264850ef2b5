"""Incremental scans of a folder."""

import json
import os

from pyspark.sql import functions as F

from folioquery.sources import scan


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def parse(files):
    lines = files.select("path", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return lines.select("path", F.get_json_object("line", "$.id").cast("int").alias("id"), F.get_json_object("line", "$.t").alias("t"))


def test_only_changed_files_are_read_again(spark, tmp_path):
    at, store = tmp_path / "in", f"file://{tmp_path}/store"
    for i in range(4):
        put(at / f"d{i}", "a.json", [{"id": i, "t": f"first {i}"}, {"id": i + 10, "t": "x"}])
    put(at, "note.txt", [{"id": 99, "t": "no"}])
    run = lambda: scan.refresh(spark, f"file://{at}", store, parse, "*.json")
    rows = lambda: sorted((r.id, r.t) for r in scan.current(spark, store).collect())
    assert run() == {"new": 4} and len(rows()) == 8
    assert run() == {"same": 4} and not os.path.exists(tmp_path / "store/files/scan=1")
    put(at / "d1", "a.json", [{"id": 1, "t": "second"}])
    os.remove(at / "d2/a.json")
    put(at / "d4", "a.json", [{"id": 4, "t": "late"}])
    assert run() == {"same": 2, "changed": 1, "gone": 1, "new": 1}
    assert rows() == [(0, "first 0"), (1, "second"), (3, "first 3"), (4, "late"), (10, "x"), (13, "x")]
    read = {r.path.rsplit("/", 2)[1] for r in spark.read.parquet(f"{store}/rows/scan=1").collect()}
    assert read == {"d1", "d4"}
    os.remove(at / "d4/a.json")
    assert run() == {"same": 3, "gone": 1} and (4, "late") not in rows()


def test_a_scan_that_was_cut_off_is_done_again(spark, tmp_path):
    at, store = tmp_path / "in", f"file://{tmp_path}/store"
    put(at, "a.json", [{"id": 1, "t": "one"}])
    spark.createDataFrame([("file:/other", 7, "left over")], "path string, id int, t string").write.parquet(f"{store}/rows/scan=0")
    assert scan.refresh(spark, f"file://{at}", store, parse) == {"new": 1}
    assert [(r.id, r.t) for r in scan.current(spark, store).collect()] == [(1, "one")]
    put(at, "empty.json", [])
    assert scan.refresh(spark, f"file://{at}", store, parse) == {"same": 1}
    (at / "blank.json").write_text("\n")
    assert scan.refresh(spark, f"file://{at}", store, parse) == {"same": 1, "new": 1}
    assert scan.current(spark, store).count() == 1
