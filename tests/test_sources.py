"""Readers, writers, ordered walks and streams on small inputs."""

import glob

from pyspark.sql import functions as F

from folioquery.operators import folds, graph
from folioquery.sources import markdown, markup, sinks
from folioquery.streaming import ingest

MD = "# One\ntext a\nmore a\n\n## Two\n- x\n- y\n```\n# not a heading\n```\n# Three\n\nlast"


def test_markdown_tree(spark):
    blocks = markdown.markdown_blocks(spark.createDataFrame([(1, MD), (2, None), (3, "")], "d int, t string"), "d", "t")
    tree = [(r.kind, r.level, r.text, r.parent_seq) for r in markdown.section_tree(blocks, "d").orderBy("d", "seq").collect()]
    assert tree == [
        ("heading", 1, "One", 0),
        ("paragraph", None, "text a\nmore a", 1),
        ("heading", 2, "Two", 1),
        ("item", None, "x", 3),
        ("item", None, "y", 3),
        ("code", None, "# not a heading", 3),
        ("heading", 1, "Three", 0),
        ("paragraph", None, "last", 7),
    ]
    assert markdown.first_title(blocks, "d").first().title == "One"


def test_json_and_xml_elements(spark):
    payload = 'noise {"order": {"id": 7, "note": "", "none": null, "ok": true, "line": [{"sku": "a"}, {"sku": "b"}], "tags": ["x"]}} tail'
    rows = markup.elements(spark.createDataFrame([(1, payload), (2, "no json"), (3, None)], "d int, p string"), "d", "p", "json").orderBy("seq").collect()
    assert [(r.tag, r.parent_seq, r.attribs, r.text) for r in rows] == [("order", None, {"id": "7", "ok": "true"}, None), ("line", 0, {"sku": "a"}, None), ("line", 0, {"sku": "b"}, None), ("tags", 0, {}, "x")]
    deep = 1
    for _ in range(60):
        deep = {"a": deep, "k": 1}
    assert len(markup.json_elements(deep)) == markup.DEPTH + 1
    xml = markup.elements(spark.createDataFrame([(1, "<m><s n='1'> t </s><s/></m>"), (2, "<broken")], "d int, p string"), "d", "p", "xml").orderBy("seq").collect()
    assert [(r.tag, r.attribs, r.text) for r in xml] == [("m", {}, None), ("s", {"n": "1"}, "t"), ("s", {}, None)]


def test_export_bundle(spark, tmp_path):
    xml = "<reg><student id='5' name='A'><addr city='X'/></student><student name='B'/></reg>"
    e = markup.elements(spark.createDataFrame([(1, xml)], "d int, p string"), "d", "p", "xml")
    out = graph.export_ids(e, "d")
    assert sinks.write_csv_bundle(out, f"file://{tmp_path}/b") == ["addr", "reg", "student"]
    got = spark.read.option("header", True).csv(f"file://{tmp_path}/b/student").orderBy("id")
    assert got.columns == ["id", "parent_id", "parent_table", "attr_id", "name", "text_content"]
    assert [tuple(r)[:5] for r in got.collect()] == [("1", "1", "reg", "5", "A"), ("2", "1", "reg", None, "B")]
    assert "FOREIGN KEY" in sinks.create_statement("s", ["n"], ["reg"]) and "FOREIGN" not in sinks.create_statement("s", [], ["a", "b"])


def test_xml_pages_reopen(spark):
    rows = [(1, 0, 1, "TITLE", "a<b"), (1, 1, 2, "TEXT", "x"), (1, 2, 1, "TEXT", None)]
    b = spark.createDataFrame(rows, "d int, ord int, page int, kind string, text string")
    assert sinks.blocks_to_xml(b, "d").first().xml == '<document><page number="1"><title>a&lt;b</title></page><page number="2"><text>x</text></page><page number="1"><text></text></page></document>'
    assert sinks.blocks_to_markdown(b, "d").first().markdown == "## a<b\n\nx"


def test_html_and_latex():
    cells = markup.html_cells("<p/><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td> 2 3 </td></tr></table>")
    assert markup.table_content(cells) == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 3 |"
    assert markup.table_content(markup.html_cells("<table><tr><td colspan=2>a</td></tr></table>")) is None
    sparse = "<table><tr><td>h</td></tr>" + "<tr><td></td></tr>" * 8 + "<tr><td>1</td></tr></table>"
    assert markup.table_content(markup.html_cells(sparse)) is None and markup.html_cells("none") == []
    assert markup.latex_cells(r"a & {b & c} & d \& e") == ["a", "{b & c}", r"d \& e"]
    assert markup.macro_argument(r"x \val{a {b} c} y", "val") == "a {b} c" and markup.macro_argument(r"\val{a", "val") is None


def test_walks(spark):
    assert folds.pack([3, 3, 3, 10], 7) == [0, 0, 1, 2]
    lines = spark.sql("select split('aa bb cc ddddddd e', ' ') w").select(folds.pack_words(F.col("w"), 5)).first()[0]
    assert lines == [["aa", "bb"], ["cc"], ["ddddddd"], ["e"]]
    assert folds.group_rows([0, 2, 3, 3.5, 9]) == [0, 0, 0, 1, 2]
    assert folds.merge_runs([("A", 0, 5, 0), ("A", 9, 12, 1), ("A", 60, 70, 0), ("O", 71, 72, 0), ("B", 73, 75, 0)]) == [("A", 0, 1), ("A", 2, 2), ("B", 4, 4)]
    assert folds.nearest_links([(5, 0, 0), (1, 1, 0), (7, 0, 1)]) == [(1, 0), (0, 1)]
    df = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 9.0)], "g long, top double")
    got = folds.over_groups(df, ["g"], ["top"], lambda rows: [(rows[0]["g"], r) for r in folds.group_rows([x["top"] for x in rows])], "g long, row long").collect()
    assert [r.row for r in got] == [0, 0, 1]


def test_streams(spark, read, tmp_path):
    docs = read("documents")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = ingest.passages(ingest.document_stream(spark, f"file://{tmp_path}/in", docs.schema))
    ingest.write_batches(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == ingest.passages(docs).count()
    assert len(glob.glob(f"{tmp_path}/out/batch=*")) == 3
    e = read("events").select("ts", F.col("event_type").alias("verdict"))
    counted = ingest.verdict_counts(e)
    assert counted.agg(F.sum("n")).first()[0] == e.count()


def test_payloads_drop_what_cannot_be_read(spark):
    from folioquery.sources import payloads

    rows = spark.createDataFrame([(1, '{"output": {"tables": [{"table": "a b", "columns": "x"}, {"fields": []}]}}'), (2, None), (3, "not json"), (4, '{"entities": []}')], "k int, p string")
    e = payloads.read_entities(rows, "k", "p")
    assert sorted((r.k, r.pos, r.name or "") for r in e.collect()) == [(1, 0, "AB"), (1, 1, "")]
    assert [(r.entity, r.name, r.type, r.required) for r in payloads.read_attributes(e, "k").collect()][0] == ("AB", "x", "string", False)
    rels = payloads.read_relationships(rows, "k", "p")
    assert rels.count() == 0 and [(r.k, r.kind) for r in payloads.dropped_entries(e, rels, "k").collect()] == [(1, "entity")]


def test_record_files(spark, tmp_path):
    from folioquery.sources import payloads

    (tmp_path / "a.json").write_text('{"records": [{"key": "k", "value": "v"}]}')
    (tmp_path / "b.json").write_text('[{"entity": "e", "key": "k", "raw_key": "K", "value": "w", "src": "T.1"}]')
    got = {tuple(r) for r in payloads.read_records(spark, str(tmp_path)).collect()}
    assert got == {("a.json", 0, "", "k", "k", "v", ""), ("b.json", 0, "e", "k", "K", "w", "T.1")}
