"""Operators on small hand-made frames."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions.geometry import Box, polygon_box
from folioquery.functions.vectors import dot
from folioquery.operators import align, components, corpus, graph, layout, metrics, placement, reading, records
from folioquery.plans.workspace import Workspace


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_text_forms(spark):
    assert values(spark, T.norm_alnum, "  Ab-C\t9é ", "") == ["ab c 9", ""]
    assert values(spark, T.snake, "orderDate", "9 lives", "--", None) == ["order_date", "n9_lives", "field", "field"]
    assert values(spark, T.pascal, "order_line", "") == ["OrderLine", "Entity"]
    assert values(spark, T.norm_value, '"12.5%"', "[3]", "Yes.", "%", "5 ± 1 [4, 12]", "\uff11\uff12", "x [,]", "`a`") == ["12.5", "[3]", "yes", "%", "5 +- 1", "12", "x [,]", "`a`"]
    assert values(spark, T.escape_latex, "a_b & {c}\\", None) == [r"a\_b \& \{c\}\textbackslash{}", ""]
    assert values(spark, lambda c: T.unescape_latex(T.escape_latex(c)), "50% of #1_$x^2~{a}&b") == ["50% of #1_$x^2~{a}&b"]
    assert values(spark, T.strip_comments, "a % b\n50\\% c") == ["a \n50\\% c"]
    assert values(spark, T.dehyphenate, "exam-\nple") == ["example"]
    assert values(spark, T.xml_escape, 'a<b>&"\x01') == ["a&lt;b&gt;&amp;&quot;"]
    assert values(spark, T.xml_tag, "1 st", "", "ok") == ["_1_st", "element", "ok"]
    assert values(spark, T.bare_label, "B-ANSWER", "O") == ["ANSWER", "O"]
    assert values(spark, lambda c: T.semantic_type(c)["type"], "VARCHAR", "Money", "what", None, "int_8", "PhoneNumber", "decimal(10,2)") == ["string", "currency", "string", "string", "integer", "phone", "decimal"]
    assert values(spark, T.parse_relationship, "Order.customer_id -> Customer.id")[0].asDict() == {"child": "Order", "child_column": "customer_id", "parent": "Customer", "parent_column": "id"}
    assert values(spark, T.as_bool, "Yes", "0", "?", None) == [True, False, False, False]
    assert values(spark, lambda c: T.hms(c.cast("int")), "5", "65", "3700") == ["5s", "1m05s", "1h01m"]


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, None if len(r) < 5 else r[4], *map(float, r[:4])) for i, r in enumerate(rows)], "page int, box int, label string, x0 double, y0 double, x1 double, y1 double")


def order(spark, *rows):
    return [r.box for r in reading.reading_order(boxes(spark, *rows), ["page"]).orderBy("ord").collect()]


def test_geometry(spark):
    df = boxes(spark, (0, 0, 10, 10)).select("*", *[F.lit(float(v)).alias("b_" + n) for n, v in zip(("x0", "y0", "x1", "y1"), (5, 5, 15, 25))])
    a, b = Box(), Box("b_")
    r = df.select(a.area, a.common_area(b), a.inside(b), F.round(a.iou(b), 4), a.direction, b.direction, a.overlap(b, "x"), a.written()).first()
    assert tuple(r) == (100.0, 25.0, 0.25, round(25 / 275, 4), "h", "v", 5.0, "0.0,0.0,10.0,10.0")
    poly = spark.sql("select array(array(1.0, 5.0), array(3.0, 2.0)) p").select(*polygon_box(F.col("p"))).first()
    assert list(map(float, poly)) == [1, 2, 3, 5]


def test_reading_order(spark):
    left = [(80, y, 480, y + 80) for y in range(200, 501, 100)]
    right = [(520, y, 920, y + 80) for y in range(200, 501, 100)]
    assert order(spark, *left) == [0, 1, 2, 3]
    assert order(spark, *left, *right) == list(range(8))
    assert order(spark, *(x for pair in zip(left, right) for x in pair)) == [0, 2, 4, 6, 1, 3, 5, 7]
    titled = order(spark, (80, 100, 920, 160), *left, *right)
    assert titled[0] == 0
    got = order(spark, (0, 0, 100, 20), (0, 40, 100, 60, "figure"), (0, 80, 100, 100), (40, 990, 60, 1000, "number"))
    assert got[-1] == 3 and sorted(got) == [0, 1, 2, 3]
    assert order(spark, (0, 0, 5, 5, "figure"), (0, 9, 5, 15, "header")) == [0, 1]


def test_block_types(spark):
    assert values(spark, layout.block_type, "Doc_Title ", "table_caption", "seal", "?", None) == ["TITLE", "TEXT", "VISION", "UNKNOWN", "UNKNOWN"]


def test_attach_at_half(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 20.0, 10.0, 30.0), (2, 0, 0.0, 0.0, 1.0, 1.0)], "page int, line int, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([(1, 7, 5.0, 0.0, 20.0, 10.0), (1, 8, 5.1, 20.0, 20.0, 30.0)], "page int, block int, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    got = {(r.page, r.line): r.block for r in layout.attach_lines(lines, blocks, ["page"]).collect()}
    assert got == {(1, 0): 7, (1, 1): None, (2, 0): None}


def brute_monotone(boxes, ratio):
    best = (0, ())
    for choice in itertools.product(*[[None, *cs] for _, cs in boxes]):
        picked = [c for c in choice if c]
        if any(a[0] > b[0] for a, b in zip(picked, picked[1:])):
            continue
        used: dict = {}
        for seg, size, room, _ in picked:
            used[seg] = used.get(seg, 0) + size
        if all(used[s] <= int(ratio * room) for s, _, room, _ in picked):
            best = max(best, (sum(c[3] for c in picked), ()))
    return best[0]


def test_monotone_assignment_is_best():
    random.seed(3)
    for _ in range(150):
        rooms = [random.randrange(3, 12) for _ in range(4)]
        rows = []
        for b in range(random.randrange(1, 6)):
            size = random.randrange(2, 9)
            rows.append((b, [(s, size, rooms[s], random.randrange(1, 50)) for s in random.sample(range(4), random.randrange(1, 4))]))
        gain, chosen = align.best_monotone(rows, 1.5)
        assert gain == brute_monotone(rows, 1.5)
        assert [s for _, s in chosen] == sorted(s for _, s in chosen)


def test_confusion(spark):
    rows = spark.createDataFrame([("en", 1, 1), ("en", 1, 2), ("en", 1, None), ("de", None, None), ("de", None, 3)], "lang string, gold int, pred int")
    got = {r.stratum: r for r in metrics.confusion_scores(metrics.confusion(rows, "lang")).collect()}
    a = got["all"]
    assert (a.n, a.tp, a.fp, a.fn, a.tn, a.false_attribution_rate) == (5, 1, 2, 2, 1, 0.5)
    assert got["de"].f1 is None and got["de"].recall is None and got["en"].f1 == 0.4


def test_upper_median(spark):
    assert spark.createDataFrame([(v,) for v in (4, 1, 3, 2, None)], "v int").agg(metrics.upper_median("v")).first()[0] == 3


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    random.seed(seed)
    n = 60
    edges = [(random.randrange(n), random.randrange(n)) for _ in range([5, 40, 90, 0][seed])] + ([(i, i + 1) for i in range(100, 160)] if seed == 1 else []) + ([(0, i) for i in range(200, 260)] if seed == 2 else [])
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {x: root(x) for x in linked}


@pytest.mark.parametrize(("a_file", "most"), [(10_000, 1), (30, 8)])
def test_component_rounds_write_few_files(spark, monkeypatch, a_file, most):
    """As many files as the rows need, with many shuffle partitions and no coalescing of them."""
    monkeypatch.setattr(components, "ROWS_A_FILE", a_file, raising=False)
    made, real = [], Workspace.table

    def table(self, df, name="t"):
        out = real(self, df, name)
        made.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Workspace, "table", table)
    own = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)]
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r.node: r.component for r in got} == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 600)}
    assert made[0] > most >= max(made[1:]) and (most == 1 or max(made[1:]) > 1)


def test_pipe_tables(spark):
    doc = "intro\nname | x y | \n--- | --- | ---\nA | 1 | 9\nB | - | 2\nC | C |\n\nafter | not"
    got = [tuple(r) for r in records.pipe_tables(spark.createDataFrame([(1, doc)], "d int, t string"), "d", "t").select("line", "header", "entity", "value").orderBy("line", "col").collect()]
    assert got == [(3, "name", "", "A"), (3, "x_y", "A", "1"), (4, "name", "", "B"), (5, "name", "", "C"), (5, "x_y", "", "C")]


def test_rule_scores(spark):
    rows = [(1, "Car"), (1, "person"), (2, "person"), (3, "smoke"), (3, "ladder"), (4, "debris")]
    got = {r.k: (r.verdict, r.confidence) for r in records.rule_scores(spark.createDataFrame(rows, "k int, o string"), "k", "o").collect()}
    assert got[1] == ("Vehicle collision / traffic accident", 1.0)
    assert got[2] == got[4] == ("Undetermined incident", 0.0)
    assert got[3] == ("Fire / smoke incident", 0.5)


def test_greedy_pairs_take_best_first(spark):
    rows = [(1, 0, 0, 0.9), (1, 0, 1, 0.95), (1, 1, 1, 0.9), (1, 1, 0, 0.7), (1, 2, 2, 0.5)]
    got = corpus.greedy_pairs(spark.createDataFrame(rows, "g int, i int, j int, score double"), ["g"], "i", "j").collect()
    assert {(r.i, r.j) for r in got} == {(0, 1), (1, 0)}


def test_vocabulary(spark):
    v = [(1, "a", [1.0, 0.0]), (1, "b", [0.99, 0.1]), (1, "c", [0.0, 1.0])]
    got = {r.key: r.cluster for r in records.induce_vocabulary(spark.createDataFrame(v, "g int, key string, vec array<double>"), "g", "key").collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_vocabulary_of_a_large_block_holds_no_matrix():
    """Equal to joining the nearest two of a matrix of distances; 4,000 vectors, 1,000 of them copies, in little memory."""
    import tracemalloc

    def plain(v, threshold):
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        groups = [[i] for i in range(len(v))]
        while len(groups) > 1:
            gap, i, j = min((1 - v[a].mean(0) @ v[b].mean(0), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
            if gap > threshold:
                break
            groups[j] += groups.pop(i)
        return [min(g) for k in range(len(v)) for g in groups if k in g]

    rng = np.random.default_rng(2)
    for threshold in (0.05, 0.45, 0.8, 1.0) * 3:
        v = rng.normal(size=(rng.integers(1, 20), 3))
        v = np.concatenate([v, v[:3], np.zeros((2, 3))])
        assert records.average_linkage(v, threshold) == plain(v, threshold)
    v = rng.normal(size=(3000, 16))
    tracemalloc.start()
    got = records.average_linkage(np.concatenate([v, v[:1].repeat(1000, 0)]), 0.3, room=100_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got[3000:]) == {got[0]} and most < 20_000_000


@pytest.mark.parametrize("part", [3, 4_096])
def test_vectors_meet_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(align, "PART", part)
    monkeypatch.setattr(align, "TILE", 2)
    rng = np.random.default_rng(4)
    v = {i: [float(x) for x in rng.choice([-0.5, 0.0, 0.5, 0.1, 0.00045], 5)] for i in range(14)}
    v |= {14: None, 15: [0.5, None, 0.0, 0.0, 0.0], 16: [1.0, 0.0], 17: [0.5, 0.5], 18: [], 19: [float("nan")] * 5}
    rows = spark.createDataFrame([(None if i == 3 else i % 2, i, x) for i, x in v.items()], "g int, node long, vec array<double>")
    other = rows.select("g", F.col("node").alias("box"), F.col("vec").alias("vec2"))
    plain = rows.join(other, "g").withColumn("score", F.round(dot(F.col("vec"), F.col("vec2")), 4)).where("score >= 0.2")
    got = align.align_vectors(rows, other, "g", 0.2)
    key = lambda df: sorted(map(str, df.select("g", "node", "box", "score").collect()))
    assert key(got) == key(plain) and got.count() > 20
    assert "ArrowInPandas" in (how := got._jdf.queryExecution().executedPlan().toString()) or "FlatMapGroupsInArrow" in how


def test_levels_and_cycles(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "parent string, child string")
    assert {r.name: r.level for r in graph.levels(names, edges).collect()} == {"a": 1, "b": 2, "c": 3, "d": 1}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "parent string, child string")
    with pytest.raises(ValueError):
        graph.levels(names, loop, 6)


def test_scopes_of_orphans(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone")], "node string, parent string")
    assert {r.node: r.root for r in graph.scopes(links).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_reading_order_puts_furniture_beside_its_neighbour(spark):
    """Notes and page numbers are furniture, in the smaller rule set body text."""
    page = [(80, 100, 480, 180, "text"), (80, 200, 480, 280, "text"), (520, 100, 920, 180, "text"), (80, 290, 480, 300, "footnote")]
    assert order(spark, *page) == [0, 1, 3, 2]
    kinds = boxes(spark, (0, 0, 1, 1, "page_number"), (0, 0, 1, 1, "figure_title")).select("box", reading.category(F.col("label")).alias("a"), reading.category(F.col("label"), reading.PLAIN).alias("b"))
    assert [tuple(r)[1:] for r in kinds.orderBy("box").collect()] == [("marginal", "text"), ("title", "title")]
    plain = reading.reading_order(boxes(spark, *page), ["page"], reading.PLAIN).orderBy("ord").collect()
    assert [r.box for r in plain] == [0, 1, 3, 2]
    figure = [(80, 100, 480, 180, "text"), (80, 200, 480, 280, "text"), (520, 190, 920, 290, "figure"), (520, 100, 920, 180, "text")]
    assert order(spark, *figure) == [0, 1, 3, 2]


def test_reading_costs_agree(spark):
    """The column form of the cost and the one that places boxes."""
    import numpy as np

    rng = np.random.default_rng(1)
    lo = rng.integers(0, 800, (40, 2))
    b = np.concatenate([lo, lo + rng.integers(1, 300, (40, 2))], 1).astype(float)
    rows = [(int(i), *map(float, b[i]), *map(float, b[j])) for i in range(5) for j in range(40)]
    df = spark.createDataFrame(rows, "i int, x0 double, y0 double, x1 double, y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    for kind in ("cross", "title", "vision", "marginal"):
        got = [r[0] for r in df.select(reading.distance(F.lit(kind), Box(), Box("b_"), F.lit(1000.0))).collect()]
        want = [x for i in range(5) for x in reading._costs(b, i, np.arange(40), kind, 1000.0, reading.Rules())]
        assert np.allclose(got, want)


def test_cut_of_many_boxes():
    import numpy as np

    n = 5000
    b = np.array([(0, 20 * i, 100, 20 * i + 10) for i in reversed(range(n))], float)
    assert reading.cut(b, np.arange(n), reading.Rules()) == list(range(n))[::-1]
    full = np.array([(0, 0, 100, 10), (0, 20, 45, 200), (55, 20, 100, 200), (0, 210, 100, 220)], float)
    assert reading.cut(full, np.arange(4), reading.Rules()) == [0, 1, 2, 3]
    assert list(reading.spanning(np.array([(0, 0, 100, 10), (0, 20, 45, 30), (55, 20, 100, 30)], float), np.arange(3), reading.Rules())) == [0]


def test_regional_density(spark):
    df = spark.createDataFrame([(1, True, 0.0, 0.0, 2.0, 2.0), (1, False, 0.0, 0.0, 1.0, 8.0), (2, True, 0.0, 0.0, 1.0, 1.0)], "page int, wide boolean, x0 double, y0 double, x1 double, y1 double")
    assert {r.page: r.density for r in reading.regional_density(df, ["page"], "wide").collect()} == {1: 0.5, 2: float("inf")}


def test_text_kinds_and_keys(spark):
    assert values(spark, T.norm_key, " Learning-Rate (%) ", "a__b", "É-é") == ["learning_rate_(%)", "a_b", "é_é"]
    assert values(spark, lambda c: T.node_kind(c, F.lit(False)), "$x$", "a | --- | b", "| a", "ok", "![x](y)", "words here", None) == ["formula", "table", "table", "marker", "image", "prose", "marker"]


def test_word_error_rate(spark):
    from folioquery.operators import cards

    df = spark.createDataFrame([(1, "the cat sat", "the cat sat down"), (2, "a b c", "x b"), (3, "", "a"), (4, None, None)], "k int, ref string, hyp string")
    assert {r.k: (r.word_edits, r.wer) for r in cards.with_wer(df, "k", "ref", "hyp").collect()} == {1: (1, 0.3333), 2: (2, 0.6667), 3: (1, 1.0), 4: (0, 0.0)}


def test_noise_is_steady(spark):
    from folioquery.functions import forms

    text = "the quick brown fox " * 200
    a, b = values(spark, lambda c: forms.charwise_noise(c, 10), text, text)
    assert a == b != text and values(spark, lambda c: forms.charwise_noise(c, 0), text) == [text]
    assert 0.8 * len(text) < len(a) < 1.1 * len(text)


def test_page_files(spark, tmp_path):
    import json

    from folioquery.sources import pages

    for doc, files in (("a", ["p1", "p2"]), ("b", ["p1"])):
        (tmp_path / doc).mkdir()
        (tmp_path / doc / "manifest.json").write_text(json.dumps({"pages": [{"page": i + 1, "dir": f"p{i + 1}"} for i in range(2)]}))
        for f in files:
            (tmp_path / doc / f).mkdir()
            (tmp_path / doc / f / "paragraph.json").write_text(json.dumps({"width": 10, "height": 20, "boxes": [{"text": None, "bbox": [0, 1, 2, 3]}, {"text": "t", "label": "title", "bbox": [1, 1, 2, 2], "order": 4}]}))
    got = pages.read_pages(spark, f"file://{tmp_path}").orderBy("doc", "page").collect()
    assert [(r.doc, r.page, r.width) for r in got] == [("a", 1, 10.0), ("a", 2, 10.0), ("b", 1, 10.0)]
    assert [tuple(x) for x in got[0].boxes] == [("", "unlabeled", [0, 1, 2, 3], None), ("t", "title", [1, 1, 2, 2], 4)]
    files = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "doc string, file string")
    assert {r.doc: r.built for r in pages.built(files, files.where("file = 'x'"), ["doc"]).collect()} == {"a": False, "b": True}
    assert values(spark, pages.granularities, "all", "word") == [["paragraph", "line", "word"], ["word"]]


def test_matching_ratio(spark):
    from difflib import SequenceMatcher

    pairs = [("abcd", "bcde"), ("", ""), ("x", ""), ("the quick fox", "a quick brown fox"), ("ab" * 150, "ba" * 150)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", metrics.matching_ratio(F.col("a"), F.col("b"))).collect()
    assert dict(map(tuple, got)) == {i: SequenceMatcher(None, *p).ratio() for i, p in enumerate(pairs)}


def test_ranked(spark):
    values = [(v,) for v in [None, *(i * 7919 % 1009 for i in range(1000)), 5000]]
    got = graph.ranked(spark.createDataFrame(values, "v long").repartition(5), "v", "at", 8).collect()
    assert [r.v for r in sorted(got, key=lambda r: r["at"])] == [None, *sorted(v for (v,) in values if v is not None)]
    assert sorted(r["at"] for r in got) == list(range(1002))
    assert graph.ranked(spark.createDataFrame([], "v long"), "v", "at").count() == 0


def test_overlaps_across_stretches(spark):
    spans = lambda rows: spark.createDataFrame(rows, "doc_id long, i long, start long, stop long")
    tokens = [(1, i, i * 37, i * 37 + (i % 3) * 300) for i in range(40)]
    placed = [(1, 0, 0, 2000), (1, 1, 255, 257), (1, 2, 256, 256), (1, 3, 600, 1300), (2, 4, 0, 9)]
    got = placement.token_owner(spans(tokens).withColumnRenamed("i", "idx"), spans(placed).withColumnRenamed("i", "item_id")).collect()
    want = [(t[0], t[1], p[1]) for t in tokens for p in placed if t[0] == p[0] and t[2] < p[3] and t[3] > p[2]]
    assert sorted((r.doc_id, r.idx, r.item_id) for r in got) == sorted(want)


def test_closure_of_a_deep_tree_is_an_error(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 5)], "child long, parent long")
    assert align.closure(edges, 4).count() == 15
    with pytest.raises(ValueError):
        align.closure(edges, 3).count()


def test_islands_of_tied_lines_dont_depend_on_input_order(spark):
    """Two lines at one place, a tall one that the third line may follow and a flat one that it may not."""
    rows = [(1, 1, 0.0, 0.0, 50.0, 40.0), (1, 1, 0.0, 0.0, 60.0, 4.0), (1, 2, 0.0, 60.0, 50.0, 70.0)]
    found = []
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "page int, line int, x0 double, y0 double, x1 double, y1 double").coalesce(1)
        found.append(sorted(tuple(r) for r in layout.island_boxes(layout.orphan_groups(df, ["page"]), ["page"]).collect()))
    assert found[0] == found[1]
    assert [r[2] for r in found[0]] == [2, 1]


def test_sql_of_islands_breaks_ties_as_the_query_does(spark):
    """Lines at one place under one number, in two orders of the input."""
    import duckdb
    from folioquery.plans import catalog
    from folioquery.plans.q_layout import _lines

    rows = [(p, part, 3, 1 + line, q) for p in range(40) for line in range(3) for part, q in ((7, 50.0), (607, 1.0), (1207, 20.0))]
    cols = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, "N") for r in some], kinds).coalesce(1)
        got = sorted(tuple(r) for r in layout.island_boxes(layout.orphan_groups(_lines(lambda _: df), ["page"]), ["page"]).collect())
        db = duckdb.connect()
        db.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE)")
        db.execute(f"INSERT INTO lineitem ({cols}) VALUES {', '.join(map(str, some))}")
        assert got == sorted(db.execute(catalog.oracle_sql()["orphan_islands"]).fetchall())


def test_long_texts_with_words_left_out_need_no_distance(spark):
    """Two million characters a side: all pairs of them can't be compared."""
    long = "abcdefghi " * 200_000
    rows = [(long, long[:1000] + long[2000:]), ("kitten", "sitting"), ("abc", ""), ("", "x"), (None, "x"), ("x", None), ("Zürich", "Zrich")]
    df = spark.createDataFrame(rows, "r string, h string")
    got = [r.edits for r in metrics.with_cer(df, "r", F.col("h")).select("edits").collect()]
    assert got == [1000, 3, 3, 1, None, None, 1]
