"""Queries on page geometry. Boxes come from the rows of lineitem and orders by arithmetic:
a page is an order or a customer, a box is one of its rows."""

from pyspark.sql import functions as F

from folioquery.functions.geometry import Box
from folioquery.functions.text import norm_alnum, words_of
from folioquery.operators import areas, bands, layout, links, reading
from folioquery.plans.registry import query

LINES_SQL = """lines AS (SELECT l_orderkey AS page, l_linenumber AS line, (l_partkey % 600)::DOUBLE AS x0, ((l_linenumber - 1) * 40 + l_suppkey % 30)::DOUBLE AS y0,
  l_partkey % 600 + 0.0 + 100 + l_quantity * 4 AS x1, (l_linenumber - 1) * 40.0 + l_suppkey % 30 + 10 + l_quantity / 5 AS y1 FROM lineitem)"""
BLOCKS_SQL = """blocks AS (SELECT page, CAST(floor(line / 3) AS BIGINT) AS block, min(x0) + 20 AS x0, min(y0) - 2 AS y0, max(x1) - 20 AS x1, max(y1) + 2 AS y1 FROM lines GROUP BY ALL)"""
_IN = """greatest(0, least(l.x1, b.x1) - greatest(l.x0, b.x0)) * greatest(0, least(l.y1, b.y1) - greatest(l.y0, b.y0))"""


def _lines(read):
    x = (F.col("l_partkey") % 600).cast("double")
    y = (F.col("l_linenumber") - 1) * 40.0 + F.col("l_suppkey") % 30
    return read("lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), x.alias("x0"), y.alias("y0"), (x + 100 + F.col("l_quantity") * 4).alias("x1"), (y + 10 + F.col("l_quantity") / 5).alias("y1"), "l_returnflag"
    )


def _blocks(lines, prefix):
    b = lines.groupBy("page", F.floor(F.col("line") / 3).alias("block")).agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    return b.select("page", "block", (F.col("a") + 20).alias(prefix + "x0"), (F.col("b") - 2).alias(prefix + "y0"), (F.col("c") - 20).alias(prefix + "x1"), (F.col("d") + 2).alias(prefix + "y1"))


@query(
    "attach_lines",
    f"""WITH {LINES_SQL}, {BLOCKS_SQL}, m AS (SELECT l.page, l.line, b.block, coalesce({_IN} / ((l.x1 - l.x0) * (l.y1 - l.y0)), 0) AS share FROM lines l LEFT JOIN blocks b USING (page)),
r AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY share DESC, block) AS k FROM m)
SELECT page, line, CASE WHEN share >= 0.5 THEN block END AS block, CASE WHEN share >= 0.5 THEN round(share, 6) ELSE 0 END AS share FROM r WHERE k = 1""",
)
def attach_lines(read):
    lines = _lines(read)
    return layout.attach_lines(lines, _blocks(lines, "b_"), ["page"])


@query(
    "containing_region",
    f"""WITH {LINES_SQL}, {BLOCKS_SQL}, m AS (SELECT l.page, l.line AS box, b.block AS region, (b.x1 - b.x0) * (b.y1 - b.y0) AS area, {_IN} AS common,
  coalesce((l.x0 + l.x1) / 2 BETWEEN b.x0 AND b.x1 AND (l.y0 + l.y1) / 2 BETWEEN b.y0 AND b.y1, false) AS inside FROM lines l LEFT JOIN blocks b USING (page)),
r AS (SELECT *, row_number() OVER (PARTITION BY page, box ORDER BY inside DESC, CASE WHEN inside THEN area END NULLS FIRST, common DESC NULLS LAST, region) AS k FROM m)
SELECT page, box, CASE WHEN inside OR common > 0 THEN region END AS region FROM r WHERE k = 1""",
)
def containing_region(read):
    lines = _lines(read)
    return layout.containing_region(lines.withColumnRenamed("line", "box"), _blocks(lines, "r_").withColumnRenamed("block", "region"), ["page"])


@query(
    "orphan_islands",
    f"""WITH {LINES_SQL}, g AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM lines WINDOW w AS (PARTITION BY page ORDER BY y0, x0, line, x1, y1)),
f AS (SELECT *, CASE WHEN px0 IS NOT NULL AND y0 - py1 <= 1.6 * (py1 - py0) AND least(x1, px1) - greatest(x0, px0) > 0 THEN 0 ELSE 1 END AS fresh FROM g),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y0, x0, line, x1, y1 ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT page, CAST(island AS BIGINT) AS island, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY page, island""",
)
def orphan_islands(read):
    return layout.island_boxes(layout.orphan_groups(_lines(read), ["page"]), ["page"])


@query(
    "widest_gap",
    f"""WITH {LINES_SQL}, g AS (SELECT page, x0 - max(x1) OVER (PARTITION BY page ORDER BY x0, x1, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, row_number() OVER (PARTITION BY page ORDER BY x0, x1, line) - 1 AS cut_after FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap DESC, cut_after) AS k FROM g WHERE gap > 1)
SELECT page, round(gap, 4) AS gap, cut_after FROM r WHERE k = 1""",
)
def widest_gap(read):
    return layout.widest_gap(_lines(read).withColumnRenamed("line", "box"), ["page"], "x")


@query(
    "gutter_candidates",
    """WITH v AS (SELECT l_suppkey AS page, l_partkey % 600 - CASE WHEN l_partkey % 600 BETWEEN 200 AND 320 THEN 180 ELSE 0 END AS x, l_quantity AS q FROM lineitem), w AS (SELECT page, x::DOUBLE AS x0, x + q AS x1 FROM v),
c AS (SELECT page, k, round(600 * (0.35 + 0.3 * k / 12), 4) AS g, x0, x1 FROM w, range(0, 13) t(k)),
n AS (SELECT page, k, g, count(*) AS n, sum(CASE WHEN x0 < g AND x1 > g THEN 1 ELSE 0 END) AS cross_n, sum(CASE WHEN x1 <= g THEN 1 ELSE 0 END) AS l, sum(CASE WHEN x0 >= g THEN 1 ELSE 0 END) AS r FROM c GROUP BY page, k, g),
b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY cross_n, k) AS o FROM n WHERE n >= 40 AND l * 4 >= n AND r * 4 >= n AND cross_n * 100 <= 6 * n)
SELECT page, g AS gutter, CAST(cross_n AS BIGINT) AS "cross" FROM b WHERE o = 1""",
)
def gutter_candidates(read):
    k = F.col("l_partkey") % 600
    x = (k - F.when(k.between(200, 320), 180).otherwise(0)).cast("double")
    return layout.gutter(read("lineitem").select(F.col("l_suppkey").alias("page"), F.lit(600.0).alias("width"), x.alias("x0"), (x + F.col("l_quantity")).alias("x1")), ["page"])


@query("reading_order_pages", python=True)
def reading_order_pages(read):
    """Reading order of each page; its number of boxes and the sum of position times line."""
    label = F.when(F.col("l_returnflag") == "R", "figure").when(F.col("l_returnflag") == "A", "text").otherwise("number")
    boxes = _lines(read).select("page", F.col("line").alias("box"), F.when(F.col("line") == 1, "text").otherwise(label).alias("label"), "x0", "y0", "x1", "y1")
    return reading.reading_order(boxes, ["page"]).groupBy("page").agg(F.count("*").alias("n"), F.sum("ord").alias("ord_sum"), F.sum(F.col("ord") * F.col("box")).alias("mark"))


@query(
    "block_routing_counts",
    """WITH b AS (SELECT CASE event_type WHEN 'click' THEN ' Doc_Title' WHEN 'view' THEN 'text' WHEN 'purchase' THEN 'table' WHEN 'signup' THEN 'chart' ELSE 'other thing' END AS label FROM events)
SELECT CASE WHEN lower(trim(label)) = 'doc_title' THEN 'TITLE' WHEN label = 'text' THEN 'TEXT' WHEN label = 'table' THEN 'TABLE' WHEN label = 'chart' THEN 'VISION' ELSE 'UNKNOWN' END AS block_type, count(*) AS n FROM b GROUP BY ALL""",
)
def block_routing_counts(read):
    e = F.col("event_type")
    label = F.when(e == "click", " Doc_Title").when(e == "view", "text").when(e == "purchase", "table").when(e == "signup", "chart").otherwise("other thing")
    return read("events").groupBy(layout.block_type(label).alias("block_type")).agg(F.count("*").alias("n"))


@query(
    "node_iou_cells",
    f"""WITH {LINES_SQL}, a AS (SELECT DISTINCT page, cx, cy FROM lines, unnest(range(CAST(floor(x0 / 4) AS BIGINT), CAST(floor(x1 / 4) AS BIGINT) + 1)) t(cx), unnest(range(CAST(floor(y0 / 4) AS BIGINT), CAST(floor(y1 / 4) AS BIGINT) + 1)) u(cy)),
b AS (SELECT DISTINCT page, cx, cy FROM lines, unnest(range(CAST(floor((x0 + 30) / 4) AS BIGINT), CAST(floor((x1 + 30) / 4) AS BIGINT) + 1)) t(cx), unnest(range(CAST(floor(y0 / 4) AS BIGINT), CAST(floor(y1 / 4) AS BIGINT) + 1)) u(cy))
SELECT coalesce(a.page, b.page) AS page, count(a.cx) AS n_a, count(b.cx) AS n_b, CAST(sum(CASE WHEN a.cx IS NOT NULL AND b.cx IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS common,
  round(sum(CASE WHEN a.cx IS NOT NULL AND b.cx IS NOT NULL THEN 1.0 ELSE 0 END) / count(*), 6) AS iou
FROM a FULL JOIN b ON a.page = b.page AND a.cx = b.cx AND a.cy = b.cy GROUP BY 1""",
    python=True,
)
def node_iou_cells(read):
    """Overlap of a page's boxes with themselves moved by 30, in cells of 4."""
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    each = _lines(read).select("page", sides, "x0", "y0", "x1", "y1")
    shift = F.col("side") * 30
    return areas.overlap_areas(each.withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift}), ["page"])


@query(
    "node_localisation",
    f"""WITH {LINES_SQL}, r AS (SELECT page AS doc, line, 1 + line % 2 AS page, x0, y0, x1, y1, CAST(floor(line / 3) AS BIGINT) AS g, CAST(floor((line + CASE WHEN CAST(x0 AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END) / 3) AS BIGINT) AS p FROM lines),
gold AS (SELECT doc, g AS node, CASE WHEN g = 2 AND doc % 3 = 0 THEN NULL ELSE line END AS box FROM r), pred AS (SELECT doc, p AS node, line AS box FROM r WHERE line <> 4),
n AS (SELECT DISTINCT doc, node FROM gold), gs AS (SELECT DISTINCT doc, node, box FROM gold WHERE box IS NOT NULL), ps AS (SELECT DISTINCT pred.* FROM pred JOIN n USING (doc, node)),
c AS (SELECT n.doc, n.node, (SELECT count(*) FROM gs WHERE gs.doc = n.doc AND gs.node = n.node) AS gold, (SELECT count(*) FROM ps WHERE ps.doc = n.doc AND ps.node = n.node) AS pred,
  (SELECT count(*) FROM gs JOIN ps USING (doc, node, box) WHERE gs.doc = n.doc AND gs.node = n.node) AS common FROM n),
cell AS (SELECT doc, line, page, cx, cy FROM r, unnest(range(CAST(floor(x0 / 4) AS BIGINT), CAST(floor(x1 / 4) AS BIGINT) + 1)) t(cx), unnest(range(CAST(floor(y0 / 4) AS BIGINT), CAST(floor(y1 / 4) AS BIGINT) + 1)) u(cy)),
ac AS (SELECT DISTINCT gs.doc, node, page, cx, cy FROM gs JOIN cell ON cell.doc = gs.doc AND line = box), bc AS (SELECT DISTINCT ps.doc, node, page, cx, cy FROM ps JOIN cell ON cell.doc = ps.doc AND line = box),
i AS (SELECT doc, node, sum(CASE WHEN ac.cx IS NOT NULL AND bc.cx IS NOT NULL THEN 1.0 ELSE 0 END) / count(*) AS iou FROM (SELECT *, cx AS k FROM ac) ac FULL JOIN (SELECT *, cx AS k FROM bc) bc USING (doc, node, page, k, cy) GROUP BY doc, node)
SELECT doc, node, gold, pred, common > 0 AND common = gold AND common = pred AS exact, CASE WHEN common > 0 AND common = gold AND common = pred THEN 1.0 WHEN gold = 0 OR pred = 0 THEN 0.0 ELSE round(iou, 6) END AS iou FROM c LEFT JOIN i USING (doc, node)""",
    python=True,
)
def node_localisation(read):
    """Blocks of three lines against blocks with some lines at the wrong one, over two pages; some blocks absent."""
    lines = _lines(read).select(F.col("page").alias("doc"), F.col("line").alias("box"), (1 + F.col("line") % 2).alias("page"), "x0", "y0", "x1", "y1")
    node = F.floor(F.col("box") / 3)
    gold = lines.select("doc", node.alias("node"), F.when(~((node == 2) & (F.col("doc") % 3 == 0)), F.col("box")).alias("box"))
    wrong = F.when(F.col("x0").cast("long") % 4 == 0, 1).otherwise(0)
    pred = lines.where("box <> 4").select("doc", F.floor((F.col("box") + wrong) / 3).alias("node"), "box")
    return areas.localisation(gold, pred, lines, "doc")


@query(
    "box_geometry_audit",
    f"""WITH {LINES_SQL} SELECT page % 10 AS shard, count(*) AS n, CAST(sum(CASE WHEN x0 < -1 OR y0 < -1 OR x1 > 801 OR y1 > 301 THEN 1 ELSE 0 END) AS BIGINT) AS outside,
  CAST(sum(CASE WHEN x1 - x0 <= 104 OR y1 <= y0 THEN 1 ELSE 0 END) AS BIGINT) AS degenerate, round(avg((x1 - x0) * (y1 - y0)), 4) AS mean_area FROM lines GROUP BY 1""",
)
def box_geometry_audit(read):
    b = Box()
    out = (b.x0 < -1) | (b.y0 < -1) | (b.x1 > 801) | (b.y1 > 301)
    return _lines(read).groupBy((F.col("page") % 10).alias("shard")).agg(
        F.count("*").alias("n"), F.count_if(out).alias("outside"), F.count_if((b.width <= 104) | (b.height <= 0)).alias("degenerate"), F.round(F.avg(b.area), 4).alias("mean_area")
    )


@query(
    "markdown_stitch",
    r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|h2|li|p)>[^<]*')) AS tag, generate_subscripts(regexp_extract_all(html, '<(?:h1|h2|li|p)>[^<]*'), 1) AS ord FROM pages),
m AS (SELECT page_id, ord, CASE WHEN tag LIKE '<h1>%' THEN '# ' || substr(tag, 5) WHEN tag LIKE '<h2>%' THEN '## ' || substr(tag, 5) WHEN tag LIKE '<li>%' THEN '- ' || substr(tag, 5) ELSE substr(tag, 4) END AS md FROM e)
SELECT page_id, count(*) AS n_blocks, CAST(sum(length(md)) AS BIGINT) AS n_chars, md5(string_agg(md, chr(10) || chr(10) ORDER BY ord)) AS md_md5 FROM m GROUP BY page_id""",
)
def markdown_stitch(read):
    """Headings, items and paragraphs of a page as Markdown, in order."""
    found = F.regexp_extract_all("html", F.lit("<(?:h1|h2|li|p)>[^<]*"), F.lit(0))
    e = read("pages").select("page_id", F.posexplode(found).alias("ord", "tag"))
    md = (
        F.when(F.col("tag").startswith("<h1>"), F.concat(F.lit("# "), F.expr("substr(tag, 5)")))
        .when(F.col("tag").startswith("<h2>"), F.concat(F.lit("## "), F.expr("substr(tag, 5)")))
        .when(F.col("tag").startswith("<li>"), F.concat(F.lit("- "), F.expr("substr(tag, 5)")))
        .otherwise(F.expr("substr(tag, 4)"))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda s: s["md"]), "\n\n")
    return e.withColumn("md", md).groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("md")).alias("n_chars"), F.md5(joined).alias("md_md5"))


@query(
    "resume_todo_pages",
    "SELECT o_custkey AS doc, count(*) AS todo FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') GROUP BY o_custkey",
)
def resume_todo_pages(read):
    """Pages of each document that have no finished part yet."""
    done = read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read("orders").join(done, "o_orderkey", "left_anti").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("todo"))


FORM_SQL = """form AS (SELECT o_orderkey % 23 AS page, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'header' WHEN o_orderkey % 5 < 3 THEN 'label' ELSE 'value' END AS kind,
  o_custkey * 31 % 701 AS x0, o_orderkey * 7 % 1009 AS y0, o_custkey * 31 % 701 + 20 + o_orderkey % 50 AS x1, o_orderkey * 7 % 1009 + 12 AS y1 FROM orders),
v AS (SELECT * FROM form WHERE kind = 'value'), q AS (SELECT * FROM form WHERE kind = 'label'), h AS (SELECT * FROM form WHERE kind = 'header')"""


def _form(read):
    """Values, labels and headers of pages of scattered boxes, one an order."""
    k, x, y = F.col("o_orderkey"), F.col("o_custkey") * 31 % 701, F.col("o_orderkey") * 7 % 1009
    kind = F.when(k % 5 == 0, "header").when(k % 5 < 3, "label").otherwise("value")
    rows = read("orders").select((k % 23).alias("page"), k.alias("id"), kind.alias("kind"), x.alias("x0"), y.alias("y0"), (x + 20 + k % 50).alias("x1"), (y + 12).alias("y1"), F.concat_ws(" ", "o_orderpriority", (k % 7).cast("string")).alias("text"))
    return [rows.where(F.col("kind") == n).drop("kind") for n in ("value", "label", "header")]


@query(
    "label_candidates",
    f"""WITH {FORM_SQL}, p AS (SELECT v.page, v.id AS value, q.id AS label, v.x0 - q.x1 AS dx, v.y0 - q.y1 AS dy,
  (least(v.y1, q.y1) - greatest(v.y0, q.y0)) / least(v.y1 - v.y0, q.y1 - q.y0) AS tall, (least(v.x1, q.x1) - greatest(v.x0, q.x0)) / least(v.x1 - v.x0, q.x1 - q.x0) AS wide FROM v JOIN q ON v.page = q.page AND q.y1 >= v.y0 - 40 AND q.y0 <= v.y1)
SELECT page, value, label, CAST(dx AS DOUBLE) AS gap, 'row' AS how FROM p WHERE tall > 0.5 AND dx BETWEEN -2 AND 250
UNION ALL SELECT page, value, label, CAST(dy AS DOUBLE), 'above' FROM p WHERE wide > 0.3 AND dy BETWEEN -2 AND 40""",
    python=True,
)
def label_candidates(read):
    """Labels left of a value on its row, or just above it."""
    values, labels, _ = _form(read)
    got = links.candidates(values, labels, ["page"])
    return got.select("page", "value", "label", F.col("gap").cast("double").alias("gap"), "how")


@query(
    "header_above",
    f"""WITH {FORM_SQL} SELECT v.page, v.id, (SELECT arg_min(h.id, struct_pack(a := -h.y1, b := h.id)) FROM h WHERE h.page = v.page AND h.y1 <= v.y0 + 2) AS header FROM v""",
)
def header_above(read):
    """The nearest header above each value."""
    values, _, headers = _form(read)
    return links.header_above(values, headers, ["page"]).select("page", "id", "header")


@query("form_fields_xml", python=True)
def form_fields_xml(read):
    """Values under their labels and headers, a document a page."""
    return links.fields_xml(links.fields(*_form(read), ["page"]), ["page"], "form")


@query(
    "band_reading_order",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS norm FROM documents),
w AS (SELECT doc_id, unnest(string_split(norm, ' ')) AS text, generate_subscripts(string_split(norm, ' '), 1) - 1 AS i FROM d WHERE norm <> ''),
f AS (SELECT doc_id, i, text, i // 8 AS r, i % 8 AS j, (i // 8) % 7 = 3 OR doc_id % 3 = 0 AS wide FROM w),
p AS (SELECT doc_id, i, text, r, CASE WHEN wide THEN 20 + j * 72 WHEN j < 4 THEN 20 + j * 65 ELSE 330 + (j - 4) * 65 END AS x0, CASE WHEN wide THEN 20 + j * 72 + 66 WHEN j < 4 THEN 70 + j * 65 ELSE 380 + (j - 4) * 65 END AS x1 FROM f),
t AS (SELECT doc_id, x, count(*) AS n, count(*) FILTER (x0 < x AND x < x1) AS c, count(*) FILTER (x1 <= x) AS l, count(*) FILTER (x0 >= x) AS h FROM p, (SELECT 600 * (0.44 + 0.01 * k)::DOUBLE AS x FROM range(13) u(k)) GROUP BY ALL),
g AS (SELECT doc_id, arg_min(x, c * 1000 + x) AS x FROM t WHERE l >= 0.25 * n AND h >= 0.25 * n GROUP BY doc_id HAVING any_value(n) >= 40 AND min(c) <= 0.06 * any_value(n)),
q AS (SELECT p.*, g.x, lead(x0) OVER (PARTITION BY p.doc_id, r ORDER BY x0) - x1 AS gap FROM p LEFT JOIN g USING (doc_id)),
rows_ AS (SELECT doc_id, r, any_value(x) AS x, bool_or(x0 < x AND x < x1) AS crossed, max(x1) FILTER (x1 <= x) AS l, min(x0) FILTER (x0 >= x) AS h, list_sort(list(gap) FILTER (gap > 0)) AS gaps,
  string_agg(text, ' ' ORDER BY x0) AS whole, string_agg(text, ' ' ORDER BY x0) FILTER (x1 <= x) AS lt, string_agg(text, ' ' ORDER BY x0) FILTER (x0 >= x) AS rt FROM q GROUP BY doc_id, r),
s AS (SELECT *, CASE WHEN x IS NULL THEN 'page' WHEN crossed THEN 'across' WHEN l IS NULL THEN 'right' WHEN h IS NULL THEN 'left' WHEN h - l > greatest(8, 3 * coalesce(gaps[len(gaps) // 2 + 1], 1)) THEN 'both' ELSE 'across' END AS side FROM rows_),
o AS (SELECT *, x IS NULL OR sum(CASE side WHEN 'both' THEN 2 WHEN 'left' THEN 1 WHEN 'right' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) <= sum(CASE WHEN side = 'across' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS one,
  coalesce(sum(CASE WHEN side = 'across' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM s),
e AS (SELECT doc_id, one, r, 0 AS b, 2 AS k, whole AS text FROM o WHERE one UNION ALL SELECT doc_id, one, r, band, 2, whole FROM o WHERE NOT one AND side = 'across'
  UNION ALL SELECT doc_id, one, r, band, 0, lt FROM o WHERE NOT one AND side IN ('both', 'left') UNION ALL SELECT doc_id, one, r, band, 1, rt FROM o WHERE NOT one AND side IN ('both', 'right'))
SELECT doc_id, CASE WHEN one THEN 1 ELSE 2 END AS columns, row_number() OVER (PARTITION BY doc_id ORDER BY b, k, r) - 1 AS line, text FROM e""",
    python=True,
)
def band_reading_order(read):
    """Words of each document set in two columns with lines across, a third of them in one, read back by bands."""
    w = read("documents").select("doc_id", F.posexplode(words_of(norm_alnum(F.col("text")))).alias("id", "text")).where("text <> ''")
    j, wide = F.col("id") % 8, (F.floor(F.col("id") / 8) % 7 == 3) | (F.col("doc_id") % 3 == 0)
    x0 = F.when(wide, 20 + j * 72).when(j < 4, 20 + j * 65).otherwise(330 + (j - 4) * 65)
    set_ = w.select("doc_id", "id", "text", x0.alias("x0"), (x0 + F.when(wide, 66).otherwise(50)).alias("x1"), (F.floor(F.col("id") / 8) * 14.0 + F.col("id") % 3).alias("top"))
    return bands.band_lines(bands.with_rows(set_, "doc_id"), "doc_id", F.lit(600.0))
