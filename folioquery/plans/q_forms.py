"""Queries on forms of values, sources and replies, score cards, schemas and grounded boxes.
Inputs are put together from the plain tables' columns."""

from pyspark.sql import functions as F

from folioquery.functions import forms, text
from folioquery.operators import cards, reading, schemas
from folioquery.plans.registry import query
from folioquery.sources import pages

_col, _lit, _cat = F.col, F.lit, F.concat


@query(
    "key_and_value_forms",
    r"""SELECT p_partkey, trim(regexp_replace(lower(p_type || ' -  ' || p_brand), '[ _-]+', '_', 'g'), '_') AS key, lower(p_name) AS entity, lower(p_brand) || '%x' AS value,
  CASE WHEN regexp_matches(p_type, '^[0-9]') THEN 'f_' ELSE '' END || 'f_' || p_size || '_' || trim(regexp_replace(lower(p_type), '[^0-9a-z]+', '_', 'g'), '_') AS slug,
  trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9_ ]', ' ', 'g') || ' ' || p_size, ' +', '_', 'g'), '_') AS header, trim(replace(replace(lower(p_brand), '-', ' '), '_', ' ')) AS phrase, p_size % 2 = 0 AS from_table FROM part""",
    python=True,
)
def key_and_value_forms(read):
    even = _col("p_size") % 2 == 0
    return read("part").select(
        "p_partkey",
        text.norm_key(F.concat_ws(" -  ", "p_type", "p_brand")).alias("key"),
        text.norm_entity(_cat("p_name", _lit(" [12, "), "p_size", _lit("]"))).alias("entity"),
        text.norm_value(_cat(_lit('"'), "p_brand", _lit('%x"'))).alias("value"),
        forms.slug(F.concat_ws(" ", "p_size", "p_type")).alias("slug"),
        forms.header_key(_cat("p_brand", _lit(" \\textbf ("), "p_size", _lit(")"))).alias("header"),
        forms.phrase(_cat(_lit("_"), "p_brand", _lit("-"))).alias("phrase"),
        forms.table_sourced(F.when(even, " t.3").otherwise("p.5")).alias("from_table"),
    )


@query(
    "caption_harvest",
    r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS t FROM documents), c AS (SELECT lang, trim(trim(trim(regexp_replace('SECTION 4 - ' || t || ':', '[ \t\n\x0B\f\r]+', ' ', 'g')), ':—-–')) AS t FROM l),
d AS (SELECT lang, regexp_replace(t, '^(?i:SECTION)[ \t]+[0-9]+[ \t]*[—–-][ \t]*', '') AS t FROM c)
SELECT lang, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars, count(*) FILTER (length(t) >= 3 AND len(string_split(t, ' ')) <= 4 AND regexp_matches(t, '[A-Za-z]') AND NOT ends_with(t, '.')) AS usable FROM d GROUP BY lang""",
)
def caption_harvest(read):
    lines = read("documents").select("lang", F.explode(F.split("text", "\n")).alias("t"))
    c = lines.select("lang", forms.caption(_cat(_lit("SECTION 4 - "), "t", _lit(":"))).alias("c"))
    return c.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("n_chars"), F.count_if(forms.usable_caption(_col("c"))).alias("usable"))


@query(
    "word_spacing",
    r"""WITH w AS (SELECT lang, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT lang, unnest(list_zip(w[:-2], w[2:])) AS p FROM w)
SELECT lang, count(*) AS n, count(*) FILTER (NOT contains(',.;:!?)]}%', p[2][1]) AND NOT contains('([{$', p[1][-1])) AS blanks FROM p GROUP BY lang""",
)
def word_spacing(read):
    w = read("documents").select("lang", F.filter(F.split("text", text.SPACE), lambda x: x != "").alias("w"))
    p = w.select("lang", F.explode(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))).alias("p"))
    return p.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(forms.needs_space(_col("p.a"), _col("p.b"))).alias("blanks"))


@query(
    "node_kinds",
    r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), x AS (SELECT lang, n, CASE n % 7 WHEN 1 THEN '$' || t WHEN 2 THEN '![' || t WHEN 3 THEN 'a | --- | b' WHEN 4 THEN ' - ' ELSE t || ' more' END AS t FROM l)
SELECT lang, CASE WHEN n = 0 THEN 'heading' WHEN n % 7 = 1 THEN 'formula' WHEN n % 7 = 2 THEN 'image' WHEN n % 7 = 3 THEN 'table' WHEN n % 7 = 4 THEN 'marker' WHEN starts_with(ltrim(t), '$') THEN 'formula' WHEN starts_with(ltrim(t), '![') THEN 'image' WHEN starts_with(ltrim(t), '|') THEN 'table' ELSE 'prose' END AS kind, count(*) AS n FROM x GROUP BY ALL""",
)
def node_kinds(read):
    l = read("documents").select("lang", F.posexplode(F.split("text", "\n")).alias("n", "t"))
    k = _col("n") % 7
    t = F.when(k == 1, _cat(_lit("$"), "t")).when(k == 2, _cat(_lit("!["), "t")).when(k == 3, "a | --- | b").when(k == 4, " - ").otherwise(_cat("t", _lit(" more")))
    return l.select("lang", text.node_kind(t, _col("n") == 0).alias("kind")).groupBy("lang", "kind").agg(F.count("*").alias("n"))


@query(
    "document_names",
    """SELECT o_orderkey, 'order_line-' || lpad(CAST(o_custkey % 90 + 1 AS VARCHAR), 3, '0') AS record_id, 'doc-' || lpad(CAST(o_custkey % 90 + 1 AS VARCHAR), 3, '0') || '-n' || o_orderkey || '_root' || CASE WHEN o_orderkey % 3 > 0 THEN '-v' || (o_orderkey % 3 + 1) ELSE '' END AS stem,
  'Order.customer_' || lower(o_orderstatus) || ' -> Customer.id' AS fk, CASE WHEN o_orderkey % 3 > 0 THEN 'layout ' || least(o_orderkey % 5 + 1, o_orderkey % 3 + 1) || ' of ' || (o_orderkey % 3 + 1) ELSE '' END AS clause, o_orderkey AS page, o_custkey AS box FROM orders""",
)
def document_names(read):
    k, at = _col("o_orderkey"), _col("o_custkey") % 90
    key = forms.box_key(F.concat_ws(":", "o_orderkey", "o_custkey"))
    return read("orders").select(
        "o_orderkey",
        forms.record_id(_lit("Order Line"), at).alias("record_id"),
        forms.document_stem(at, _cat(k.cast("string"), _lit(" Root")), k % 3, k % 3 + 1).alias("stem"),
        forms.fk_notation(_lit("Order"), _cat(_lit("customer_"), F.lower("o_orderstatus")), _lit("Customer"), _lit("id")).alias("fk"),
        forms.variant_clause(k % 5, k % 3 + 1).alias("clause"),
        key["page"].alias("page"),
        key["box"].alias("box"),
    )


@query(
    "latex_sources",
    r"""WITH s AS (SELECT o_orderkey, o_orderpriority AS p, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 THEN NULL ELSE '\documentclass{a}' || chr(10) || '% layout: two  columns ' || p || chr(10) || '\begin{document}' || p || '~\textbf{b}\\c \%\end{document}' || chr(10) END AS source,
  CASE WHEN k <> 3 THEN 'two columns ' || p END AS layout, CASE WHEN k <> 3 THEN length('\documentclass{a}' || chr(10) || '% layout: two  columns ' || p || chr(10) || '\begin{document}' || p || '~\textbf{b}\\c \%\end{document}' || chr(10)) + 67 END AS hardened, CASE WHEN k <> 3 THEN trim(p || ' b c %') END AS shown,
  CASE k WHEN 0 THEN 'x^' || o_orderkey ELSE '$a$ + $' || o_orderkey || '$ b' END AS formula FROM s""",
)
def latex_sources(read):
    k, p = _col("o_orderkey") % 4, _col("o_orderpriority")
    body = _cat(_lit("\\documentclass{a}\n% layout: two  columns "), p, _lit("\n\\begin{document}"), p, _lit("~\\textbf{b}\\\\c \\%\\end{document}"))
    reply = F.when(k == 0, _cat(_lit("Here it is:\n```latex\n"), body, _lit("\n```\nDone."))).when(k == 1, _cat(_lit("Sure. "), body, _lit(" bye"))).when(k == 2, _cat(_lit("```\n"), body, _lit("\n```"))).otherwise("no source")
    formula = F.when(k == 0, _cat(_lit("```latex\n$$ \\[ x^"), "o_orderkey", _lit(" \\] $$\n```"))).otherwise(_cat(_lit("$ $a$ + $"), "o_orderkey", _lit("$ b $")))
    s = read("orders").select("o_orderkey", forms.latex_document(reply).alias("source"), forms.strip_math(formula).alias("formula"))
    inside = F.regexp_extract(forms.comparable_latex(F.regexp_extract("source", r"(?s)\\begin\{document\}(.*)\\end\{document\}", 1)), "(?s)(.*)", 1)
    return s.select("o_orderkey", "source", forms.layout_note(_col("source")).alias("layout"), F.length(forms.harden(_col("source"))).alias("hardened"), F.trim(inside).alias("shown"), "formula")


@query(
    "latex_log_errors",
    """SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderkey % 4 = 0) > 0 THEN array_to_string(list('! Bad ' || o_orderkey || ' l.' || o_orderkey || ' x' ORDER BY o_orderkey) FILTER (o_orderkey % 4 = 0)[1:3], '; ')
  || CASE WHEN count(*) FILTER (o_orderkey % 4 = 0) > 3 THEN ' (+' || (count(*) FILTER (o_orderkey % 4 = 0) - 3) || ' more)' ELSE '' END END AS errors FROM orders GROUP BY o_custkey""",
)
def latex_log_errors(read):
    k = _col("o_orderkey")
    part = F.when(k % 4 == 0, F.format_string("! Bad %d\nin text\n l.0\nl.%d x\n", k, k)).otherwise("(file read)\n")
    logs = read("orders").select("o_custkey", k, part.alias("p")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "p"))), lambda s: s["p"]), "").alias("log"))
    return logs.select("o_custkey", forms.log_errors(_col("log")).alias("errors"))


@query(
    "model_replies",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN '' ELSE o_orderstatus END AS said, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'see [n' || o_custkey || '] and [n2]' END AS answer, CASE WHEN o_orderkey % 2 = 0 THEN 'n7' ELSE 'n' || o_custkey || ',n2' END AS cited,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n_rows, o_orderpriority || ':' || CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS kept FROM orders""",
)
def model_replies(read):
    k, s, p = _col("o_orderkey"), _col("o_orderstatus"), _col("o_orderpriority")
    shapes = [F.format_string(x, s) for x in ('{"message": {"content": "%s"}}', '{"choices": [{"message": {"content": "%s"}}]}', '{"choices": [{"text": "%s"}]}', '{"response": "%s"}')]
    reply = F.when(k % 5 == 0, shapes[0]).when(k % 5 == 1, shapes[1]).when(k % 5 == 2, shapes[2]).when(k % 5 == 3, shapes[3]).otherwise("{}")
    qa = forms.reply_answer(F.when(k % 2 == 0, F.format_string('{"answer": " %s ", "citations": [{"id": "n7", "quote": "q"}]}', s)).otherwise(F.format_string("see [n%d] and [n2]", _col("o_custkey"))))
    rows = forms.reply_rows(F.when(k % 3 == 0, '{"note": 1, "data": [{"a": 1}, {"a": 2}, 3]}').when(k % 3 == 1, ' {"a": 1} ').otherwise("none"))
    records = forms.clean_records(_cat(_lit('{"records": [{"key": "k", "value": "'), p, _lit('", "confidence": "'), F.when(k % 2 == 0, " High").otherwise("sure"), _lit('"}, {"key": "no value"}]}')))
    return read("orders").select(
        "o_orderkey", forms.reply_text(reply).alias("said"), qa["answer"].alias("answer"), F.array_join(F.transform(qa["citations"], lambda c: c["id"]), ",").alias("cited"), F.size(rows).alias("n_rows"),
        F.array_join(F.transform(records, lambda r: F.concat_ws(":", r["value"], r["confidence"])), ",").alias("kept"),
    )


@query(
    "block_texts",
    """WITH b AS (SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag || l_linenumber END, chr(10) ORDER BY l_linenumber, l_returnflag) AS t FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(t, '') AS lines, '<!-- TABLE: pending ocr -->' || coalesce(chr(10) || t, '') AS stub, CASE WHEN l_orderkey % 2 = 0 THEN 'content' ELSE coalesce(t, '') END AS shown, ' id="' || l_orderkey || '"' || CASE WHEN l_orderkey % 2 = 0 THEN ' status="ok"' ELSE '' END || ' label="text"' AS provenance FROM b""",
)
def block_texts(read):
    one = F.struct("l_linenumber", F.when(_col("l_linenumber") % 3 != 0, _cat("l_returnflag", _col("l_linenumber").cast("string"))).otherwise("").alias("t"))
    b = read("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]).alias("l"))
    even = _col("l_orderkey") % 2 == 0
    return b.select(
        "l_orderkey",
        forms.lines_text(_col("l")).alias("lines"),
        forms.pending_stub(_lit("TABLE"), _lit("ocr"), _col("l")).alias("stub"),
        forms.block_text(F.when(even, " content ").otherwise(" "), forms.lines_text(_col("l"))).alias("shown"),
        forms.provenance(_col("l_orderkey"), _lit(None), F.when(even, "ok"), _lit("text")).alias("provenance"),
    )


@query(
    "reading_order_columns",
    """WITH b AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS box, l_linenumber % 2 AS c FROM lineitem), h AS (SELECT DISTINCT page FROM b),
o AS (SELECT page, box, c, box AS y FROM b UNION ALL SELECT page, 100, 0, 200 FROM h WHERE page % 2 = 0)
SELECT page, CAST(box AS BIGINT) AS box, row_number() OVER (PARTITION BY page ORDER BY box = 100, c, y) - 1 AS ord FROM o""",
    python=True,
)
def reading_order_columns(read):
    """Two columns of blocks and, on every second page, a page number below the last block."""
    c, y = (_col("l_linenumber") % 2) * 300.0, _col("l_linenumber") * 20.0
    once = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    b = once.select(_col("l_orderkey").alias("page"), _col("l_linenumber").cast("long").alias("box"), _lit("text").alias("label"), c.alias("x0"), y.alias("y0"), (c + 280).alias("x1"), (y + 15 + _col("l_quantity") / 20).alias("y1"))
    number = b.where("page % 2 = 0").groupBy("page").agg(F.max_by(F.struct("x0", "y1"), F.struct("x0", "y0")).alias("z"))
    number = number.select("page", _lit(100).cast("long").alias("box"), _lit("page_number").alias("label"), (_col("z.x0") + 130).alias("x0"), (_col("z.y1") + 1).alias("y0"), (_col("z.x0") + 150).alias("x1"), (_col("z.y1") + 4).alias("y1"))
    return reading.reading_order(b.union(number), ["page"])


@query(
    "line_rows",
    """WITH l AS (SELECT l_orderkey AS block, CAST(l_linenumber AS BIGINT) AS line, (l_linenumber - 1) // 3 AS r, (l_partkey % 50) * 10 + l_linenumber AS x FROM lineitem)
SELECT block, line, CAST(dense_rank() OVER (PARTITION BY block ORDER BY r) - 1 AS BIGINT) AS "row", row_number() OVER (PARTITION BY block ORDER BY r, x) - 1 AS ord FROM l""",
)
def line_rows(read):
    """Lines of a block in rows: three lines share a row, at slightly different heights."""
    x = ((_col("l_partkey") % 50) * 10 + _col("l_linenumber")).cast("double")
    y = F.floor((_col("l_linenumber") - 1) / 3) * 20.0 + _col("l_suppkey") % 4
    lines = read("lineitem").select(_col("l_orderkey").alias("block"), _col("l_linenumber").cast("long").alias("line"), x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 12).alias("y1"))
    return reading.sort_lines(lines, ["block"])


@query(
    "node_score_cards",
    """WITH n AS (SELECT l_returnflag AS kind, l_linestatus AS doc, l_linenumber % 4 AS gold, l_partkey % 3 AS pred, l_discount * 10 AS iou, l_suppkey % 5 = 0 AS exact FROM lineitem),
c AS (SELECT kind, count(*) AS n_nodes, count(*) FILTER (gold = 0) AS n_absent, count(*) FILTER (gold = 0 AND pred = 0) AS n_absent_correct, count(*) FILTER (gold > 0 AND pred = 0) AS n_missed, count(*) FILTER (gold > 0 AND pred > 0 AND (exact OR iou >= 0.5)) AS n_localized,
  count(*) FILTER (gold > 0 AND exact) AS n_exact, sum(CASE WHEN gold > 0 AND pred > 0 THEN iou ELSE 0 END) AS s FROM n GROUP BY kind)
SELECT kind, n_nodes, n_absent, n_absent_correct, n_missed, n_localized, n_exact, round(n_localized / (n_nodes - n_absent), 6) AS localization_accuracy, round(s / (n_nodes - n_absent), 4) AS mean_iou, round(n_absent_correct / n_absent, 6) AS absent_accuracy FROM c""",
)
def node_score_cards(read):
    """Cards of documents, pooled by kind."""
    n = read("lineitem").select(
        _col("l_returnflag").alias("kind"), _col("l_linestatus").alias("doc"), (_col("l_linenumber") % 4).alias("gold"), (_col("l_partkey") % 3).alias("pred"), (_col("l_discount") * 10).cast("double").alias("iou"), (_col("l_suppkey") % 5 == 0).alias("exact")
    )
    pooled = cards.card_rates(cards.merge_cards(cards.node_card(n, ["doc", "kind"]), ["kind"]))
    return pooled.withColumn("mean_iou", F.round("mean_iou", 4)).drop("iou_sum")


@query(
    "false_claims",
    """SELECT l_shipmode AS mode, count(*) AS n_furniture, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F') THEN 1 ELSE 0 END) AS BIGINT) AS n_false_claims FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) l WHERE l_returnflag = 'N' GROUP BY 1""",
)
def false_claims(read):
    furniture = read("lineitem").where("l_returnflag = 'N'").select(_col("l_orderkey").alias("box"), _col("l_linestatus").alias("mode"))
    return cards.claims(furniture, read("orders").where("o_orderstatus = 'F'").select(_col("o_orderkey").alias("box")), ["box"], ["mode"])


@query(
    "coverage_and_tiers",
    """WITH r AS (SELECT o_orderstatus AS s, o_orderkey % 3 AS k, o_custkey % 7 AS t FROM orders)
SELECT s, round(count(*) FILTER (k > 0) / count(*), 6) AS placement_rate, round(sum(CASE WHEN k > 0 THEN t ELSE 0 END) / sum(t), 6) AS token_coverage, count(*) AS n_gold_nodes, count(*) FILTER (k = 0) AS human, count(*) FILTER (k = 1) AS audited, count(*) FILTER (k = 2) AS oracle,
  round(count(*) FILTER (k = t) / count(*), 6) AS accuracy, round(count(*) FILTER (k = t OR k % 2 = t % 2) / count(*), 6) AS accuracy_up_to_ambiguity FROM r GROUP BY s""",
)
def coverage_and_tiers(read):
    k, t = _col("o_orderkey") % 3, _col("o_custkey") % 7
    r = read("orders").select(_col("o_orderstatus").alias("s"), k.alias("gold"), t.alias("pred"), F.when(k == 0, "human").when(k == 1, "audited").otherwise("oracle").alias("tier"), (k % 2).cast("string").alias("gold_text"), (t % 2).cast("string").alias("pred_text"))
    a = cards.coverage_rates(r, ["s"], _col("gold") > 0, F.when(_col("gold") > 0, _col("pred")).otherwise(0), _col("pred"))
    return a.join(cards.composition(r, ["s"]), "s").join(cards.ambiguity_accuracy(r, ["s"]), "s")


@query(
    "rendered_groups",
    "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) >= 3",
)
def rendered_groups(read):
    return cards.fully_rendered(read("orders").select("o_custkey", F.when(_col("o_orderstatus") != "P", "compiled").otherwise("failed").alias("status")), ["o_custkey"], 3)


def _schema(read):
    c = _col("c_custkey")
    entities = read("nation").select(_col("n_nationkey").alias("pos"), _cat(_lit("E"), _col("n_nationkey").cast("string")).alias("name"), _lit("id").alias("primary_key"))
    attributes = read("customer").select(
        _cat(_lit("E"), _col("c_nationkey").cast("string")).alias("entity"), c.alias("pos"), F.when(c % 11 == 0, "id").otherwise(_cat(_lit("a"), (c % 9).cast("string"))).alias("name"), F.when(c % 4 == 0, "id").otherwise("string").alias("type")
    )
    rels = read("nation").select(
        _col("n_nationkey").alias("pos"), _cat(_lit("E"), _col("n_nationkey").cast("string")).alias("child"), _lit("a3").alias("child_attribute"), _cat(_lit("E"), _col("n_regionkey").cast("string")).alias("parent"), F.when(_col("n_nationkey") % 2 == 0, "a5").otherwise("zz").alias("parent_attribute")
    )
    return entities, attributes, rels


_SCHEMA_SQL = """a AS (SELECT 'E' || c_nationkey AS entity, name, arg_min(type, c_custkey) AS type FROM (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 'id' ELSE 'a' || (c_custkey % 9) END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'id' ELSE 'string' END AS type FROM customer) GROUP BY ALL),
w AS (SELECT 'E' || n_nationkey AS entity, unnest(['id', 'a3']) AS name FROM nation)"""


@query(
    "schema_keys",
    f"""WITH {_SCHEMA_SQL}, e AS (SELECT entity, name, a.type, w.name IS NOT NULL AS wanted, a.name IS NULL AS added FROM a FULL JOIN w USING (entity, name))
SELECT entity, count(*) AS n, count(*) FILTER (added) AS added, count(*) FILTER (wanted OR type = 'id') AS ids FROM e GROUP BY entity""",
)
def schema_keys(read):
    """Every entity with its primary key and the columns of its relationships."""
    entities, attributes, rels = _schema(read)
    got, _ = schemas.enforce_keys(entities, schemas.dedupe_attributes(attributes), rels)
    return got.groupBy("entity").agg(F.count("*").alias("n"), F.count_if("added").alias("added"), F.count_if(_col("type") == "id").alias("ids"))


@query(
    "relationship_targets",
    f"""WITH {_SCHEMA_SQL} SELECT n_nationkey AS pos, 'E' || n_regionkey AS parent, CASE WHEN n_nationkey % 2 = 0 AND EXISTS (SELECT 1 FROM a WHERE a.entity = 'E' || n_regionkey AND a.name = 'a5') THEN 'a5' ELSE 'id' END AS parent_attribute FROM nation""",
)
def relationship_targets(read):
    entities, attributes, rels = _schema(read)
    return schemas.enforce_keys(entities, attributes, rels)[1].select("pos", "parent", "parent_attribute")


@query(
    "attribute_roles",
    f"""WITH {_SCHEMA_SQL} SELECT entity, count(*) FILTER (type <> 'id') AS n_values, count(*) FILTER (type = 'id') AS n_stranded FROM a WHERE name NOT IN ('id', 'a3') GROUP BY entity""",
)
def attribute_roles(read):
    """Facts, and id columns with no relationship behind them."""
    entities, attributes, rels = _schema(read)
    a = schemas.dedupe_attributes(attributes)
    v = schemas.value_attributes(a, entities, rels).withColumn("v", _lit(1))
    s = schemas.stranded_keys(a, entities, rels).withColumn("v", _lit(0))
    return v.union(s).groupBy("entity").agg(F.sum("v").alias("n_values"), F.sum(1 - _col("v")).alias("n_stranded"))


@query(
    "relatives",
    "SELECT 'child' AS role, 'E' || n_nationkey AS name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'parent', 'E' || n_regionkey FROM nation WHERE n_nationkey = 7",
)
def relatives(read):
    rels = _schema(read)[2]
    return schemas.children_of(rels, "e2").select(_lit("child").alias("role"), _col("child").alias("name")).union(schemas.parents_of(rels, "E7").select(_lit("parent"), "parent"))


def _records(read):
    status = F.when(_col("o_orderstatus") != "P", _col("o_orderstatus"))
    attributes = F.create_map(_lit("status"), status, _lit("cust"), _col("o_orderpriority"))
    keys = F.create_map(_lit("cust"), ((_col("o_orderkey") + _col("o_custkey") * 7) % 4000).cast("string"))
    return read("orders").select(_col("o_orderkey").alias("pos"), _col("o_orderkey").cast("string").alias("id"), F.concat(_lit("E"), _col("o_custkey") % 5).alias("entity"), attributes.alias("attributes"), keys.alias("foreign_keys"))


@query(
    "instance_summary",
    """SELECT 'E' || (o_custkey % 5) AS entity, count(*) AS n, count(*) AS declared, count(*) FILTER ((o_orderkey + o_custkey * 7) % 4000 IN (SELECT o_orderkey FROM orders)) AS resolved, count(*) FILTER (o_orderstatus = 'P') AS nulls FROM orders GROUP BY 1""",
)
def instance_summary(read):
    return schemas.instance_summary(_records(read))


@query(
    "record_fields",
    """WITH f AS (SELECT 'E' || (o_custkey % 5) AS entity, o_orderkey, o_orderstatus AS s, (o_orderkey + o_custkey * 7) % 4000 AS ref FROM orders), g AS (SELECT *, row_number() OVER (ORDER BY m) AS place FROM (SELECT entity, min(o_orderkey) AS m FROM f GROUP BY entity))
SELECT entity, place, count(*) AS n, CAST(sum(ref) AS BIGINT) AS refs, CAST(sum(CASE WHEN s = 'P' THEN 2 ELSE 3 END) AS BIGINT) AS shown FROM f JOIN g USING (entity) GROUP BY ALL""",
)
def record_fields(read):
    """Fields with keys over attributes, values that a document has to show, entities in order."""
    r = _records(read)
    fields = r.select("entity", schemas.fields_of(_col("attributes"), _col("foreign_keys")).alias("f")).groupBy("entity").agg(F.sum(_col("f")["cust"].cast("long")).alias("refs"))
    shown = schemas.recorded_values(r).join(r.select("id", "entity"), "id").groupBy("entity").agg(F.count("*").alias("shown"))
    groups = schemas.groups_of(r.select(_lit(1).alias("scope"), "pos", "entity"), ["scope"]).select("entity", "place", "n")
    return groups.join(fields, "entity").join(shown, "entity")


@query(
    "grounded_boxes",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus || ',' || o_orderstatus WHEN 1 THEN 'title,block' END AS labels,
  CASE o_orderkey % 3 WHEN 0 THEN 'before  after' WHEN 1 THEN 'first' || chr(10) || chr(10) || o_orderpriority ELSE 'plain' END AS said, CASE WHEN o_orderkey % 3 < 2 THEN round(o_custkey % 900 / 999.0::DOUBLE * 1000, 1) END AS x0 FROM orders""",
)
def grounded_boxes(read):
    k, x = _col("o_orderkey") % 3, (_col("o_custkey") % 900).cast("int")
    ref = F.format_string("before <|ref|> %s <|/ref|><|det|>[[%d, 10, 950, 20], [1, 2, 3, 4], [5]]<|/det|> after", _col("o_orderstatus"), x)
    mark = F.format_string("<|det|>title [%d, 10, 950, 20]<|/det|>first\n<|det|>[1,2,3,4]<|/det|> %s <|end|>", x, _col("o_orderpriority"))
    g = read("orders").select("o_orderkey", pages.grounded_boxes(F.when(k == 0, ref).when(k == 1, mark).otherwise("plain <|end|>"), _lit(1000), _lit(500)).alias("g"))
    labels = F.array_join(F.transform("g.boxes", lambda b: b["label"]), ",")
    return g.select("o_orderkey", F.size("g.boxes").alias("n"), F.when(labels != "", labels).alias("labels"), _col("g.text").alias("said"), F.get(F.get("g.boxes", _lit(0))["box"], _lit(0)).alias("x0"))


@query(
    "detector_regions",
    """SELECT o_orderkey, CAST(2 AS INTEGER) AS n, o_custkey + 0.13 AS x0, 0.1235 AS score FROM orders""",
)
def detector_regions(read):
    json = _cat(_lit('{"boxes": [{"label": "a", "score": 0.123456, "coordinate": ['), _col("o_custkey").cast("string"), _lit('.126, 1, 2, 3]}, {"label": "none"}, {"bbox": [1, 2, 3, 4]}]}'))
    r = read("orders").select("o_orderkey", pages.regions(json).alias("r"))
    return r.select("o_orderkey", F.size("r").alias("n"), _col("r")[0]["bbox"][0].alias("x0"), _col("r")[0]["score"].alias("score"))


@query(
    "word_errors",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST((len(w) + 9) // 10 AS BIGINT) AS word_edits, round(((len(w) + 9) // 10) / greatest(len(w), 1), 4) AS wer FROM w""",
    python=True,
)
def word_errors(read):
    """Every tenth word left out, over whole texts."""
    w = read("documents").select("doc_id", F.filter(F.split("text", text.SPACE), lambda x: x != "").alias("w"))
    both = w.select("doc_id", F.array_join("w", " ").alias("ref"), F.array_join(F.filter("w", lambda x, i: i % 10 != 0), "\n").alias("hyp"))
    return cards.with_wer(both, "doc_id", "ref", "hyp")


@query(
    "joint_vector_norms",
    """WITH v AS (SELECT vec_id % 50 AS k, embedding AS e, vec_id FROM embeddings), n AS (SELECT k, arg_min(e, vec_id) AS e FROM v GROUP BY k), f AS (SELECT k, unnest(e)::DOUBLE AS x FROM n)
SELECT k, round(sqrt(sum(x * x) / (sum(x * x) + 1)), 6) AS share FROM f GROUP BY k""",
)
def joint_vector_norms(read):
    """Share of the name's half in the joint vector of name and values."""
    v = read("embeddings").select((_col("vec_id") % 50).alias("k"), "vec_id", _col("embedding").alias("vec"))
    j = schemas.joint_vectors(v.groupBy("k").agg(F.min_by("vec", "vec_id").alias("vec")), v.select("k", "vec"), "k")
    half = F.slice("vec", 1, F.size("vec") / 2)
    return j.select("k", F.round(F.sqrt(F.aggregate(half, _lit(0.0), lambda a, x: a + x * x)), 6).alias("share"))
