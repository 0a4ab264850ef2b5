"""Queries on records, tables in text, engines and rules."""

from pyspark.sql import functions as F

from folioquery.functions.text import norm_alnum
from folioquery.operators import metrics, records
from folioquery.plans.registry import query
from folioquery.sources import sinks
from folioquery.streaming import verdicts


@query(
    "pipe_table_records",
    r"""WITH p AS (SELECT doc_id, trim(replace(unnest(string_split(text, chr(10))), '|', '/'), ' ') AS part, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
k AS (SELECT doc_id, part, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) + 1 AS line FROM p WHERE part NOT IN ('', '-'))
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(c AS BIGINT) AS col, CASE c WHEN 0 THEN 'name' ELSE 'part' END AS header, CASE WHEN c = 0 OR part = CAST(n AS VARCHAR) THEN '' ELSE part END AS entity, CASE c WHEN 0 THEN part ELSE CAST(n AS VARCHAR) END AS value FROM k, range(0, 2) r(c)""",
)
def pipe_table_records(read):
    """Cells of the tables that list each document's lines and their numbers."""
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "part"))
    parts = lines.select("doc_id", (F.col("n") + 1).alias("n"), F.trim(F.replace("part", F.lit("|"), F.lit("/"))).alias("part")).where("part not in ('', '-')")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda s: F.concat_ws(" | ", s["part"], s["n"].cast("string"))), "\n")
    tables = parts.groupBy("doc_id").agg(F.concat(F.lit("name | part \n---|---\n"), body).alias("text"))
    return records.pipe_tables(tables, "doc_id", "text").select("doc_id", F.col("line").cast("long").alias("line"), "col", "header", "entity", "value")


#: The view of functions.views without escapes, and the places in the text of what it keeps.
VIEW_SQL = r"""lower(regexp_replace({0}, '[ \t\r\n\-*_`"''“”‘’{{}}()\[\]|~^$\\]', '', 'g'))"""
KEPT_SQL = r"""list_filter(range(1, len({0}) + 1), lambda i: NOT regexp_matches({0}[i], '[ \t\r\n\-*_`"''“”‘’{{}}()\[\]|~^$\\]'))"""
GROUND_SQL = f"""
v AS (SELECT *, {VIEW_SQL.format("document")} AS dv, {VIEW_SQL.format("evidence")} AS ev, {VIEW_SQL.format("value")} AS vv, string_split(document, '') AS chars FROM r),
f AS (SELECT *, CASE WHEN ev <> '' AND contains(dv, ev) THEN instr(dv, ev) END AS ea FROM v),
g AS (SELECT *, CASE WHEN vv <> '' AND ea IS NOT NULL AND contains(ev, vv) THEN 'in_evidence' WHEN vv <> '' AND contains(dv, vv) THEN 'in_document' WHEN ea IS NOT NULL THEN 'evidence_only' ELSE 'none' END AS grounded_by FROM f),
p AS (SELECT *, CASE grounded_by WHEN 'in_evidence' THEN ea + instr(ev, vv) - 1 WHEN 'in_document' THEN instr(dv, vv) WHEN 'evidence_only' THEN ea END AS j, length(CASE WHEN grounded_by = 'evidence_only' THEN ev ELSE vv END) AS n FROM g),
k AS (SELECT *, {KEPT_SQL.format("chars")} AS kept FROM p),
s AS (SELECT *, CAST(kept[j] - 1 AS BIGINT) AS start, CAST(kept[j + n - 1] AS BIGINT) AS stop FROM k)"""


@query(
    "grounding_precedence",
    f"""WITH r AS (SELECT o_orderkey AS id, 'the order of ' || o_orderpriority || ' is ' || o_orderstatus AS document, CASE WHEN o_orderkey % 3 = 0 THEN 'order of **' || o_orderpriority || '**' ELSE 'a note on ' || o_orderstatus END AS evidence,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN 'note' ELSE o_orderstatus || '?' END AS value FROM orders),{GROUND_SQL}
SELECT grounded_by, count(*) AS n, CAST(sum(start) AS BIGINT) AS start_sum, CAST(sum(stop) AS BIGINT) AS stop_sum FROM s GROUP BY grounded_by""",
)
def grounding_precedence(read):
    """Values grounded in made documents with marks, by the strength of the claim, and their spans."""
    k = F.col("o_orderkey")
    rows = read("orders").select(
        F.concat(F.lit("the order of "), "o_orderpriority", F.lit(" is "), "o_orderstatus").alias("document"),
        F.when(k % 3 == 0, F.concat(F.lit("order of **"), "o_orderpriority", F.lit("**"))).otherwise(F.concat(F.lit("a note on "), "o_orderstatus")).alias("evidence"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).when(k % 5 == 0, "note").otherwise(F.concat("o_orderstatus", F.lit("?"))).alias("value"),
    )
    got = records.ground(rows, "value", "evidence", "document").groupBy("grounded_by")
    return got.agg(F.count("*").alias("n"), F.sum("start").alias("start_sum"), F.sum("stop").alias("stop_sum"))


@query(
    "grounded_spans",
    f"""WITH t AS (SELECT doc_id, text AS document, split_part(text, chr(10), 2) AS line FROM documents),
r AS (SELECT doc_id, document, '**' || replace(line, ' ', ' - ') || '**' AS evidence, CASE WHEN doc_id % 7 = 0 THEN 'no such value' WHEN doc_id % 3 = 0 THEN '(' || left(document, 9) || ')' ELSE '`' || right(line, 9) || '`' END AS value FROM t),{GROUND_SQL}
SELECT doc_id, grounded_by, start, stop, CASE WHEN start IS NOT NULL THEN substr(document, start + 1, stop - start) END AS said FROM s""",
)
def grounded_spans(read):
    """Quotes of each document's second line, written with other marks, and their spans in the document."""
    d = read("documents").select("doc_id", "text").repartition("doc_id")  # dealt anew, as one file can be one task
    d = d.select("doc_id", F.col("text").alias("document"), F.split_part("text", F.lit("\n"), F.lit(2)).alias("line"))
    quoted = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    value = F.when(F.col("doc_id") % 7 == 0, "no such value").when(F.col("doc_id") % 3 == 0, quoted("(", F.left("document", F.lit(9)), ")")).otherwise(quoted("`", F.right("line", F.lit(9)), "`"))
    rows = d.select("doc_id", "document", quoted("**", F.replace("line", F.lit(" "), F.lit(" - ")), "**").alias("evidence"), value.alias("value"))
    return records.ground(rows, "value", "evidence", "document").select("doc_id", "grounded_by", "start", "stop", "said")


@query(
    "record_collapse",
    """WITH r AS (SELECT l_suppkey AS entity, l_shipdate, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'The ' ELSE '' END || l_returnflag || '-' || l_linestatus AS value, l_linenumber % 3 AS confidence, l_partkey % 4 AS grounding, l_orderkey AS place FROM lineitem),
c AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(lower(value), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '^(a|an|the) ', '') AS canon FROM r)
SELECT entity, canon, arg_min(value, (-confidence) * 1000000000000 + seq) AS value, CAST(max(confidence) AS BIGINT) AS confidence, CAST(max(grounding) AS BIGINT) AS grounding, count(DISTINCT place) AS mentions FROM c GROUP BY entity, canon""",
)
def record_collapse(read):
    n = F.col("l_linenumber")
    rows = read("lineitem").select(
        F.col("l_suppkey").alias("entity"),
        (F.col("l_orderkey") * 10 + n).alias("seq"),
        F.concat(F.when(n % 2 == 0, "The ").otherwise(""), "l_returnflag", F.lit("-"), "l_linestatus").alias("value"),
        (n % 3).cast("long").alias("confidence"),
        (F.col("l_partkey") % 4).alias("grounding"),
        F.col("l_orderkey").alias("at"),
    )
    return records.collapse(rows, ["entity"], "value", "seq")


@query(
    "record_scorer_levels",
    """WITH g AS (SELECT o_orderkey AS id, o_custkey % 40 AS k, o_orderpriority AS v, o_orderstatus AS e FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_orderkey AS id, o_custkey % 40 AS k, o_orderpriority AS v, o_orderstatus AS e FROM orders WHERE o_orderkey % 2 = 1),
a AS (SELECT x.id, y.id AS pid FROM (SELECT *, row_number() OVER (PARTITION BY k, v, e ORDER BY id) r FROM g) x JOIN (SELECT *, row_number() OVER (PARTITION BY k, v, e ORDER BY id) r FROM p) y USING (k, v, e, r)),
g2 AS (SELECT * FROM g WHERE id NOT IN (SELECT id FROM a)), p2 AS (SELECT * FROM p WHERE id NOT IN (SELECT pid FROM a)),
b AS (SELECT x.id, y.id AS pid FROM (SELECT *, row_number() OVER (PARTITION BY k, v ORDER BY id) r FROM g2) x JOIN (SELECT *, row_number() OVER (PARTITION BY k, v ORDER BY id) r FROM p2) y USING (k, v, r)),
g3 AS (SELECT * FROM g2 WHERE id NOT IN (SELECT id FROM b)), p3 AS (SELECT * FROM p2 WHERE id NOT IN (SELECT pid FROM b)),
c AS (SELECT x.id, y.id AS pid FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY id) r FROM g3) x JOIN (SELECT *, row_number() OVER (PARTITION BY v ORDER BY id) r FROM p3) y USING (v, r)),
u AS (SELECT 1 AS level, id, pid FROM a UNION ALL SELECT 2, id, pid FROM b UNION ALL SELECT 3, id, pid FROM c) SELECT CAST(level AS BIGINT) AS level, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM u GROUP BY level""",
)
def record_scorer_levels(read):
    """Records matched on key, value and entity, then on key and value, then on the value."""
    rows = read("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderstatus").alias("e"))
    got = records.match_levels(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), [["k", "v", "e"], ["k", "v"], ["v"]])
    return got.groupBy("level").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query(
    "key_vocab_assign",
    """WITH c AS (SELECT label, embedding AS centroid FROM embeddings WHERE vec_id < 8), m AS (SELECT e.vec_id, c.label, round(list_sum(list_transform(list_zip(e.embedding, c.centroid), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 4) AS score FROM embeddings e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM m)
SELECT vec_id, CASE WHEN score >= 0.25 THEN CAST(label AS VARCHAR) ELSE 'self:' || vec_id END AS label, score FROM r WHERE k = 1""",
)
def key_vocab_assign(read):
    e = read("embeddings")
    centroids = e.where("vec_id < 8").select("label", F.col("embedding").alias("centroid"))
    return records.assign_vocabulary(e.select("vec_id", F.col("embedding").alias("vec")), centroids, "vec_id", 0.25)


@query("key_vocab_induce", python=True)
def key_vocab_induce(read):
    e = read("embeddings").select("label", "vec_id", F.col("embedding").alias("vec"))
    got = records.induce_vocabulary(e, "label", "vec_id", 0.8)
    return got.groupBy("label", "cluster").agg(F.count("*").alias("n"))


@query(
    "engine_summary_upper_median",
    """WITH r AS (SELECT event_type AS engine, user_id % 3 AS mode, value, value < 5 AS failed FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY engine, mode ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY engine, mode) AS c FROM r WHERE NOT failed)
SELECT engine, mode, (SELECT count(*) FROM r WHERE r.engine = o.engine AND r.mode = o.mode) AS n, count(*) AS n_ok, round(avg(value), 4) AS mean_value, max(value) AS top, round(max(CASE WHEN i = floor(c / 2) THEN value END), 4) AS upper_median FROM o GROUP BY engine, mode""",
)
def engine_summary_upper_median(read):
    """Means over runs that didn't fail, all runs in n, and the upper median."""
    ok = F.when(F.col("value") >= 5, F.col("value"))
    rows = read("events").select(F.col("event_type").alias("engine"), (F.col("user_id") % 3).alias("mode"), "value")
    out = rows.withColumn("ok", ok).groupBy("engine", "mode").agg(F.count("*").alias("n"), F.count(ok).alias("n_ok"), F.round(F.avg(ok), 4).alias("mean_value"), F.max(ok).alias("top"), F.round(metrics.upper_median("ok"), 4).alias("upper_median"))
    return out.where("n_ok > 0")


@query("label_harvest", "SELECT lower(trim(p_type)) AS label, count(DISTINCT p_brand) AS n_docs FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def label_harvest(read):
    return records.harvest_labels(read("part"), "p_brand", "p_type")


@query(
    "rule_scoring",
    """WITH l AS (SELECT DISTINCT user_id, CASE event_id % 7 WHEN 0 THEN 'car' WHEN 1 THEN 'person' WHEN 2 THEN 'smoke' WHEN 3 THEN 'ladder' WHEN 4 THEN 'debris' WHEN 5 THEN 'pallet' ELSE 'tree' END AS o FROM events),
d(pos, verdict, o, w, g) AS (VALUES (0, 'Vehicle collision / traffic accident', 'car', 1.0, true), (0, 'Vehicle collision / traffic accident', 'person', 0.6, false), (0, 'Vehicle collision / traffic accident', 'debris', 0.8, false),
 (1, 'Fire / smoke incident', 'smoke', 1.2, true), (1, 'Fire / smoke incident', 'person', 0.3, false), (2, 'Fall from height', 'ladder', 1.2, true), (2, 'Fall from height', 'person', 0.8, false), (3, 'Slip / trip hazard', 'person', 0.5, false),
 (4, 'Industrial / material handling incident', 'pallet', 0.8, true), (4, 'Industrial / material handling incident', 'debris', 0.6, false), (4, 'Industrial / material handling incident', 'person', 0.6, false)),
t AS (SELECT user_id, pos, verdict, sum(w)::DOUBLE AS s, bool_or(g) AS open FROM l JOIN d USING (o) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 6) DESC, pos) AS r, sum(s) OVER (PARTITION BY user_id) AS total FROM t WHERE open)
SELECT u.user_id, coalesce(verdict, 'Undetermined incident') AS verdict, coalesce(round(s / total, 3), 0) AS confidence FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM k WHERE r = 1) b USING (user_id)""",
)
def rule_scoring(read):
    k = F.col("event_id") % 7
    name = F.when(k == 0, "car").when(k == 1, "Person").when(k == 2, "smoke").when(k == 3, "ladder").when(k == 4, "debris").when(k == 5, "pallet").otherwise("tree")
    return records.rule_scores(read("events").select("user_id", name.alias("o")), "user_id", "o")


@query(
    "annotation_latest",
    """WITH v AS (SELECT user_id AS doc, event_type AS item, value, event_id, CASE WHEN event_id % 9 = 0 THEN 'clear' WHEN value > 50 THEN 'accept' ELSE 'reject' END AS verdict, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT doc, item, verdict, event_id FROM v WHERE r = 1 AND verdict <> 'clear'""",
)
def annotation_latest(read):
    """The last verdict on each item; a clear takes it back."""
    verdict = F.when(F.col("event_id") % 9 == 0, "clear").when(F.col("value") > 50, "accept").otherwise("reject")
    log = read("events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("item"), verdict.alias("verdict"), "ts", "event_id")
    return sinks.upsert_latest(log, ["doc", "item"], ["ts", "event_id"]).select("doc", "item", "verdict", "event_id")


VERDICT_SQL = """log AS (SELECT 'd' || user_id % 40 AS doc, CASE event_type WHEN 'click' THEN 'excluded:' WHEN 'view' THEN 'null:' WHEN 'error' THEN 'other:' ELSE 'audit:' END || user_id % 7 AS id,
  CASE WHEN event_id % 9 = 0 THEN 'clear' WHEN event_type = 'click' THEN CASE WHEN value < 50 THEN 'boxes' ELSE 'absent' END WHEN event_type = 'view' THEN CASE WHEN value < 90 THEN 'node' ELSE 'accept' END WHEN value > 50 THEN 'accept' ELSE 'skip' END AS verdict,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_boxes, CASE WHEN event_id % 5 > 0 THEN 'n' || user_id END AS node_id, ts, event_id AS seq FROM events),
judged AS (SELECT *, CASE WHEN id LIKE 'other:%' THEN 'bad_item' WHEN verdict <> 'clear' AND NOT ((id LIKE 'excluded:%' AND verdict IN ('boxes', 'absent', 'skip')) OR (id LIKE 'null:%' AND verdict IN ('furniture', 'node', 'skip')) OR (id LIKE 'audit:%' AND verdict IN ('accept', 'reject', 'skip'))) THEN 'bad_verdict'
  WHEN verdict = 'boxes' AND n_boxes = 0 THEN 'needs_boxes' WHEN verdict = 'node' AND node_id IS NULL THEN 'needs_node' END AS fault FROM log),
held AS (SELECT doc, id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY ts DESC, seq DESC) AS r FROM judged WHERE fault IS NULL) WHERE r = 1 AND verdict <> 'clear')"""


def _verdict_log(read):
    e, kind, v = read("events"), F.col("event_type"), F.col("value")
    queue = F.when(kind == "click", "excluded:").when(kind == "view", "null:").when(kind == "error", "other:").otherwise("audit:")
    verdict = F.when(F.col("event_id") % 9 == 0, "clear").when(kind == "click", F.when(v < 50, "boxes").otherwise("absent"))
    verdict = verdict.when(kind == "view", F.when(v < 90, "node").otherwise("accept")).otherwise(F.when(v > 50, "accept").otherwise("skip"))
    user = F.col("user_id")
    return e.select(
        F.concat(F.lit("d"), user % 40).alias("doc"), F.concat(queue, user % 7).alias("id"), verdict.alias("verdict"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("1:0"))).alias("boxes"), F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("n"), user)).alias("node_id"),
        F.lit(None).cast("string").alias("note"), "ts", F.col("event_id").alias("seq"),
    )


@query("verdict_faults", f"WITH {VERDICT_SQL} SELECT coalesce(fault, 'none') AS fault, verdict, count(*) AS n FROM judged GROUP BY ALL")
def verdict_faults(read):
    """Verdicts of the log by what is wrong with them."""
    return verdicts.checked(_verdict_log(read)).groupBy(F.coalesce("fault", F.lit("none")).alias("fault"), "verdict").agg(F.count("*").alias("n"))


@query(
    "verdict_progress",
    f"""WITH {VERDICT_SQL}, items AS (SELECT DISTINCT doc, id FROM log WHERE seq % 3 > 0)
SELECT coalesce(items.doc, held.doc) AS doc, count(items.id) AS n_items, count(held.id) AS n_annotated, CAST(sum(CASE WHEN held.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_open
FROM items FULL JOIN held ON items.doc = held.doc AND items.id = held.id GROUP BY 1""",
)
def verdict_progress(read):
    """Items, those with a verdict that holds, and open ones, by document."""
    log = _verdict_log(read)
    held = verdicts.last_verdicts(verdicts.checked(log).where("fault is null"))
    return verdicts.progress(log.where("seq % 3 > 0").select("doc", "id"), held)


@query("json_props_to_attrs", "SELECT event_id, 'k' AS attr, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props_to_attrs(read):
    """Scalar members of a JSON object as attributes; nulls are dropped."""
    m = F.from_json("props", "map<string,string>")
    return read("events").select("event_id", F.explode(m).alias("attr", "value")).where("value is not null and value <> ''")


@query(
    "missing_values",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t, lang, source, n_chars FROM documents),
f AS (SELECT doc_id, t, unnest(['lang', 'source', 'n_chars']) AS field, unnest([lang, source, CAST(n_chars AS VARCHAR)]) AS value FROM d)
SELECT field, count(*) AS n, CAST(sum(CASE WHEN contains(t, lower(value)) THEN 0 ELSE 1 END) AS BIGINT) AS missing FROM f GROUP BY field""",
)
def missing_values(read):
    """Recorded values that the document's text doesn't hold."""
    d = read("documents").withColumn("t", norm_alnum(F.col("text")))
    f = d.select("t", F.explode(F.create_map(*[x for c in ("lang", "source", "n_chars") for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))
    return f.groupBy("field").agg(F.count("*").alias("n"), F.count_if(~F.col("t").contains(F.lower("value"))).alias("missing"))


@query(
    "leaked_examples",
    """WITH l(phrase) AS (VALUES ('All rights reserved'), ('Licensed under'), ('example.com'), ('the')), h AS (SELECT phrase, doc_id FROM documents, l WHERE contains(text, phrase))
SELECT phrase, count(*) AS n_docs FROM h WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.phrase = h.phrase AND b.phrase = 'the') GROUP BY phrase""",
)
def leaked_examples(read):
    """Documents with prompt examples that no record backs."""
    phrases = ["All rights reserved", "Licensed under", "example.com", "the"]
    backed = ["the"]
    hits = F.filter(F.array(*[F.when(F.col("text").contains(p), F.lit(p)) for p in phrases]), lambda x: x.isNotNull() & ~x.isin(backed))
    return read("documents").select(F.explode(hits).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n_docs"))
