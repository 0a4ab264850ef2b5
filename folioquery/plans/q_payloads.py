"""Queries on payloads of schemas and records, cells of LaTeX tables, found fields, titles."""

from pyspark.sql import functions as F

from folioquery.functions import forms
from folioquery.operators import metrics, records
from folioquery.plans.registry import query
from folioquery.sources import pages, payloads, sinks

_col, _lit, _cat = F.col, F.lit, F.concat


def _payloads(read):
    k, n = _col("n_nationkey") % 4, _col("n_nationkey")
    wrapped = '{"schema": {"entities": [{"name": "Order Line", "fields": ["Total %d", {"amount": "money"}], "pk": "line no"}], "links": ["OrderLine.cust_id -> Customer.id", "bad"]}}'
    mapped = '{"tables": {"customer": {"columns": {"full name": "varchar", "Age%d": "int"}}}, "relations": [{"child": "A.b_id", "to": "B", "pk_column": "key"}]}'
    loose = '{"entities": ["Alone%d", {"note": 1}, {"name": "Bad", "attributes": [{"a": 1, "b": 2}]}], "relationships": [{"fk": "Alone.x -> Base.y"}, {"one": "Base", "many": "Alone"}]}'
    text = F.when(k == 0, F.format_string(wrapped, n)).when(k == 1, F.format_string(mapped, n)).when(k == 2, F.format_string(loose, n)).otherwise("[]")
    return read("nation").select("n_nationkey", text.alias("payload"))


def _joined(c):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("s")))), lambda x: x["s"]), ",")


@query(
    "schema_payloads",
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'OrderLine:line_no' WHEN 1 THEN 'Customer:id' ELSE 'Alone' || n_nationkey || ':id' END AS entities,
  CASE n_nationkey % 4 WHEN 0 THEN 'total_' || n_nationkey || ':string,amount:currency' WHEN 1 THEN 'full_name:string,age' || n_nationkey || ':integer' END AS attributes FROM nation WHERE n_nationkey % 4 < 3""",
)
def schema_payloads(read):
    """Entities and their attributes in three shapes of payload; unreadable ones left out."""
    e = payloads.read_entities(_payloads(read), "n_nationkey", "payload")
    names = e.where("name is not null").groupBy("n_nationkey").agg(_joined(F.concat_ws(":", "name", "primary_key")).alias("entities"))
    of = payloads.read_attributes(e, "n_nationkey").groupBy("n_nationkey").agg(_joined(F.concat_ws(":", "name", "type")).alias("attributes"))
    return names.join(of, "n_nationkey", "left")


@query(
    "relationship_payloads",
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'OrderLine.cust_id>Customer.id' WHEN 1 THEN 'A.b_id>B.key' ELSE 'Alone.x>Base.y,Alone.base_id>Base.id' END AS links, CAST(CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS BIGINT) AS dropped FROM nation WHERE n_nationkey % 4 < 3""",
)
def relationship_payloads(read):
    """Relationships in four shapes, and how many entries of a payload can't be read."""
    p = _payloads(read)
    rels = payloads.read_relationships(p, "n_nationkey", "payload")
    lost = payloads.dropped_entries(payloads.read_entities(p, "n_nationkey", "payload"), rels, "n_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("dropped"))
    link = _cat("child", _lit("."), "child_attribute", _lit(">"), "parent", _lit("."), "parent_attribute")
    links = rels.where("child is not null").groupBy("n_nationkey").agg(_joined(link).alias("links"))
    return links.join(lost, "n_nationkey", "left").select("n_nationkey", "links", F.coalesce("dropped", _lit(0)).alias("dropped"))


@query(
    "instance_payloads",
    """SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS with_key, min(o_orderstatus) AS least FROM orders GROUP BY o_custkey""",
)
def instance_payloads(read):
    """Records of instance payloads, one payload a customer."""
    attributes = F.create_map(_lit("status"), _col("o_orderstatus"))
    r = F.struct(_col("o_orderkey").cast("string").alias("id"), _lit("Order").alias("entity_name"), attributes.alias("attributes"), F.when(_col("o_orderkey") % 2 == 0, F.create_map(_lit("cust"), _col("o_custkey").cast("string"))).alias("foreign_keys"))
    whole = read("orders").groupBy("o_custkey").agg(F.to_json(F.struct(_lit("shop").alias("schema_domain"), F.collect_list(r).alias("records"))).alias("payload"))
    got = payloads.read_instances(whole, "o_custkey", "payload")
    return got.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.size("foreign_keys") > 0).alias("with_key"), F.min(_col("attributes")["status"]).alias("least"))


@query(
    "record_files",
    """SELECT p_partkey, 'k' || p_size AS key, CASE WHEN p_partkey % 2 = 0 THEN 'k' || p_size ELSE p_brand END AS raw_key, p_type AS value, '' AS src FROM part""",
)
def record_files(read):
    """Records of a list or of an object with one; a missing raw key is the key."""
    raw = F.when(_col("p_partkey") % 2 == 1, _col("p_brand"))
    r = F.array(F.struct(_cat(_lit("k"), _col("p_size").cast("string")).alias("key"), raw.alias("raw_key"), _col("p_type").alias("value")))
    text = F.when(_col("p_partkey") % 3 == 0, F.to_json(r)).otherwise(F.to_json(F.struct(r.alias("records"))))
    got = read("part").select("p_partkey", F.explode(payloads.records_of(text)).alias("r"))
    return got.select("p_partkey", "r.key", "r.raw_key", "r.value", "r.src")


@query(
    "latex_cells",
    r"""SELECT p_partkey, p_brand || ' ' || p_size || '×' || p_size || ' é {' || p_size || '% a—b ^2_i}' AS cell FROM part""",
)
def latex_cells(read):
    size = _col("p_size").cast("string")
    cell = _cat(_lit(r"\textbf{"), "p_brand", _lit("}~$"), size, _lit(r"\times "), size, _lit(r"$  \'{e} \{"), size, _lit(r"\% {a}---b $^{2}_{i}$\}"))
    return read("part").select("p_partkey", forms.plain_cell(cell).alias("cell"))


@query(
    "field_states",
    """WITH w AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS v FROM lineitem), f AS (SELECT o_orderkey, unnest(['no ' || o_custkey || ' x', CAST(o_custkey % 100 AS VARCHAR)]) AS t FROM orders)
SELECT l_orderkey, l_linenumber || '-' || v AS field, CASE max(CASE WHEN contains(t, v) THEN 2 WHEN length(t) > 1 AND contains(v, t) THEN 1 ELSE 0 END) WHEN 2 THEN 'hit' WHEN 1 THEN 'partial' ELSE 'miss' END AS state FROM w LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber, v""",
)
def field_states(read):
    """Part numbers of an order's lines against numbers found in its header."""
    wanted = read("lineitem").select("l_orderkey", _cat(_col("l_linenumber").cast("string"), _lit("-"), _col("l_partkey").cast("string")).alias("field"), _col("l_partkey").cast("string").alias("value"))
    found = read("orders").select(_col("o_orderkey").alias("l_orderkey"), F.explode(F.array(_cat(_lit(" NO "), _col("o_custkey").cast("string"), _lit("  x")), (_col("o_custkey") % 100).cast("string"))).alias("text"))
    return records.field_states(wanted, found, "l_orderkey")


@query(
    "block_titles",
    """SELECT l_orderkey, coalesce(arg_min(CASE WHEN l_returnflag = 'N' AND l_linenumber > 1 THEN l_linestatus || ' ' || l_partkey END, CASE WHEN l_returnflag = 'N' AND l_linenumber > 1 THEN l_linenumber * 1000000 + l_partkey * 2 + CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END END), 'Document') AS title FROM lineitem GROUP BY l_orderkey""",
)
def block_titles(read):
    text = F.when(_col("l_linenumber") > 1, _cat(_lit(" "), "l_linestatus", _lit(" \n "), _col("l_partkey").cast("string"))).otherwise(" ")
    b = read("lineitem").select("l_orderkey", (_col("l_linenumber") * 1_000_000 + _col("l_partkey") * 2 + F.when(_col("l_linestatus") == "F", 1).otherwise(0)).alias("ord"), _lit("TITLE").alias("kind"), F.when(_col("l_returnflag") == "N", "doc_title").otherwise("paragraph_title").alias("label"), text.alias("text"))
    return sinks.document_titles(b, "l_orderkey")


@query(
    "page_granularity",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'word' WHEN o_orderkey % 3 = 0 THEN 'word' WHEN o_orderkey % 2 = 0 THEN 'paragraph' END AS granularity FROM orders",
)
def page_granularity(read):
    some = lambda n: F.when(_col("o_orderkey") % n == 0, F.array(_lit(1))).otherwise(F.array().cast("array<int>"))
    wanted = F.when(_col("o_custkey") % 2 == 0, "word").otherwise("line")
    return read("orders").select("o_orderkey", pages.pick_granularity(wanted, paragraph=some(2), line=F.array().cast("array<int>"), word=some(3)).alias("granularity"))


@query(
    "matching_block_ratio",
    "SELECT p_partkey, round(2.0 * length(p_brand) / (2 * length(p_brand) + 3 + length(p_type)), 6) AS ratio FROM part",
    python=True,
)
def matching_block_ratio(read):
    """Texts against their beginnings."""
    return read("part").select("p_partkey", F.round(metrics.matching_ratio(_col("p_brand"), _cat("p_brand", _lit(" - "), "p_type")), 6).alias("ratio"))
