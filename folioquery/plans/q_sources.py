"""Queries on markup, trees and writers."""

from pyspark.sql import functions as F

from folioquery.functions.text import semantic_type, snake
from folioquery.functions.vectors import dot
from folioquery.operators import folds, layout
from folioquery.plans.registry import query
from folioquery.sources import markdown, markup, sinks

_TAGS = "<(?:h1|li|p)>[^<]*"


@query(
    "page_section_tree",
    rf"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TAGS}')) AS tag, generate_subscripts(regexp_extract_all(html, '{_TAGS}'), 1) AS pos FROM pages),
k AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS seq, tag LIKE '<h1>%' AS head FROM e WHERE trim(regexp_replace(regexp_extract(tag, '>(.*)$', 1, 's'), '[ \t\n\x0B\f\r]+', ' ', 'g')) <> ''),
p AS (SELECT page_id, seq, head, CASE WHEN head THEN 0 ELSE coalesce(max(CASE WHEN head THEN seq END) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS parent FROM k)
SELECT page_id, count(*) AS n_blocks, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) AS BIGINT) AS n_headings, CAST(sum(parent) AS BIGINT) AS parent_sum FROM p GROUP BY page_id""",
)
def page_section_tree(read):
    """The section tree of each page's headings, items and paragraphs, written as Markdown."""
    tags = F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))
    body = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "^<[a-z0-9]+>", ""), "[ \t\n\x0b\f\r]+", " "))
    lines = F.transform(tags, lambda t: F.when(body(t) == "", None).when(t.startswith("<h1>"), F.concat(F.lit("# "), body(t))).when(t.startswith("<li>"), F.concat(F.lit("- "), body(t))).otherwise(body(t)))
    docs = read("pages").select("page_id", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n\n").alias("md"))
    tree = markdown.section_tree(markdown.markdown_blocks(docs, "page_id", "md"), "page_id")
    return tree.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "heading").alias("n_headings"), F.sum("parent_seq").alias("parent_sum"))


@query(
    "json_element_attributes",
    "SELECT event_id, 'document' AS tag, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    python=True,
)
def json_element_attributes(read):
    got = markup.elements(read("events").select("event_id", "props"), "event_id", "props", "json")
    return got.select("event_id", "tag", F.col("attribs")["k"].alias("k")).where("k is not null")


@query(
    "xml_projection",
    r"""WITH c AS (SELECT conv_id, turn, turn // 2 % 2 AS page, role, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM conversations),
g AS (SELECT *, sum(CASE WHEN page IS DISTINCT FROM lag_page THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, lag(page) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_page FROM c)),
p AS (SELECT conv_id, grp, '<page number="' || page || '">' || string_agg('<' || role || '>' || coalesce(t, '') || '</' || role || '>', '' ORDER BY turn) || '</page>' AS x FROM g GROUP BY conv_id, grp, page)
SELECT conv_id, md5('<document>' || string_agg(x, '' ORDER BY grp) || '</document>') AS xml_md5 FROM p GROUP BY conv_id""",
)
def xml_projection(read):
    """Each conversation as XML; a page opens wherever its number changes."""
    c = read("conversations").select("conv_id", F.col("turn").alias("ord"), (F.floor(F.col("turn") / 2) % 2).alias("page"), F.col("role").alias("kind"), "text")
    return sinks.blocks_to_xml(c, "conv_id").select("conv_id", F.md5("xml").alias("xml_md5"))


@query(
    "attribute_columns",
    r"""WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'parent_id' WHEN 2 THEN p_brand ELSE p_type END AS name FROM part),
s AS (SELECT regexp_replace(regexp_replace(lower(regexp_replace(name, '[^0-9A-Za-z]+', '_', 'g')), '^_+|_+$', '', 'g'), '^([0-9])', '_\1') AS s FROM n)
SELECT CASE WHEN s IN ('id', 'parent_id', 'parent_table', 'text_content') THEN 'attr_' || s WHEN s = '' THEN 'value' ELSE s END AS col_name, count(*) AS n FROM s GROUP BY 1""",
)
def attribute_columns(read):
    k = F.col("p_size") % 4
    name = F.when(k == 0, "id").when(k == 1, "parent_id").when(k == 2, F.col("p_brand")).otherwise(F.col("p_type"))
    return read("part").groupBy(sinks.attribute_column(name).alias("col_name")).agg(F.count("*").alias("n"))


@query(
    "semantic_types",
    """WITH n AS (SELECT CASE n_nationkey % 6 WHEN 0 THEN ' VARCHAR' WHEN 1 THEN 'money' WHEN 2 THEN 'timestamp of day' WHEN 3 THEN 'uuid' WHEN 4 THEN 'Text' ELSE n_name END AS t FROM nation)
SELECT CASE lower(trim(t)) WHEN 'varchar' THEN 'string' WHEN 'money' THEN 'currency' WHEN 'timestamp of day' THEN 'datetime' WHEN 'uuid' THEN 'id' WHEN 'text' THEN 'text' ELSE 'string' END AS type,
  lower(trim(t)) IN ('varchar', 'money', 'timestamp of day', 'uuid', 'text') AS known, count(*) AS n FROM n GROUP BY ALL""",
)
def semantic_types(read):
    k = F.col("n_nationkey") % 6
    t = F.when(k == 0, " VARCHAR").when(k == 1, "money").when(k == 2, "timestamp of day").when(k == 3, "uuid").when(k == 4, "Text").otherwise(F.col("n_name"))
    return read("nation").withColumn("s", semantic_type(t)).groupBy(F.col("s.type").alias("type"), F.col("s.known").alias("known")).agg(F.count("*").alias("n"))


@query(
    "identifier_forms",
    r"SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(p_name || 'Unit', '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS snake_name FROM part",
)
def identifier_forms(read):
    return read("part").select("p_partkey", snake(F.concat("p_name", F.lit("Unit"))).alias("snake_name"))


@query(
    "cross_layout_boxes",
    """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS box, (l_partkey % 600)::DOUBLE AS x0, l_partkey % 600 + l_quantity * 8 AS x1 FROM lineitem),
w AS (SELECT * FROM (SELECT *, median(x1 - x0) OVER (PARTITION BY page) AS m FROM b) WHERE x1 - x0 > 1.3 * m)
SELECT w.page, w.box, count(*) AS n_across FROM w JOIN b ON b.page = w.page AND b.box <> w.box AND least(w.x1, b.x1) - greatest(w.x0, b.x0) > 0 GROUP BY w.page, w.box HAVING count(*) >= 2""",
)
def cross_layout_boxes(read):
    """Boxes much wider than the page's median that lie over two others or more."""
    x, n = (F.col("l_partkey") % 600).cast("double"), F.col("l_linenumber")
    b = read("lineitem").select(F.col("l_orderkey").alias("page"), n.alias("box"), x.alias("x0"), (n * 20.0).alias("y0"), (x + F.col("l_quantity") * 8).alias("x1"), (n * 20.0 + 10).alias("y1"))
    return layout.cross_layout(b, ["page"])


@query("packed_lines")
def packed_lines(read):
    """Words of each item packed to lines of 60 characters: lines and the longest."""
    lines = folds.pack_words(F.split("text", " "), 60)
    return read("benchmark").select("item_id", F.size(lines).alias("n_lines"), F.array_max(F.transform(lines, lambda w: F.length(F.array_join(w, " ")))).alias("longest"))


@query("joined_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def joined_unit_vectors(read):
    return read("embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))
