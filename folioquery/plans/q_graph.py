"""Queries on entity graphs and trees over the star schema and the web pages."""

from pyspark.sql import functions as F

from folioquery.operators import forest, graph
from folioquery.operators.align import closure
from folioquery.operators.components import connected_components
from folioquery.plans.registry import query
from folioquery.plans.workspace import Workspace


def _links(read):
    """Region, nation and customer as nodes with their parents."""
    r = read("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = read("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    c = read("customer").select(F.concat(F.lit("c"), "c_custkey"), F.when(F.col("c_custkey") % 10 == 3, F.lit(None)).otherwise(F.concat(F.lit("n"), "c_nationkey")))
    return r.union(n).union(c)


LINKS_SQL = """links AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE 'n' || c_nationkey END FROM customer)"""


@query(
    "tree_closure_counts",
    f"""WITH RECURSIVE {LINKS_SQL}, t AS (SELECT node AS ancestor, node, 0 AS depth FROM links UNION ALL SELECT t.ancestor, l.node, depth + 1 FROM t JOIN links l ON l.parent = t.node)
SELECT substr(ancestor, 1, 1) AS kind, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM t GROUP BY ALL""",
)
def tree_closure_counts(read):
    edges = _links(read).select(F.col("node").alias("child"), "parent")
    return closure(edges).groupBy(F.substring("ancestor", 1, 1).alias("kind"), "depth").agg(F.count("*").alias("n"))


@query(
    "document_scopes",
    f"""WITH RECURSIVE {LINKS_SQL}, t AS (SELECT node AS root, node, 0 AS level FROM links WHERE parent IS NULL UNION ALL SELECT t.root, l.node, level + 1 FROM t JOIN links l ON l.parent = t.node)
SELECT root, count(*) AS n_records, CAST(max(level) AS BIGINT) AS depth FROM t GROUP BY root""",
)
def document_scopes(read):
    return graph.scopes(_links(read)).groupBy("root").agg(F.count("*").alias("n_records"), F.max("level").alias("depth"))


@query("scope_partition_check", f"WITH {LINKS_SQL} SELECT count(*) AS n, count(DISTINCT node) AS n_nodes, CAST(0 AS BIGINT) AS lost FROM links")
def scope_partition_check(read):
    """Every record lies in exactly one scope."""
    links = _links(read)
    got = graph.scopes(links)
    lost = links.join(got.select("node"), "node", "left_anti").agg(F.count("*").alias("lost"))
    return got.agg(F.count("*").alias("n"), F.countDistinct("node").alias("n_nodes")).crossJoin(lost)  # one row each


@query("fk_dangling", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def fk_dangling(read):
    """Documents that no label names."""
    return graph.dangling(read("documents"), "doc_id", read("labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("fk_resolved", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_mktsegment")
def fk_resolved(read):
    return graph.resolved(read("customer"), "c_custkey", read("orders"), "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _parts(read):
    """A graph over part numbers: each hangs under its number halved; every third also under a third of it."""
    p = read("part").select(F.col("p_partkey").alias("k"))
    one = p.where("k > 1").select((F.col("k") * 2).alias("pos"), F.floor(F.col("k") / 2).alias("parent"), F.col("k").alias("child"))
    two = p.where("k > 3 and k % 3 = 0").select((F.col("k") * 2 + 1).alias("pos"), F.floor(F.col("k") / 3).alias("parent"), F.col("k").alias("child"))
    return p, one.union(two)


PARTS_SQL = "edges AS (SELECT p_partkey * 2 AS pos, p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey * 2 + 1, p_partkey // 3, p_partkey FROM part WHERE p_partkey > 3 AND p_partkey % 3 = 0)"


@query(
    "schema_levels",
    f"WITH RECURSIVE {PARTS_SQL}, t AS (SELECT p_partkey AS name, 1 AS level FROM part WHERE p_partkey NOT IN (SELECT child FROM edges) UNION SELECT child, level + 1 FROM t JOIN edges ON parent = name) SELECT level, count(*) AS n FROM (SELECT name, CAST(max(level) AS BIGINT) AS level FROM t GROUP BY name) GROUP BY level",
)
def schema_levels(read):
    names, edges = _parts(read)
    return graph.levels(names.withColumnRenamed("k", "name"), edges.select("parent", "child")).groupBy("level").agg(F.count("*").alias("n"))


@query("schema_roots", f"WITH {PARTS_SQL} SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT child FROM edges)")
def schema_roots(read):
    names, edges = _parts(read)
    return graph.roots(names.withColumnRenamed("k", "name"), edges)


@query("first_parent_only", f"WITH {PARTS_SQL} SELECT parent, count(*) AS n_children FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY pos DESC) AS r FROM edges WHERE parent <> child) WHERE r = 1 GROUP BY parent")
def first_parent_only(read):
    _, edges = _parts(read)
    return graph.first_parent(edges.withColumn("pos", -F.col("pos"))).groupBy("parent").agg(F.count("*").alias("n_children"))


@query(
    "components",
    """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(100 + n_regionkey AS BIGINT) AS b FROM nation UNION ALL SELECT 1000 + c_custkey, c_nationkey FROM customer), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT DISTINCT a AS node, a AS c FROM b UNION SELECT b.b, t.c FROM t JOIN b ON t.node = b.a) SELECT node, min(c) AS component FROM t GROUP BY node""",
)
def components(read):
    """What hangs together of regions, nations and customers."""
    n = read("nation").select(F.col("n_nationkey").cast("long").alias("a"), (100 + F.col("n_regionkey")).cast("long").alias("b"))
    c = read("customer").select(1000 + F.col("c_custkey"), F.col("c_nationkey").cast("long"))
    return connected_components(n.union(c), Workspace(n.sparkSession, "components"))


@query(
    "fk_round_robin_plan",
    """WITH p AS (SELECT c_custkey AS parent, row_number() OVER (ORDER BY (c_custkey * 48271 + 13) % 2147483647, c_custkey) - 1 AS k FROM customer), n AS (SELECT count(*) AS n FROM customer),
c AS (SELECT o_orderkey AS child, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), d AS (SELECT child, parent, (child * 48271 + 13) % 2147483647 % 100 < 10 AS orphan FROM c, n JOIN p ON p.k = i % n)
SELECT CASE WHEN orphan THEN NULL ELSE parent END AS parent, count(*) AS n, CAST(sum(child) AS BIGINT) AS child_sum FROM d GROUP BY 1""",
)
def fk_round_robin_plan(read):
    dealt = graph.round_robin(read("orders").select(F.col("o_orderkey").alias("child")), read("customer").select(F.col("c_custkey").alias("parent")), 10)
    return dealt.groupBy("parent").agg(F.count("*").alias("n"), F.sum("child").alias("child_sum"))


@query(
    "null_injection_rate",
    "SELECT c_mktsegment, count(*) AS n, CAST(sum(CASE WHEN (c_custkey * 48271 + 7) % 2147483647 % 100 < 15 THEN 1 ELSE 0 END) AS BIGINT) AS nulls, round(sum(CASE WHEN (c_custkey * 48271 + 7) % 2147483647 % 100 < 15 THEN 0 ELSE c_acctbal END), 2) AS kept_sum FROM customer GROUP BY c_mktsegment",
)
def null_injection_rate(read):
    """Optional values set to null for a share of rows, by a hash of the key."""
    gone = (F.col("c_custkey") * 48271 + 7) % 2147483647 % 100 < 15
    rows = read("customer").withColumn("value", F.when(~gone, F.col("c_acctbal")))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.round(F.sum("value"), 2).alias("kept_sum"))


TAGS_SQL = r"""ev AS (SELECT page_id, unnest(regexp_extract_all(html, '</?(?:ul|li|nav|article|p|h1)>')) AS t, generate_subscripts(regexp_extract_all(html, '</?(?:ul|li|nav|article|p|h1)>'), 1) AS pos FROM pages),
st AS (SELECT page_id, pos, trim(t, '</>') AS tag, CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END AS step, sum(CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM ev),
op AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS seq FROM st WHERE step = 1),
tree AS (SELECT o.page_id, o.seq, o.tag, CAST(o.depth AS BIGINT) AS depth, (SELECT max(u.seq) FROM op u WHERE u.page_id = o.page_id AND u.depth = o.depth - 1 AND u.pos < o.pos) AS parent_seq FROM op o),
num AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY seq) AS id FROM tree),
ex AS (SELECT n.page_id, n.tag, n.seq, n.depth, n.id, p.id AS parent_id, p.tag AS parent_table FROM num n LEFT JOIN num p ON p.page_id = n.page_id AND p.seq = n.parent_seq)"""


@query(
    "relational_export_ids",
    f"WITH {TAGS_SQL} SELECT page_id, tag, count(*) AS n, max(depth) AS depth, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(parent_id) AS BIGINT) AS parent_sum, count(DISTINCT parent_table) AS n_parents FROM ex GROUP BY page_id, tag",
)
def relational_export_ids(read):
    """The tags of a page as one table a tag, numbered, with parent keys."""
    tags = F.regexp_extract_all("html", F.lit("</?(?:ul|li|nav|article|p|h1)>"), F.lit(0))
    ev = read("pages").select("page_id", F.posexplode(tags).alias("pos", "t"))
    ev = ev.select("page_id", "pos", F.regexp_replace("t", "[</>]", "").alias("tag"), F.when(F.col("t").startswith("</"), -1).otherwise(1).alias("step"))
    ex = graph.export_ids(graph.tag_tree(ev, "page_id"), "page_id")
    return ex.groupBy("page_id", "tag").agg(
        F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum("id").alias("id_sum"), F.sum("parent_id").alias("parent_sum"), F.countDistinct("parent_table").alias("n_parents")
    )


MOST_ENTITIES, MOST_DEPTH = 15, 3


def brand_graphs(read):
    """A schema for each brand: some of the nations as entities, in an order of their own, and a relationship
    for each part, many of them to unknown entities, back to where they come from, or in a circle."""
    brand = read("part").select(F.col("p_brand").alias("graph"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("b")).distinct()
    ents = brand.join(F.broadcast(read("nation")), (F.col("n_nationkey") + F.col("b")) % 6 != 0)  # few names a brand
    ents = ents.select("graph", ((F.col("n_nationkey") * 7 + F.col("b")) % 25).alias("pos"), F.col("n_name").alias("name"))
    nation = lambda c: F.concat(F.lit("NATION_"), c)
    rels = read("part").select(
        F.col("p_brand").alias("graph"),
        F.col("p_partkey").alias("pos"),
        nation((F.col("p_partkey") * 7 + F.col("p_size")) % 27).alias("child"),
        F.when(F.col("p_type") == "PROMO", "b").otherwise("a").alias("child_attribute"),
        nation(F.col("p_size") % 26).alias("parent"),
    )
    return ents, rels


#: Relationships are folded one by one: ``roots`` (and ``depths``) lie beside ``names``, each name's root so far.
ENFORCED_SQL = f"""WITH RECURSIVE br AS (SELECT DISTINCT p_brand AS graph, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS b FROM part),
ent AS MATERIALIZED (SELECT graph, (n_nationkey * 7 + b) % 25 AS pos, n_name AS name FROM br, nation WHERE (n_nationkey + b) % 6 <> 0),
rel AS (SELECT p_brand AS graph, p_partkey AS pos, 'NATION_' || (p_partkey * 7 + p_size) % 27 AS child, CASE WHEN p_type = 'PROMO' THEN 'b' ELSE 'a' END AS child_attribute, 'NATION_' || p_size % 26 AS parent FROM part),
chk AS MATERIALIZED (SELECT rel.*, CASE WHEN p.name IS NULL THEN 'unknown_parent' WHEN c.name IS NULL THEN 'unknown_child' WHEN child = parent THEN 'loop' END AS bad
  FROM rel LEFT JOIN ent p ON p.graph = rel.graph AND p.name = parent LEFT JOIN ent c ON c.graph = rel.graph AND c.name = child),
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY pos) AS i FROM chk WHERE bad IS NULL),
f1 AS (SELECT graph, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, list(name ORDER BY pos) AS names, list(name ORDER BY pos) AS roots, CAST([] AS VARCHAR[]) AS keys, CAST(NULL AS VARCHAR) AS fate FROM ent GROUP BY graph
  UNION ALL SELECT graph, i, pos, names, CASE WHEN fate = 'kept' THEN list_transform(roots, lambda r: CASE WHEN r = child THEN rp ELSE r END) ELSE roots END, CASE WHEN fate = 'kept' THEN list_append(keys, key) ELSE keys END, fate
  FROM (SELECT f1.graph, c.i, c.pos, names, roots, keys, child, rp, key, CASE WHEN list_contains(keys, key) THEN 'duplicate' WHEN rc <> child THEN 'second_parent' WHEN rp = child THEN 'cycle' ELSE 'kept' END AS fate
    FROM f1, LATERAL (SELECT c.i, c.pos, c.child, c.child || '.' || c.child_attribute || '.' || c.parent AS key, f1.roots[list_position(f1.names, c.parent)] AS rp, f1.roots[list_position(f1.names, c.child)] AS rc FROM cand c WHERE c.graph = f1.graph AND c.i = f1.i + 1) c)),
k1 AS MATERIALIZED (SELECT cand.* FROM f1 JOIN cand USING (graph, pos) WHERE f1.fate = 'kept'),
t1 AS (SELECT e.graph, e.name, e.name AS root, [e.pos] AS path FROM ent e LEFT JOIN k1 ON k1.graph = e.graph AND k1.child = e.name WHERE k1.child IS NULL
  UNION ALL SELECT t1.graph, e.name, t1.root, list_append(t1.path, e.pos) FROM t1 JOIN k1 ON k1.graph = t1.graph AND k1.parent = t1.name JOIN ent e ON e.graph = t1.graph AND e.name = k1.child),
sz AS (SELECT graph, root, count(*) AS n, min(path[len(path)]) AS first FROM t1 GROUP BY ALL),
pri AS MATERIALIZED (SELECT graph, name, row_number() OVER (PARTITION BY graph ORDER BY n DESC, first, len(path), path) - 1 AS priority FROM t1 JOIN sz USING (graph, root)),
stay AS MATERIALIZED (SELECT ent.* FROM ent JOIN pri USING (graph, name) WHERE priority < {MOST_ENTITIES}),
k2 AS MATERIALIZED (SELECT k1.* EXCLUDE (i), row_number() OVER (PARTITION BY k1.graph ORDER BY k1.pos) AS i FROM k1 JOIN stay p ON p.graph = k1.graph AND p.name = parent JOIN stay c ON c.graph = k1.graph AND c.name = child),
f2 AS (SELECT graph, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, list(name ORDER BY pos) AS names, list(name ORDER BY pos) AS roots, list(CAST(0 AS BIGINT)) AS depths, CAST(NULL AS BOOLEAN) AS deep FROM stay GROUP BY graph
  UNION ALL SELECT graph, i, pos, names, CASE WHEN deep THEN roots ELSE list_transform(roots, lambda r: CASE WHEN r = child THEN rp ELSE r END) END,
    CASE WHEN deep THEN depths ELSE list_transform(depths, lambda d, j: CASE WHEN roots[j] = child THEN d + dp + 1 ELSE d END) END, deep
  FROM (SELECT f2.graph, c.i, c.pos, names, roots, depths, child, rp, dp, dp + 2 + list_max(list_transform(depths, lambda d, j: CASE WHEN roots[j] = child THEN d ELSE 0 END)) > {MOST_DEPTH} AS deep
    FROM f2, LATERAL (SELECT k2.i, k2.pos, k2.child, f2.roots[list_position(f2.names, k2.parent)] AS rp, f2.depths[list_position(f2.names, k2.parent)] AS dp FROM k2 WHERE k2.graph = f2.graph AND k2.i = f2.i + 1) c)),
k3 AS MATERIALIZED (SELECT k2.* FROM f2 JOIN k2 USING (graph, pos) WHERE NOT f2.deep),
t3 AS (SELECT s.graph, s.name, [s.pos] AS path FROM stay s LEFT JOIN k3 ON k3.graph = s.graph AND k3.child = s.name WHERE k3.child IS NULL
  UNION ALL SELECT t3.graph, k3.child, list_append(t3.path, k3.pos) FROM t3 JOIN k3 ON k3.graph = t3.graph AND k3.parent = t3.name)"""


def _enforced(read):
    return forest.enforce(*brand_graphs(read), most_entities=MOST_ENTITIES, most_depth=MOST_DEPTH)


@query(
    "schema_edge_fates",
    f"""{ENFORCED_SQL}
SELECT chk.graph, chk.pos, child, child_attribute, parent, coalesce(bad, CASE WHEN f1.fate <> 'kept' THEN f1.fate WHEN f2.deep IS NULL THEN 'trimmed' WHEN f2.deep THEN 'too_deep' ELSE 'kept' END) AS fate
FROM chk LEFT JOIN f1 ON f1.graph = chk.graph AND f1.pos = chk.pos LEFT JOIN f2 ON f2.graph = chk.graph AND f2.pos = chk.pos""",
    python=True,
)
def schema_edge_fates(read):
    """What becomes of each relationship of the brands' schemas."""
    return _enforced(read)[1]


@query(
    "schema_entity_places",
    f"""{ENFORCED_SQL}
SELECT pri.graph, pri.name, priority, CAST(len(path) AS BIGINT) AS level, CASE WHEN path IS NOT NULL THEN row_number() OVER (PARTITION BY pri.graph ORDER BY path IS NULL, len(path), path) - 1 END AS place,
  CASE WHEN path IS NULL THEN 'trimmed' ELSE 'kept' END AS fate
FROM pri LEFT JOIN t3 ON t3.graph = pri.graph AND t3.name = pri.name""",
    python=True,
)
def schema_entity_places(read):
    """The brands' entities by priority, and those that stay by level and order of filling."""
    return _enforced(read)[0].select("graph", "name", "priority", "level", "place", "fate")
