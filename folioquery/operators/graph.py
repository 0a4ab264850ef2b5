"""Entity graphs: foreign keys, roots, levels, document scopes, schema enforcement, and the
export of trees as tables."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.plans.workspace import Workspace


def dangling(children: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    """Child rows whose key has no parent; a null key counts."""
    return children.join(parents.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def resolved(children: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    return children.join(parents.select(F.col(pk).alias(fk)).distinct(), fk, "left_semi")


def roots(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that are never a child. entities: name; edges: parent, child."""
    return entities.join(edges.select(F.col("child").alias("name")).distinct(), "name", "left_anti")


def levels(entities: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(name, level): 1 for a root, else one more than the deepest parent. One join a level, each
    level a written table; a cycle ends at ``most`` and is an error."""
    ws = Workspace(entities.sparkSession, "levels")
    level = ws.table(roots(entities, edges).select("name", F.lit(1).cast("long").alias("level")), "level")
    out = level
    for n in range(2, most + 2):
        below = level.join(edges, level["name"] == edges["parent"]).select(F.col("child").alias("name"), F.lit(n).cast("long").alias("level")).distinct()
        level = ws.table(below, "level")
        if level.isEmpty():
            return out.groupBy("name").agg(F.max("level").alias("level"))
        out = out.union(level)
    raise ValueError("the graph is deeper than allowed or has a cycle")


def first_parent(edges: DataFrame) -> DataFrame:
    """Edges without unknown ends, loops and repeats; of a child's parents the first declared.
    edges: pos, parent, child."""
    ok = edges.where("parent is not null and child is not null and parent <> child")
    order = W.partitionBy("child").orderBy("pos")
    return ok.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def trim_entities(entities: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entities by priority: edges down, then declaration. entities: pos, name, edges."""
    return entities.orderBy(F.desc("edges"), "pos").limit(n)


def ranked(rows: DataFrame, key: str, name: str, parts: int = 64) -> DataFrame:
    """rows with ``name``, their place from 0 by the number ``key`` (nulls first). Rows are cut into about
    ``parts`` ranges at quantiles and ranked within them, so no task sorts all rows."""
    cuts = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts)))  # parts numbers at most
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce((F.col(key) > c).cast("int"), F.lit(0))
    cut = rows.withColumn("_part", part)
    before = cut.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a range
    place = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    return cut.withColumn("_at", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def round_robin(children: DataFrame, parents: DataFrame, orphan_percent: int, seed: int = 13) -> DataFrame:
    """(child, parent, orphan): children dealt over shuffled parents in turn; a share, picked
    by a hash of integers, gets a key that no parent has.

    children: child; parents: parent; both whole numbers, each once. The shuffle is by
    (id * 48271 + seed) modulo 2147483647, which tells ids under that number apart.
    """
    mixed = lambda c: (F.col(c).cast("long") * 48271 + seed) % 2147483647
    p = ranked(parents.select("parent", mixed("parent").alias("_m")), "_m", "_k").drop("_m")
    n = p.agg(F.count("*").alias("_n"))
    c = ranked(children.select("child"), "child", "_i").crossJoin(F.broadcast(n))  # one row
    dealt = c.withColumn("_k", F.try_mod("_i", "_n")).join(p, "_k")
    orphan = mixed("child") % 100 < orphan_percent
    return dealt.select("child", F.when(orphan, None).otherwise(F.col("parent")).alias("parent"), orphan.alias("orphan"))


def scopes(links: DataFrame, levels: int = 64) -> DataFrame:
    """(root, node, level): each record with the root it hangs under; a record without a
    resolving parent is a root. Records nested deeper than ``levels`` are an error. Each level is a
    written table. links: node, parent (null or unknown: none)."""
    ws = Workspace(links.sparkSession, "scopes")
    nodes = links.select("node").distinct()
    known = ws.table(links.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent"), "known")
    top = nodes.join(known.select("node"), "node", "left_anti")
    level = ws.table(top.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("level")), "level")
    out = level
    for n in range(1, levels + 1):
        below = known.select(F.col("node").alias("_c"), F.col("parent").alias("_p"))
        level = ws.table(level.join(below, F.col("node") == F.col("_p")).select("root", F.col("_c").alias("node"), F.lit(n).cast("long").alias("level")), "level")
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError("records are nested deeper than allowed")


def export_ids(elements: DataFrame, doc: str) -> DataFrame:
    """elements with ``id`` (a number for each table of a document, in order), ``parent_id`` and
    ``parent_table``. elements: doc, seq, parent_seq, tag."""
    order = W.partitionBy(doc, "tag").orderBy("seq")
    numbered = elements.withColumn("id", F.row_number().over(order).cast("long"))
    up = numbered.select(doc, F.col("seq").alias("parent_seq"), F.col("id").alias("parent_id"), F.col("tag").alias("parent_table"))
    return numbered.join(up, [doc, "parent_seq"], "left")


def tag_tree(events: DataFrame, doc: str) -> DataFrame:
    """(doc, seq, parent_seq, depth, tag) from tag events in order: opening (1) and closing
    (-1) steps; the parent of an element is the last one opened one level above it.
    events: doc, pos, tag, step."""
    order = W.partitionBy(doc).orderBy("pos")
    depth = F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0))
    opened = events.withColumn("depth", depth).where("step = 1").withColumn("seq", F.row_number().over(order).cast("long"))
    # on a level: the elements of the level, and those below it that look for the last before them
    above = opened.select(doc, F.col("depth").alias("_level"), "pos", F.col("seq").alias("_open"), F.lit(None).cast("long").alias("seq"), "depth", "tag")
    below = opened.select(doc, (F.col("depth") - 1).alias("_level"), "pos", F.lit(None).cast("long").alias("_open"), "seq", "depth", "tag")
    last = F.last("_open", ignorenulls=True).over(W.partitionBy(doc, "_level").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    found = above.union(below).withColumn("parent_seq", last).where("seq is not null")
    return found.select(doc, "seq", "parent_seq", F.col("depth").cast("long").alias("depth"), "tag")
