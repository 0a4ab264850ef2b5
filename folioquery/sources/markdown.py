"""Markdown documents as trees of rows."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, kind, level, text): headings, fenced code, list items and paragraphs in order.

    A fence runs from one line of three backticks to the next; a paragraph ends at a blank
    line or at any other block. Level is the number of a heading's marks, else null.
    """
    order = W.partitionBy(key).orderBy("line")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "t"))
    lines = lines.withColumn("mark", F.col("t").rlike("^[ \t]*```")).withColumn("fences", F.sum(F.col("mark").cast("int")).over(upto))
    lines = lines.withColumn("code", ~F.col("mark") & (F.col("fences") % 2 == 1))
    kind = (
        F.when(F.col("mark"), "fence")
        .when(F.col("code"), "code")
        .when(F.col("t").rlike("^#{1,6}[ \t]+[^ \t]"), "heading")
        .when(F.col("t").rlike(r"^[ \t]*([-*+]|[0-9]+[.)])[ \t]+"), "item")
        .when(F.trim("t") == "", "blank")
        .otherwise("paragraph")
    )
    lines = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(order))
    fresh = F.col("kind").isin("heading", "item") | ~F.col("kind").eqNullSafe(F.col("before"))
    lines = lines.withColumn("block", F.sum(fresh.cast("int")).over(upto)).where("kind not in ('blank', 'fence')")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n")
    blocks = lines.groupBy(key, "block", "kind").agg(joined.alias("t"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("t", "^(#+)", 1)))
    body = F.when(F.col("kind") == "heading", F.regexp_replace("t", "^#+[ \t]+|[ \t]+#*[ \t]*$", "")).when(F.col("kind") == "item", F.regexp_replace("t", r"^[ \t]*([-*+]|[0-9]+[.)])[ \t]+", "")).otherwise(F.col("t"))
    return blocks.select(key, F.row_number().over(W.partitionBy(key).orderBy("block")).cast("long").alias("seq"), "kind", level.alias("level"), body.alias("text"))


def section_tree(blocks: DataFrame, key: str) -> DataFrame:
    """blocks with ``parent_seq``: the last heading before of a smaller level (for other
    blocks, the last heading); 0, the document, if there is none."""
    order = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    nearest = [F.last(F.when(F.col("level") == n, F.col("seq")), ignorenulls=True).over(order) for n in range(1, 7)]
    rows = blocks.select("*", F.array(*[F.coalesce(n, F.lit(0)).cast("long") for n in nearest]).alias("_n"))
    reach = F.coalesce(F.col("level") - 1, F.lit(6))
    parent = F.when(reach <= 0, 0).otherwise(F.array_max(F.slice("_n", 1, F.greatest(reach, F.lit(1)))))
    return rows.withColumn("parent_seq", F.coalesce(parent, F.lit(0)).cast("long")).drop("_n")


def node_texts(tree: DataFrame) -> DataFrame:
    """Passages to align: a heading's title, any other block's text; empty ones left out."""
    return tree.where(F.trim("text") != "")


def first_title(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.where("kind = 'heading'").groupBy(key).agg(F.min_by("text", "seq").alias("title"))
