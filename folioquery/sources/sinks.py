"""Writers: a CSV bundle of exported tables, XML and Markdown of blocks, JSON, DDL."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions.text import clean_ws, sql_ident, xml_escape, xml_tag

RESERVED = ["id", "parent_id", "parent_table", "text_content"]


def attribute_column(name: Column) -> Column:
    """Column for an attribute; reserved names get a prefix."""
    s = sql_ident(name)
    return F.when(s.isin(RESERVED), F.concat(F.lit("attr_"), s)).otherwise(s)


def exported_table(exported: DataFrame, tag: str) -> DataFrame:
    """One table of export_ids()' elements: id, parent_id, parent_table, a column for each
    attribute (all text), text_content. Of attributes that share a column the last stays."""
    rows = exported.where(F.col("tag") == tag)
    names = [r[0] for r in rows.select(F.explode(F.map_keys("attribs")).alias("k")).select(attribute_column(F.col("k"))).distinct().orderBy(1).collect()]  # the table's columns

    def last(name):
        own = F.filter(F.map_entries("attribs"), lambda e: attribute_column(e["key"]) == name)
        return F.get(F.transform(own, lambda e: e["value"]), F.size(own) - 1).alias(name)

    return rows.select("id", "parent_id", "parent_table", *[last(n) for n in names], F.col("text").alias("text_content")).orderBy("id")


def write_csv_bundle(exported: DataFrame, folder: str) -> list[str]:
    """A CSV folder for each tag, with a header, null as empty."""
    tags = [r[0] for r in exported.select("tag").distinct().orderBy("tag").collect()]  # tables of the export
    for tag in tags:
        exported_table(exported, tag).write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{folder}/{tag}")
    return tags


def create_statement(table: str, columns: list[str], parents: list[str]) -> str:
    """DDL with text columns; a foreign key only where exactly one parent table occurs."""
    body = ['"id" INTEGER PRIMARY KEY', '"parent_id" INTEGER', '"parent_table" TEXT', *[f'"{c}" TEXT' for c in columns]]
    if len(parents) == 1:
        body.append(f'FOREIGN KEY ("parent_id") REFERENCES "{parents[0]}" ("id")')
    return f'CREATE TABLE "{table}" (' + ", ".join(body) + ")"


def blocks_to_xml(blocks: DataFrame, key: str) -> DataFrame:
    """(key, xml): blocks in order inside page elements. A page opens where the page number
    changes, so a page that comes back opens again. blocks: key, ord, page, kind, text."""
    order = W.partitionBy(key).orderBy("ord")
    turn = F.coalesce(F.col("page") != F.lag("page").over(order), F.lit(True))
    rows = blocks.withColumn("_g", F.sum(turn.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    tag = xml_tag(F.lower("kind"), "block")
    rows = rows.withColumn("_x", F.concat(F.lit("<"), tag, F.lit(">"), xml_escape(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">")))
    joined = lambda c, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda s: s[c]), "")
    pages = rows.groupBy(key, "_g", "page").agg(joined("_x", "ord").alias("_x"))
    pages = pages.withColumn("_x", F.concat(F.format_string('<page number="%d">', F.col("page").cast("int")), "_x", F.lit("</page>")))
    return pages.groupBy(key).agg(F.concat(F.lit("<document>"), joined("_x", "_g"), F.lit("</document>")).alias("xml"))


def document_titles(blocks: DataFrame, key: str, default: str = "Document") -> DataFrame:
    """(key, title): the first title block of the whole document that has a text, collapsed.
    blocks: key, ord, kind, label, text."""
    t = clean_ws(F.col("text"))
    ok = (F.col("kind") == "TITLE") & F.col("label").isin("doc_title", "title") & (t != "")
    return blocks.groupBy(key).agg(F.coalesce(F.min_by(F.when(ok, t), F.when(ok, F.col("ord"))), F.lit(default)).alias("title"))


def blocks_to_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """(key, markdown): titles as headings, other texts as they are, blank lines between."""
    t = F.when(F.col("kind") == "TITLE", F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    rows = blocks.where("text is not null and text <> ''").withColumn("_t", t)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "_t"))), lambda s: s["_t"]), "\n\n").alias("markdown"))


def to_json_lines(rows: DataFrame, folder: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(folder)


def upsert_latest(log: DataFrame, keys: list[str], order: list[str], verdict: str = "verdict", clear: str = "clear") -> DataFrame:
    """The last row of each key; one whose verdict is ``clear`` takes the key out."""
    last = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_r", F.row_number().over(last)).where((F.col("_r") == 1) & (F.col(verdict) != clear)).drop("_r")
