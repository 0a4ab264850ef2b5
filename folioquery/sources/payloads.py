"""Schemas and records as models and files give them in JSON: several spellings and shapes
become flat tables, unreadable entries a table of their own."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.text import as_bool, pascal, reference_parts, semantic_type, snake

_ITEM = "array<struct<given:string,body:string,kind:string>>"
#: The names under which each part comes.
WRAPPERS = ["schema", "er_graph", "graph", "result", "output"]
ENTITIES, ATTRIBUTES = ["entities", "tables", "classes"], ["attributes", "fields", "columns", "properties"]
RELATIONSHIPS = ["relationships", "foreign_keys", "links", "relations", "joins"]
ENTITY_NAME, ATTRIBUTE_NAME = ["name", "entity", "table", "class"], ["name", "attribute", "field", "column"]
ATTRIBUTE_TYPE = ["type", "data_type", "dtype"]
NO_NAME = [*ATTRIBUTE_TYPE, "description", "required", "nullable", "unique", "values", "enum"]
ARROW = ["fk", "foreign_key", "relationship", "link", "join", "ref"]
CHILD, CHILD_COLUMN = ["child", "from", "child_entity", "many", "source"], ["child_attribute", "foreign_key_attribute", "fk_column"]
PARENT, PARENT_COLUMN = ["parent", "to", "parent_entity", "one", "target", "references"], ["parent_attribute", "referenced_attribute", "pk_column"]


def _get(body: Column, names: list[str]) -> Column:
    """The first of the fields that is there and isn't empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(body, f"$.{n}"), F.lit("")) for n in names])


def json_items(c: Column) -> Column:
    """array<struct<given, body, kind>> of a list, of a mapping from names, or of one value.

    body is an object's JSON; given is a bare value, or the key that names the entry; kind is
    the value of a mapping that is no object.
    """
    none = F.lit(None).cast("string")
    is_object = lambda v: v.rlike(r"^\s*\{")
    item = lambda given, body, kind: F.struct(given.alias("given"), body.alias("body"), kind.alias("kind"))
    bare = lambda v: item(F.when(~is_object(v), v), F.when(is_object(v), v), none)
    named = lambda e: item(e["key"], F.when(is_object(e["value"]), e["value"]), F.when(~is_object(e["value"]), e["value"]))
    listed = F.transform(F.from_json(F.when(c.rlike(r"^\s*\["), c), "array<string>"), bare)
    mapped = F.transform(F.map_entries(F.from_json(F.when(is_object(c), c), "map<string,string>")), named)
    lone = F.when(c.isNotNull() & (F.trim(c) != ""), F.array(bare(c)))
    return F.coalesce(listed.cast(_ITEM), mapped.cast(_ITEM), lone.cast(_ITEM), F.array().cast(_ITEM))


def _unwrapped(c: Column) -> Column:
    """The object with the entities, where it is one level down."""
    inner = [F.get_json_object(c, f"$.{w}") for w in WRAPPERS]
    some = lambda i: F.get_json_object(i, "$.entities").isNotNull() | F.get_json_object(i, "$.tables").isNotNull()
    return F.coalesce(*[F.when(some(i), i) for i in inner], c)


def _attribute(a: Column) -> Column:
    """struct(name, type, required) of an attribute's entry; the name is null if there is none."""
    keys = F.map_keys(F.from_json(a["body"], "map<string,string>"))
    extra = F.filter(keys, lambda k: ~k.isin(NO_NAME))
    name = F.coalesce(_get(a["body"], ATTRIBUTE_NAME), a["given"])
    single = F.when(name.isNull() & (F.size(extra) == 1), F.get(extra, F.lit(0)))
    kind = F.coalesce(_get(a["body"], ATTRIBUTE_TYPE), a["kind"], F.try_element_at(F.from_json(a["body"], "map<string,string>"), single), F.lit("string"))
    found = F.coalesce(name, single)
    nullable = F.get_json_object(a["body"], "$.nullable")
    required = F.coalesce(as_bool(F.get_json_object(a["body"], "$.required"), None), F.when(nullable.isNotNull(), ~as_bool(nullable, True)), F.lit(False))
    return F.struct(F.when(found.isNotNull(), snake(found)).alias("name"), semantic_type(kind)["type"].alias("type"), required.alias("required"))


def read_entities(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, name, primary_key, attributes, entry) of schema payloads; attributes is an
    array of struct(name, type, required). An entity without a name, or with an attribute
    without one, has a null name: see dropped_entries()."""
    each = rows.select(key, F.posexplode(json_items(_get(_unwrapped(F.col(payload)), ENTITIES))).alias("pos", "e"))
    each = each.withColumn("attributes", F.transform(json_items(_get(F.col("e.body"), ATTRIBUTES)), _attribute))
    name = F.coalesce(_get(F.col("e.body"), ENTITY_NAME), F.col("e.given"))
    ok = ~F.exists("attributes", lambda a: a["name"].isNull())
    return each.select(
        key, F.col("pos").cast("long").alias("pos"), F.when(ok & name.isNotNull(), pascal(name)).alias("name"), snake(F.coalesce(_get(F.col("e.body"), ["primary_key", "pk"]), F.lit("id"))).alias("primary_key"), "attributes", F.coalesce("e.body", "e.given").alias("entry")
    )


def read_attributes(entities: DataFrame, key: str) -> DataFrame:
    """(key, entity_pos, entity, pos, name, type, required) of read_entities()' readable rows."""
    each = entities.where("name is not null").select(key, F.col("pos").alias("entity_pos"), F.col("name").alias("entity"), F.posexplode("attributes").alias("pos", "a"))
    return each.select(key, "entity_pos", "entity", F.col("pos").cast("long").alias("pos"), "a.name", "a.type", "a.required")


def read_relationships(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, child, child_attribute, parent, parent_attribute, entry) of schema payloads:
    ``Child.col -> Parent.col``, alone or in a field, or the sides in fields. child is null if
    a side isn't named; a parent's column is ``id`` if not given, a child's is the parent's
    name and column."""
    each = rows.select(key, F.posexplode(json_items(_get(_unwrapped(F.col(payload)), RELATIONSHIPS))).alias("pos", "e"))
    arrow = [F.get_json_object("e.body", f"$.{n}") for n in ARROW]
    text = F.coalesce(F.col("e.given"), *[F.when(a.contains("->"), a) for a in arrow])
    sides = F.split(text, "->", 2)
    child = F.when(text.isNotNull(), sides[0]).otherwise(_get(F.col("e.body"), CHILD))
    parent = F.when(text.isNotNull(), F.get(sides, F.lit(1))).otherwise(_get(F.col("e.body"), PARENT))
    # a text's sides hold their columns; fields may name the columns too
    given = lambda names: F.when(text.isNull(), _get(F.col("e.body"), names))
    each = each.withColumn("c", reference_parts(child)).withColumn("p", reference_parts(parent))
    whole_ref = (F.coalesce("c.entity", F.lit("")) != "") & (F.coalesce("p.entity", F.lit("")) != "")
    column = lambda names, side, other: F.coalesce(given(names), F.nullif(F.col(f"{side}.column"), F.lit("")), F.lit(other))
    up, up_column = pascal(F.col("p.entity")), snake(column(PARENT_COLUMN, "p", "id"), "id")
    child_column = snake(F.coalesce(F.nullif(column(CHILD_COLUMN, "c", ""), F.lit("")), F.concat_ws("_", up, up_column)), "parent_id")
    return each.select(
        key,
        F.col("pos").cast("long").alias("pos"),
        F.when(whole_ref, pascal(F.col("c.entity"))).alias("child"),
        child_column.alias("child_attribute"),
        F.when(whole_ref, up).alias("parent"),
        up_column.alias("parent_attribute"),
        F.coalesce("e.body", "e.given").alias("entry"),
    )


def dropped_entries(entities: DataFrame, relationships: DataFrame, key: str) -> DataFrame:
    """(key, kind, pos, entry) of what read_entities() and read_relationships() couldn't read."""
    e = entities.where("name is null").select(key, F.lit("entity").alias("kind"), "pos", "entry")
    return e.union(relationships.where("child is null").select(key, F.lit("relationship"), "pos", "entry"))


def read_instances(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, domain, pos, id, entity, attributes, foreign_keys) of instance payloads."""
    kind = "struct<id:string,entity_name:string,attributes:map<string,string>,foreign_keys:map<string,string>>"
    read = F.from_json(F.col(payload), f"schema_domain string, records array<{kind}>")
    each = rows.select(key, F.coalesce(read["schema_domain"], F.lit("")).alias("domain"), F.posexplode(read["records"]).alias("pos", "r"))
    none = F.create_map().cast("map<string,string>")
    return each.select(key, "domain", F.col("pos").cast("long").alias("pos"), "r.id", F.col("r.entity_name").alias("entity"), F.coalesce("r.attributes", none).alias("attributes"), F.coalesce("r.foreign_keys", none).alias("foreign_keys"))


def records_of(c: Column) -> Column:
    """array<struct<entity, key, raw_key, value, src>> of a file of extracted records, a list or
    an object that holds one: what is missing is empty, a raw key the key."""
    listed = F.coalesce(F.when(c.rlike(r"^\s*\["), c), F.get_json_object(c, "$.records"))
    kind = "array<struct<entity:string,key:string,raw_key:string,value:string,src:string>>"
    text = lambda v: F.coalesce(v, F.lit(""))
    return F.transform(
        F.from_json(listed, kind),
        lambda r: F.struct(text(r["entity"]).alias("entity"), text(r["key"]).alias("key"), F.coalesce(F.nullif(r["raw_key"], F.lit("")), text(r["key"])).alias("raw_key"), text(r["value"]).alias("value"), text(r["src"]).alias("src")),
    )


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(origin, pos, entity, key, raw_key, value, src) of record files; origin is the file's name."""
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("origin"), "value")
    return files.select("origin", F.posexplode(records_of(F.col("value"))).alias("pos", "r")).select("origin", "pos", "r.*")
