"""Entity schemas and instances as tables: entities (pos, name, primary_key), attributes
(entity, pos, name, type), relationships (pos, child, child_attribute, parent,
parent_attribute), records (pos, id, entity, attributes, foreign_keys as maps)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions.text import pascal, xml_tag


def children_of(relationships: DataFrame, name: str) -> DataFrame:
    return relationships.where(F.col("parent") == pascal(F.lit(name))).select("child")


def parents_of(relationships: DataFrame, name: str) -> DataFrame:
    return relationships.where(F.col("child") == pascal(F.lit(name))).select("parent")


def merge_entities(entities: DataFrame, attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that share a name are one, declared where the first is; of attributes that
    share a name within it the first stays. attributes: entity_pos, entity, pos, name, type."""
    first = entities.groupBy("name").agg(F.min_by(F.struct("pos", "primary_key"), "pos").alias("f"))
    kept = attributes.groupBy("entity", "name").agg(F.min_by(F.struct("entity_pos", "pos", "type"), F.struct("entity_pos", "pos")).alias("f"))
    return first.select("f.pos", "name", "f.primary_key"), kept.select("entity", F.col("f.entity_pos").alias("entity_pos"), F.col("f.pos").alias("pos"), "name", F.col("f.type").alias("type"))


def dedupe_attributes(attributes: DataFrame) -> DataFrame:
    """The first attribute of each name of an entity."""
    return attributes.groupBy("entity", "name").agg(F.min_by(F.struct("pos", "type"), "pos").alias("f")).select("entity", "f.pos", "name", "f.type")


def enforce_keys(entities: DataFrame, attributes: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributes with ``added``, relationships): every entity has its primary key (added at
    place -1 if missing) and every child its key column (added last), both of type id; a
    relationship to an attribute that its parent lacks goes to the parent's primary key."""
    keys = entities.select(F.col("name").alias("entity"), F.col("primary_key").alias("name"), F.lit(-1).cast("long").alias("pos"))
    known = entities.select(F.col("name").alias("parent"), "primary_key")
    columns = attributes.select(F.col("entity").alias("parent"), F.col("name").alias("parent_attribute"), F.lit(True).alias("_has")).union(keys.select("entity", "name", F.lit(True))).distinct()
    rels = relationships.join(known, "parent").join(entities.select(F.col("name").alias("child")), "child", "left_semi").join(columns, ["parent", "parent_attribute"], "left")
    rels = rels.withColumn("parent_attribute", F.when(F.col("_has"), F.col("parent_attribute")).otherwise(F.col("primary_key"))).select("pos", "child", "child_attribute", "parent", "parent_attribute")
    bound = rels.groupBy(F.col("child").alias("entity"), F.col("child_attribute").alias("name")).agg((F.min("pos") + 1_000_000).cast("long").alias("pos"))
    wanted = keys.union(bound.select("entity", "name", "pos")).groupBy("entity", "name").agg(F.min("pos").alias("_p"))
    both = attributes.join(wanted, ["entity", "name"], "full")
    added = F.col("pos").isNull()
    return both.select("entity", F.coalesce("pos", "_p").alias("pos"), "name", F.when(F.col("_p").isNotNull(), F.lit("id")).otherwise(F.col("type")).alias("type"), added.alias("added")), rels


def _free(attributes: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Attributes that are neither an entity's primary key nor bound by a relationship."""
    keys = entities.select(F.col("name").alias("entity"), F.col("primary_key").alias("name"))
    bound = relationships.select(F.col("child").alias("entity"), F.col("child_attribute").alias("name"))
    return attributes.join(keys.union(bound).distinct(), ["entity", "name"], "left_anti")


def value_attributes(attributes: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Those whose values are facts: no keys and no other ids."""
    return _free(attributes, entities, relationships).where("type <> 'id'")


def stranded_keys(attributes: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Id columns that no relationship is behind."""
    return _free(attributes, entities, relationships).where("type = 'id'")


def fields_of(attributes: Column, foreign_keys: Column) -> Column:
    """One map of a record's attributes and keys; a key wins over an attribute of its name."""
    rest = F.map_filter(attributes, lambda k, _: ~F.array_contains(F.map_keys(foreign_keys), k))
    return F.map_concat(rest, foreign_keys)


def null_attributes(attributes: Column) -> Column:
    return F.map_keys(F.map_filter(attributes, lambda _, v: v.isNull()))


def recorded_values(records: DataFrame) -> DataFrame:
    """(id, field, value) that a document of the record has to show: its id and every attribute
    with another value; keys are shown by where the record stands."""
    return records.select("id", F.lit("id").alias("field"), F.col("id").alias("value")).union(records.select("id", F.explode("attributes").alias("field", "value")).where("value is not null and value <> id"))


def groups_of(scope: DataFrame, by: list[str]) -> DataFrame:
    """(by, entity, place, n): children of a scope by entity, entities in order of appearance.
    scope: by, pos, entity."""
    each = scope.groupBy(*by, "entity").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return each.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("first")).cast("long")).select(*by, "entity", "place", "n")


def instance_summary(records: DataFrame) -> DataFrame:
    """(entity, n, declared, resolved, nulls): records, keys, keys that name a record, and
    attributes left empty, by entity."""
    keys = records.select("entity", "id", F.explode("foreign_keys").alias("column", "ref"))
    ids = records.select(F.col("id").alias("ref")).distinct().withColumn("_ok", F.lit(True))
    of = keys.join(ids, "ref", "left").groupBy("entity").agg(F.count("*").alias("declared"), F.count("_ok").alias("resolved"))
    n = records.groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.size(null_attributes(F.col("attributes")))).alias("nulls"))
    return n.join(of, "entity", "left").select("entity", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("declared", "resolved", "nulls")])


def instance_json(records: DataFrame, domain: str) -> DataFrame:
    """(entity, json): one JSON text for each entity's records in order."""
    one = F.struct("pos", F.struct("id", F.col("entity").alias("entity_name"), "attributes", "foreign_keys").alias("r"))
    whole = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"])
    return records.groupBy("entity").agg(F.to_json(F.struct(F.lit(domain).alias("schema_domain"), F.count("*").alias("total_records"), whole.alias("records")), {"ignoreNullFields": "false"}).alias("json"))


def find_all(elements: DataFrame, tag: str) -> DataFrame:
    """Elements of a tag, whatever form of it is asked for. elements: tag."""
    return elements.where(F.col("tag") == xml_tag(F.lit(tag)))


def section_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'section' and id is not null and id <> ''").select("id")


def joint_vectors(names: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, vec): the unit vector of a key's name vector beside the unit mean of its values'
    vectors; the name twice for a key without values. names, values: key, vec."""
    n = F.col("_s.n")
    parts = values.select(key, F.posexplode("vec").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12)))
    both = names.join(mean, key, "left").withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    both = both.withColumn("_v", F.concat("vec", F.coalesce(unit(F.col("mean")), F.col("vec"))))
    return both.select(key, unit(F.col("_v")).alias("vec"))
