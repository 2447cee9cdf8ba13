"""What a model's schema says: property sets, relations of classes, names of its root objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propgraph.functions import names
from propgraph.operators import profile, store
from propgraph.operators.graph import PropertyGraph
from propgraph.sources import step

#: The prefix of quantity sets, what no set's key may be, and the properties every entity has.
QUANTITIES = "Qto_"
SKIPPED = (
    "id", "type", "OwnerHistory", "ObjectPlacement", "Representation", "HasAssignments", "Nests", "IsNestedBy", "HasContext", "IsDecomposedBy", "Decomposes", "HasAssociations",
)
CORE = ("GlobalId", "Name", "Description", "ObjectType", "Tag", "LongName", "Phase", "PredefinedType")
#: Relations that a class takes part in at the source, and what each is called at the target.
RELATIONS = {"CONTAINS": "CONTAINED_IN", "DECOMPOSES": "DECOMPOSED_BY", "HAS_OPENING": None, "FILLS": None}


def is_quantity(pset: Column) -> Column:
    return pset.startswith(QUANTITIES)


def property_sets(props: DataFrame) -> DataFrame:
    """(pset, quantity, properties): the sorted canonical names of each set, of rows (pset, key)."""
    rows = props.where(~F.col("key").isin(*SKIPPED)).select("pset", names.canonical(F.col("key")).alias("property")).distinct()
    return rows.groupBy("pset").agg(F.sort_array(F.collect_list("property")).alias("properties")).select("pset", is_quantity(F.col("pset")).alias("quantity"), "properties")


def entity_properties(props: DataFrame) -> DataFrame:
    """(entity, property, quantity), distinct, of rows (entity, pset, key): quantity sets apart, core properties with every entity."""
    own = props.where(~F.col("key").isin(*SKIPPED)).select("entity", names.canonical(F.col("key")).alias("property"), is_quantity(F.col("pset")).alias("quantity"))
    core = props.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, CORE))).alias("property"), F.lit(False).alias("quantity"))
    return own.unionByName(core).distinct()


def scanned(records: DataFrame, products: str = "IfcProduct", types: str = "IfcTypeProduct") -> dict[str, DataFrame]:
    """A model's schema from its STEP records alone, without a graph.

    entities: (entity, n) of products.  properties: (entity, property, quantity) of products, with their types' sets and the
    core ones.  sets: (pset, quantity, properties) of products and types.  all_properties: (property, quantity) of both.
    relations: (entity, relations) of products.  info: (file, label, name) of each file's first project, site and building.
    A class is a product or a type if the table of known classes has it below that root (or, for types, its name ends in Type).
    """
    named = step.nodes(records)
    is_product, is_type = step.is_a(F.col("class"), products), step.is_a(F.col("class"), types) | F.col("class").endswith("Type")
    kinds = named.select(F.col("node_id").alias("element"), F.col("class").alias("entity"), is_product.alias("product"), is_type.alias("typed")).where("product OR typed").distinct()
    rows = store.kept(step.property_rows(records).join(kinds, "element").select("entity", "product", "pset", F.col("name").alias("key")).distinct())  # names, not elements
    own = rows.where("product").select("entity", "pset", "key")
    entities = kinds.where("product").groupBy("entity").agg(F.count("*").alias("n"))
    bare = entities.select("entity", F.lit("").alias("pset"), F.lit(SKIPPED[0]).alias("key"))  # an entity without sets has the core properties
    properties = entity_properties(own.unionAll(bare))
    every = rows.where(~F.col("key").isin(*SKIPPED)).select(names.canonical(F.col("key")).alias("property"), is_quantity(F.col("pset")).alias("quantity"))
    of = lambda end: kinds.where("product").select(F.col("element").alias(end), F.col("entity").alias(f"{end}_entity"))
    inverse = F.create_map(*(F.lit(x) for kind, back in RELATIONS.items() for x in (kind, back or "")))
    ends = step.edges(records).where(F.col("type").isin(*RELATIONS)).join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    both = ends.select(F.inline(F.array(F.struct(F.col("src_entity").alias("entity"), F.col("type").alias("relation")), F.struct(F.col("dst_entity").alias("entity"), inverse[F.col("type")].alias("relation")))))
    info = named.where(F.col("class").isin("IfcProject", "IfcSite", "IfcBuilding")).groupBy("file", F.col("class").alias("label")).agg(F.min_by("Name", "id").alias("name"))
    return {
        "entities": entities,
        "properties": properties,
        "sets": property_sets(rows.select("pset", "key")),
        "all_properties": every.unionAll(records.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CORE))), F.lit(False))).distinct(),
        "relations": both.where("entity IS NOT NULL AND relation <> ''").groupBy("entity").agg(F.sort_array(F.collect_set("relation")).alias("relations")),
        "info": info,
    }


def class_relations(graph: PropertyGraph) -> DataFrame:
    """(leaf, relations): the sorted relations of each leaf label, by their inverse names where it is the target."""
    inverse = F.create_map(*(F.lit(x) for kind, back in RELATIONS.items() for x in (kind, back or "")))
    ends = profile.joined_leaves(graph).where(F.col("type").isin(*RELATIONS))
    rows = ends.select(F.inline(F.array(F.struct(F.col("sl").alias("leaf"), F.col("type").alias("relation")), F.struct(F.col("dl").alias("leaf"), inverse[F.col("type")].alias("relation")))))
    return rows.where("relation <> ''").groupBy("leaf").agg(F.sort_array(F.collect_set("relation")).alias("relations"))


def first_names(graph: PropertyGraph, labels: list[str]) -> DataFrame:
    """(label, name): the Name of the first node, by id, of each label; null where there is no node or it has no name."""
    session = graph.labelled().sparkSession
    rows = session.createDataFrame([(x,) for x in labels], "label string")
    named = [(label, df) for label in labels if (df := graph.nodes(label)) is not None and "Name" in df.columns]
    if not named:
        return rows.withColumn("name", F.lit(None).cast("string"))
    found = reduce(DataFrame.unionAll, (df.select(F.lit(label).alias("label"), "node_id", F.col("Name").cast("string").alias("name")) for label, df in named))
    return rows.join(found.groupBy("label").agg(F.min_by("name", "node_id").alias("name")), "label", "left")


def label_names(graph: PropertyGraph) -> DataFrame:
    """(label), sorted: labels that nodes have."""
    return profile.label_counts(graph).select("label").orderBy("label")


def property_names(graph: PropertyGraph) -> DataFrame:
    """(property), sorted: keys that nodes have."""
    return profile.known_keys(graph).select(F.col("key").alias("property")).distinct().orderBy("property")


def first_choice(enumerations: DataFrame, label_counts: DataFrame) -> DataFrame:
    """(key, label, value): for each key the first value listed on the first label, by name, that has nodes."""
    present = label_counts.where("n > 0").select("label")
    listed = enumerations.where(F.size("choices") > 0).join(present, "label", "left_semi")
    return listed.groupBy("key").agg(F.min_by(F.struct("label", F.element_at("choices", 1).alias("value")), "label").alias("f")).select("key", "f.label", "f.value")
