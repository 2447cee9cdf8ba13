"""Building models in STEP files.

A file is split between tasks at any byte (see step_scan), and references are joined by (file, id), so
many models load as one job.
"""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propgraph.functions import values
from propgraph.sources import step_scan
from propgraph.sources.shipping import ship

_TEXT = r"'(?:[^']|'')*'"
#: Class, parent of the classes that the loader knows by name.
SUPERTYPES = [
    ("IfcRoot", None), ("IfcObjectDefinition", "IfcRoot"), ("IfcObject", "IfcObjectDefinition"), ("IfcProduct", "IfcObject"), ("IfcElement", "IfcProduct"),
    ("IfcBuildingElement", "IfcElement"), ("IfcWall", "IfcBuildingElement"), ("IfcWallStandardCase", "IfcWall"), ("IfcDoor", "IfcBuildingElement"), ("IfcWindow", "IfcBuildingElement"),
    ("IfcSlab", "IfcBuildingElement"), ("IfcColumn", "IfcBuildingElement"), ("IfcBeam", "IfcBuildingElement"), ("IfcRoof", "IfcBuildingElement"), ("IfcStair", "IfcBuildingElement"),
    ("IfcStairFlight", "IfcBuildingElement"), ("IfcRamp", "IfcBuildingElement"), ("IfcRailing", "IfcBuildingElement"), ("IfcCurtainWall", "IfcBuildingElement"), ("IfcPlate", "IfcBuildingElement"),
    ("IfcMember", "IfcBuildingElement"), ("IfcCovering", "IfcBuildingElement"), ("IfcBuildingElementProxy", "IfcBuildingElement"), ("IfcFeatureElement", "IfcElement"),
    ("IfcFeatureElementSubtraction", "IfcFeatureElement"), ("IfcOpeningElement", "IfcFeatureElementSubtraction"), ("IfcFurnishingElement", "IfcElement"), ("IfcDistributionElement", "IfcElement"),
    ("IfcSpatialElement", "IfcProduct"), ("IfcSpatialStructureElement", "IfcSpatialElement"), ("IfcSite", "IfcSpatialStructureElement"), ("IfcBuilding", "IfcSpatialStructureElement"),
    ("IfcBuildingStorey", "IfcSpatialStructureElement"), ("IfcSpace", "IfcSpatialStructureElement"), ("IfcContext", "IfcObjectDefinition"), ("IfcProject", "IfcContext"),
    ("IfcTypeObject", "IfcObjectDefinition"), ("IfcTypeProduct", "IfcTypeObject"), ("IfcElementType", "IfcTypeProduct"), ("IfcBuildingElementType", "IfcElementType"),
    ("IfcWallType", "IfcBuildingElementType"), ("IfcDoorType", "IfcBuildingElementType"), ("IfcWindowType", "IfcBuildingElementType"),
]

#: Relation class, subtypes too -> (edge type, place of the source argument, place of the target argument).
RELATIONS = {
    "IFCRELCONTAINEDINSPATIALSTRUCTURE": ("CONTAINS", 5, 4),
    "IFCRELAGGREGATES": ("DECOMPOSES", 4, 5),
    "IFCRELVOIDSELEMENT": ("HAS_OPENING", 4, 5),
    "IFCRELFILLSELEMENT": ("FILLS", 5, 4),
    "IFCRELSPACEBOUNDARY": ("BOUNDED_BY", 4, 5),
    "IFCRELSPACEBOUNDARY1STLEVEL": ("BOUNDED_BY", 4, 5),
    "IFCRELSPACEBOUNDARY2NDLEVEL": ("BOUNDED_BY", 4, 5),
    "IFCRELCONNECTSELEMENTS": ("CONNECTED_TO", 5, 6),
    "IFCRELCONNECTSPATHELEMENTS": ("CONNECTED_TO", 5, 6),
    "IFCRELCONNECTSWITHREALIZINGELEMENTS": ("CONNECTED_TO", 5, 6),
    "IFCRELDEFINESBYTYPE": ("IS_OF_TYPE", 4, 5),
}


def statements(spark: SparkSession, path: str, split_bytes: int = step_scan.SPLIT) -> DataFrame:
    """(file, at, id, class, args, raw) of every statement of a file or folder, by the byte at which it begins.

    Records have an id, class and arguments; header entries and section marks a class, no id.  What is neither
    (brackets that do not match, a record of several classes, a last statement without its end) has its text in raw.
    Any bytes may be between records, in texts and in comments; split_bytes does not change the rows.  It is the least
    that a split has: where that would be more tasks than the cores need, splits have more (step_scan.split_size).
    A missing path fails when it is read.
    """
    ship(spark)
    spark.dataSource.register(step_scan.StepSource)
    sizes = [size for _, size in step_scan.files(path)]
    own = step_scan.split_size(sum(sizes) + step_scan.OPEN * len(sizes), split_bytes, spark.sparkContext.defaultParallelism)
    read = lambda: spark.read.format("step").option("path", path).option("splitBytes", own)
    if all(size <= own for size in sizes):
        return read().load()
    passed = read().option("pass", "states").load().select("file", "start", "state", "ended", "some").collect()  # a row a split
    begins = Path(tempfile.mkdtemp(prefix="propgraph-")) / "begins.json"
    begins.write_text(json.dumps(step_scan.begins([tuple(r) for r in passed])))
    return read().option("begins", str(begins)).load()


def records(spark: SparkSession, path: str, split_bytes: int = step_scan.SPLIT) -> DataFrame:
    """(file, id, class, args: array<string>) of every record.  What else a file holds is counted by unread()."""
    return statements(spark, path, split_bytes).where("id IS NOT NULL").select("file", "id", "class", "args")


def unread(spark: SparkSession, path: str, split_bytes: int = step_scan.SPLIT) -> DataFrame:
    """(file, n): per file the statements that are no record, header entry or section mark, so that records() leaves them out."""
    return statements(spark, path, split_bytes).where("raw IS NOT NULL").groupBy("file").agg(F.count("*").alias("n"))


def schema_names(spark: SparkSession, path: str) -> DataFrame:
    """(file, schema): the schema that a file's header names, such as IFC4."""
    heads = statements(spark, path).where("id IS NULL AND class = 'FILE_SCHEMA'")
    return heads.select("file", F.regexp_extract(F.get("args", F.lit(0)), "'([^']*)'", 1).alias("schema"))


def text_of(arg: Column) -> Column:
    """The text of an argument such as 'a' or IFCLABEL('a'); null for $ and *."""
    inner = F.regexp_extract(arg, rf"^(?:[A-Za-z0-9_]+\()?({_TEXT})\)?$", 1)
    return F.when(inner != "", F.replace(F.substring(inner, F.lit(2), F.length(inner) - 2), F.lit("''"), F.lit("'")))


def references(arg: Column) -> Column:
    """The ids that an argument refers to, one or a list."""
    return F.regexp_extract_all(arg, F.lit("#([0-9]+)"), F.lit(1)).cast("array<bigint>")


def plain_value(arg: Column) -> Column:
    """A property's value as text: booleans as true and false, numbers as they stand, texts without quotes; null for $."""
    inner = F.coalesce(F.nullif(F.regexp_extract(arg, r"^[A-Za-z0-9_]+\((.*)\)$", 1), F.lit("")), arg)
    return F.when(arg.isin("$", "*"), None).when(inner == ".T.", "true").when(inner == ".F.", "false").otherwise(F.coalesce(text_of(inner), inner))


def supertypes(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{c}', {repr(p) if p else 'NULL'})" for c, p in SUPERTYPES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(class, parent)")


def _named(recs: DataFrame) -> Column:
    """The proper class name of known classes, else Ifc and a capital."""
    known = F.create_map(*(F.lit(x) for c, _ in SUPERTYPES for x in (c.upper(), c)))
    return F.coalesce(known[F.col("class")], F.concat(F.lit("Ifc"), F.initcap(F.lower(F.substring("class", 4, 200)))))


def nodes(recs: DataFrame) -> DataFrame:
    """(file, id, class, node_id, Name, Description, ObjectType) of rooted records that are no relations: their first argument is a 22-character id."""
    rooted = recs.where(text_of(F.get("args", F.lit(0))).rlike("^[0-9A-Za-z_$]{22}$") & ~F.col("class").startswith("IFCREL") & ~F.col("class").isin("IFCPROPERTYSET", "IFCELEMENTQUANTITY"))
    return rooted.select("file", "id", _named(recs).alias("class"), *(text_of(F.get("args", F.lit(k))).alias(name) for k, name in ((0, "node_id"), (2, "Name"), (3, "Description"), (4, "ObjectType"))))


def submitted(recs: DataFrame) -> DataFrame:
    """(type, src, dst) of all relations' pairs of records, by node_id; an end that is no node is null."""
    known = F.create_map(*(F.lit(x) for c, (kind, _, _) in RELATIONS.items() for x in (c, kind)))
    at = [F.create_map(*(F.lit(x) for c, r in RELATIONS.items() for x in (c, r[k]))) for k in (1, 2)]
    pairs = recs.where(F.col("class").isin(*RELATIONS)).select(
        "file", known[F.col("class")].alias("type"), references(F.get("args", at[0][F.col("class")])).alias("a"), F.explode(references(F.get("args", at[1][F.col("class")]))).alias("dst_ref")
    ).select("file", "type", F.explode("a").alias("src_ref"), "dst_ref")
    ids = nodes(recs).select("file", "id", "node_id")
    one = pairs.join(ids.select("file", F.col("id").alias("src_ref"), F.col("node_id").alias("src")), ["file", "src_ref"], "left")
    return one.join(ids.select("file", F.col("id").alias("dst_ref"), F.col("node_id").alias("dst")), ["file", "dst_ref"], "left").select("type", "src", "dst")


def edges(recs: DataFrame) -> DataFrame:
    """(type, src, dst) of all relations between nodes; pairs with an end that is no node vanish."""
    return submitted(recs).where("src IS NOT NULL AND dst IS NOT NULL")


def is_a(name: Column, root: str) -> Column:
    """Whether a class, by its proper name, is a root class or below it in the table of known classes."""
    below, grew = {root}, True
    while grew:
        more = {c for c, parent in SUPERTYPES if parent in below} - below
        below, grew = below | more, bool(more)
    return name.isin(*sorted(below))


def items_of(arg: Column) -> Column:
    """The values of a bracketed list such as (IFCLABEL('a'),IFCREAL(2.)): array<struct<json, text>>, as values.coerced_list takes them."""
    each = F.regexp_extract_all(F.regexp_extract(arg, r"(?s)^\((.*)\)$", 1), F.lit(rf"(?:[A-Za-z0-9_]+\((?:{_TEXT}|[^()']*)\)|{_TEXT}|[^,()']+)"), F.lit(0))
    return F.transform(each, lambda x: values.item(json_value(F.trim(x))))


def json_value(arg: Column) -> Column:
    """A property's value as JSON: booleans, numbers (those with a point as decimals), other values as text; null for $ and *."""
    whole, inside = F.coalesce(arg, F.lit("$")), r"(?s)^[A-Za-z0-9_]+\((.*)\)$"

    def shown(inner: Column) -> Column:
        number = F.when(inner.rlike(r"^[+-]?[0-9]{1,18}$"), inner.cast("long").cast("string")).when(inner.rlike(r"^[+-]?[0-9]+\.[0-9]*([eE][+-]?[0-9]+)?$"), inner.cast("double").cast("string"))
        return F.when(inner.isin("$", "*"), None).when(inner == ".T.", "true").when(inner == ".F.", "false").otherwise(F.coalesce(number, values.json_text(F.coalesce(text_of(inner), inner))))

    return values.once(F.coalesce(F.nullif(F.regexp_extract(whole, inside, 1), F.lit("")), whole), shown)


def _property_values(recs: DataFrame) -> DataFrame:
    """(file, prop, name, value, json) of single, listed and enumerated values and of quantities.  A list's value is its JSON."""
    at = F.when(F.col("class").startswith("IFCQUANTITY"), F.get("args", F.lit(3))).otherwise(F.get("args", F.lit(2)))
    several = F.col("class").isin("IFCPROPERTYLISTVALUE", "IFCPROPERTYENUMERATEDVALUE")
    listed = values.coerced_list(items_of(at))
    rows = recs.where((F.col("class") == "IFCPROPERTYSINGLEVALUE") | several | F.col("class").startswith("IFCQUANTITY"))
    amount = F.when(F.col("class").startswith("IFCQUANTITY"), at.try_cast("double").cast("string"))
    return rows.select(
        "file", F.col("id").alias("prop"), text_of(F.get("args", F.lit(0))).alias("name"), F.when(several, listed).otherwise(plain_value(at)).alias("value"), F.when(several, listed).otherwise(F.coalesce(amount, json_value(at))).alias("json")
    )


def _sets(recs: DataFrame) -> DataFrame:
    """(file, set_id, pset, k, prop): the property and quantity sets with their properties in order."""
    sets = recs.where(F.col("class").isin("IFCPROPERTYSET", "IFCELEMENTQUANTITY"))
    return sets.select("file", F.col("id").alias("set_id"), text_of(F.get("args", F.lit(2))).alias("pset"), F.posexplode(references(F.element_at("args", -1))).alias("k", "prop"))


def _given(recs: DataFrame) -> DataFrame:
    """(file, id, rel, set_id, own): the sets of each record: its own (1), and for types and what they type the type's (0)."""
    own = recs.where(F.col("class") == "IFCRELDEFINESBYPROPERTIES").select("file", F.explode(references(F.get("args", F.lit(4)))).alias("id"), F.col("id").alias("rel"), F.get(references(F.get("args", F.lit(5))), F.lit(0)).alias("set_id"))
    types = recs.where(is_a(_named(recs), "IfcTypeObject") | F.col("class").rlike("^IFC[A-Z]+(TYPE|STYLE)$")).select("file", "id", F.posexplode(references(F.get("args", F.lit(5)))).alias("rel", "set_id"))
    typed = recs.where(F.col("class") == "IFCRELDEFINESBYTYPE").select("file", F.explode(references(F.get("args", F.lit(4)))).alias("typed"), F.get(references(F.get("args", F.lit(5))), F.lit(0)).alias("id"))
    inherited = types.join(typed, ["file", "id"]).select("file", F.col("typed").alias("id"), F.col("rel").cast("long"), "set_id")
    return own.withColumn("own", F.lit(1)).unionByName(types.withColumn("rel", F.col("rel").cast("long")).unionByName(inherited).withColumn("own", F.lit(0)))


def property_rows(recs: DataFrame, inherit: bool = True, wanted: DataFrame | None = None) -> DataFrame:
    """(element, pset, name, value, json, position) of property sets and quantities, for etl.flatten_properties.

    An element has its type's sets, too (inherit: false leaves types out): a property that both have is at the type's place and has the element's own value.
    Of a name that is in a set twice the last value counts.  wanted: (node_id) of the elements that are asked for, else all.
    """
    ids = nodes(recs).select("file", "id", F.col("node_id").alias("element"))
    if wanted is not None:
        ids = ids.join(wanted, F.col("element") == F.col("node_id"), "left_semi")
    given = _given(recs) if inherit else _given(recs).where("own = 1")
    rows = given.join(ids, ["file", "id"]).join(_sets(recs), ["file", "set_id"]).join(_property_values(recs), ["file", "prop"])
    at = F.struct("own", "rel", "set_id", "k")
    one = rows.groupBy("element", "pset", "name").agg(F.max_by(F.struct("value", "json"), at).alias("v"), F.min(at).alias("at"))
    first = F.min(F.struct("at.own", "at.rel", "at.set_id")).over(Window.partitionBy("element", "pset"))
    return one.select("element", "pset", "name", "v.value", "v.json", F.struct(first.alias("set"), F.col("at")).alias("position"))


def material_rows(recs: DataFrame) -> DataFrame:
    """(element, material): an association's material by its own name, or that of the first one in its layers or list."""
    named = recs.where(F.col("class") == "IFCMATERIAL").select("file", F.col("id").alias("m"), text_of(F.get("args", F.lit(0))).alias("material"))
    first = recs.where(F.col("class").isin("IFCMATERIALLAYERSETUSAGE", "IFCMATERIALLAYERSET", "IFCMATERIALLAYER", "IFCMATERIALLIST", "IFCMATERIALCONSTITUENTSET", "IFCMATERIALCONSTITUENT")).select(
        "file", F.col("id").alias("m"), F.get(F.flatten(F.transform("args", references)), F.lit(0)).alias("to")
    )
    uses = recs.where(F.col("class") == "IFCRELASSOCIATESMATERIAL").select("file", F.explode(references(F.get("args", F.lit(4)))).alias("id"), F.get(references(F.get("args", F.lit(5))), F.lit(0)).alias("m"))
    found = named
    step = first
    for _ in range(3):  # usage -> set -> layer -> material
        found = found.unionAll(step.join(named.select("file", F.col("m").alias("to"), "material"), ["file", "to"]).select("file", "m", "material"))
        step = step.select("file", F.col("m").alias("at"), F.col("to").alias("m")).join(first, ["file", "m"]).select("file", F.col("at").alias("m"), "to")
    return uses.join(found, ["file", "m"]).join(nodes(recs).select("file", "id", F.col("node_id").alias("element")), ["file", "id"]).select("element", "material")
