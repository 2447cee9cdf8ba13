"""Requirement documents (IDS), test sets, run summaries, bundles and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _value(prefix: str) -> T.StructType:
    choice = T.StructType([T.StructField("_value", T.StringType())])
    restriction = T.StructType([T.StructField("xs:enumeration", T.ArrayType(choice))])
    return T.StructType([T.StructField(f"{prefix}simpleValue", T.StringType()), T.StructField("xs:restriction", restriction)])


def _part(prefix: str, type_attribute: str) -> T.StructType:
    entity = T.StructType([T.StructField(f"{prefix}name", _value(prefix))])
    prop = T.StructType(
        [T.StructField(f"_{type_attribute}", T.StringType()), T.StructField("_cardinality", T.StringType())]
        + [T.StructField(f"{prefix}{name}", _value(prefix)) for name in ("propertySet", "baseName", "name", "value")]
    )
    return T.StructType([T.StructField(f"{prefix}entity", T.ArrayType(entity)), T.StructField(f"{prefix}property", T.ArrayType(prop))])


def specifications(spark: SparkSession, path: str, prefix: str = "ids:", type_attribute: str = "dataType") -> DataFrame:
    """(specification, part, entities, properties): a row per specification and part (applicability, requirements).

    The XML reader matches tags as written, so a document's prefix is a parameter ("" for
    none), as is the attribute of a property's type (older documents write datatype).
    """
    schema = T.StructType([T.StructField("_name", T.StringType()), T.StructField(f"{prefix}applicability", _part(prefix, type_attribute)), T.StructField(f"{prefix}requirements", _part(prefix, type_attribute))])
    rows = spark.read.format("xml").option("rowTag", f"{prefix}specification").option("charset", "UTF-8").schema(schema).load(path)
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"`{prefix}{p}`").alias("own")) for p in ("applicability", "requirements")))
    named = rows.select(F.col("_name").alias("specification"), F.inline(parts)).select(
        "specification", "part", F.col(f"own.`{prefix}entity`").alias("entities"), F.col(f"own.`{prefix}property`").alias("properties")
    )
    return named.withColumn("properties", F.transform("properties", lambda p: p.withField("_dataType", p[f"_{type_attribute}"])))


def info(spark: SparkSession, path: str, prefix: str = "ids:") -> DataFrame:
    """(title, version): what a document says of itself, empty where it does not."""
    fields = ("title", "version")
    schema = T.StructType([T.StructField(f"{prefix}{f}", T.StringType()) for f in fields])
    rows = spark.read.format("xml").option("rowTag", f"{prefix}info").option("charset", "UTF-8").schema(schema).load(path)
    return rows.select(*(F.coalesce(F.trim(F.col(f"`{prefix}{f}`")), F.lit("")).alias(f) for f in fields))


def _choices(value: Column) -> Column:
    return F.coalesce(value.getField("xs:restriction").getField("xs:enumeration").getField("_value"), F.array().cast("array<string>"))


def entities(specs: DataFrame, prefix: str = "ids:") -> DataFrame:
    """(specification, part, entity): upper-case names, a single one or each of a list."""
    name = F.explode("entities").alias("e")
    own = specs.select("specification", "part", name).select("specification", "part", F.col(f"e.`{prefix}name`").alias("n"))
    each = F.concat(F.array_compact(F.array(F.col("n").getField(f"{prefix}simpleValue"))), _choices(F.col("n")))
    return own.select("specification", "part", F.explode(each).alias("entity")).select("specification", "part", F.upper(F.trim("entity")).alias("entity"))


def properties(specs: DataFrame, prefix: str = "ids:") -> DataFrame:
    """(specification, part, property, pset, data_type, cardinality, choices); nameless properties are left out, cardinality is optional by default."""
    p = specs.select("specification", "part", F.explode("properties").alias("p"))
    simple = lambda field: F.col("p").getField(f"{prefix}{field}").getField(f"{prefix}simpleValue")
    rows = p.select(
        "specification",
        "part",
        F.coalesce(simple("baseName"), simple("name")).alias("property"),
        simple("propertySet").alias("pset"),
        F.upper("p._dataType").alias("data_type"),
        F.coalesce("p._cardinality", F.lit("optional")).alias("cardinality"),
        F.array_sort(F.array_distinct(F.concat(_choices(F.col("p").getField(f"{prefix}value")), F.array_compact(F.array(simple("value")))))).alias("choices"),
    )
    return rows.where(F.col("property").isNotNull() & (F.trim("property") != ""))


def entity_properties(specs: DataFrame, prefix: str = "ids:") -> DataFrame:
    """(entity, property): what each applicable entity is required to have."""
    who = entities(specs, prefix).where("part = 'applicability'").select("specification", "entity")
    what = properties(specs, prefix).where("part = 'requirements'").select("specification", "property")
    return who.join(what, "specification").select("entity", "property").distinct()


def properties_of(pairs: DataFrame, entity: str) -> DataFrame:
    """The properties of an entity; of one that no specification names, all."""
    own = pairs.where(F.col("entity") == entity.upper())
    return (pairs if own.isEmpty() else own).select("property").distinct()


#: What stands in for a document that names nothing.
COMMON_ENTITIES = (
    "IFCPROJECT", "IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY", "IFCSPACE", "IFCWALL", "IFCWALLSTANDARDCASE", "IFCSLAB", "IFCROOF", "IFCCOLUMN", "IFCBEAM", "IFCMEMBER", "IFCDOOR", "IFCWINDOW",
    "IFCSTAIR", "IFCRAMP", "IFCRAILING", "IFCCURTAINWALL", "IFCPLATE", "IFCFLOWSEGMENT", "IFCFLOWTERMINAL", "IFCFLOWFITTING", "IFCPIPESEGMENT", "IFCDUCTSEGMENT", "IFCOPENINGELEMENT",
    "IFCVOIDINGELEMENT", "IFCFURNISHINGELEMENT", "IFCBUILDINGELEMENTPROXY",
)
COMMON_PROPERTIES = (
    "GlobalId", "Name", "Description", "ObjectType", "FireRating", "IsExternal", "LoadBearing", "Reference", "ThermalTransmittance", "AcousticRating", "NetArea", "GrossArea", "NetVolume",
    "GrossVolume", "Length", "Width", "Height", "Perimeter", "NominalLength", "NominalWidth", "NominalHeight", "Status", "Phase",
)


def or_common(found: DataFrame, column: str, common: tuple[str, ...]) -> DataFrame:
    """The found names, or the common ones if there are none."""
    return found.sparkSession.createDataFrame([(x,) for x in common], f"{column} string") if found.isEmpty() else found.select(column).distinct()


#: Other names of a test case's fields.
ALIASES = {"nl_query": "question", "cypher": "gold_cypher", "expected_cypher": "gold_cypher", "gold_query": "gold_cypher"}
FIELDS = ("question", "gold_cypher", "category", "difficulty")


def test_set(spark: SparkSession, path: str) -> DataFrame:
    """(index, question, gold_cypher, category, difficulty) of a JSON list, a JSON object with cases, or a CSV file.

    Field names count in any case, blanks as underscores; cases without a question are left out.
    """
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        rows = spark.read.option("multiLine", True).json(path)
        if rows.columns == ["cases"]:
            rows = rows.select(F.inline("cases"))
    found: dict[str, list[str]] = {}
    for c in rows.columns:
        name = c.strip().lower().replace(" ", "_")
        found.setdefault(ALIASES.get(name, name), []).append(c)
    if "question" not in found:
        raise ValueError(f"no question in {path}: {rows.columns}")
    empty = F.lit(None).cast("string")
    cols = [F.coalesce(*(F.col(f"`{c}`").cast("string") for c in found.get(f, [])), empty).alias(f) for f in FIELDS]
    kept = rows.select(*cols).where(F.coalesce(F.trim("question"), F.lit("")) != "")
    # a test set is some dozens of rows in one file, numbered in the order of the file
    return kept.withColumn("_at", F.monotonically_increasing_id()).selectExpr("cast(row_number() OVER (ORDER BY _at) - 1 AS int) AS index", *FIELDS)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(model, setting, metrics) of summary files; files without these are left out."""
    schema = "config struct<model:string,setting:string>, metrics map<string,double>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    return rows.select("config.model", "config.setting", "metrics").where("model IS NOT NULL AND setting IS NOT NULL AND metrics IS NOT NULL")


def dump(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a model dump, a JSON list of flat objects."""
    return spark.read.option("multiLine", True).json(path)


def within_budget(rows: DataFrame, order: list[str], text: str, budget: int) -> DataFrame:
    """The first rows, in order, whose texts' tokens (a quarter of the characters each) together stay within a budget.

    Rows of null or empty text take nothing from it and are left out.  Every other takes a token at least, so the
    first budget + 1 hold all that can fit: only those meet in the running sum's one task.
    """
    first = rows.where(F.length(text) > 0).orderBy(*order).limit(budget + 1)
    so_far = F.sum(F.ceil(F.length(text) / 4)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("_sum", so_far).where(F.col("_sum") <= budget).drop("_sum")
