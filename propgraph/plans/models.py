"""STEP models written from the tables, then read, loaded, profiled and exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.functions import values
from propgraph.operators import etl, schema, sinks, store
from propgraph.sources import documents, step

#: Customers of one file: references hold within a file, so the nations that its customers need are in each.
BLOCK = 1000


def _gid(kind: str, number: Column) -> Column:
    return F.concat(F.lit(kind), F.lpad(number.cast("string"), 22 - len(kind), "0"))


def _text(col: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(col, F.lit("'"), F.lit("''")), F.lit("'"))


def _ref(number: Column) -> Column:
    return F.concat(F.lit("#"), number.cast("string"))


def _record(number: Column, name: str, *args: Column | str) -> Column:
    parts = [F.lit(a) if isinstance(a, str) else a for a in args]
    return F.concat(_ref(number), F.lit(f"={name}("), F.concat_ws(",", *parts), F.lit(");"))


def _written(spark: SparkSession, sf: str) -> str:
    """A folder of STEP files: nations as storeys, customers as walls or doors in them, with a type, two sets and a material each.

    Records are dealt over lines two by two, with a line break in the middle of some and `;` and quotes in texts.
    """
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("file", F.floor(F.col("c_custkey") / BLOCK))
    nation = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name")
    key, at = F.col("c_custkey"), 1000 + 20 * F.col("c_custkey")
    storey = 1 + F.col("c_nationkey")
    segment = 100 + F.pmod(F.crc32("c_mktsegment"), F.lit(800))
    wall = key % 3 != 0
    name = F.concat(F.col("c_name"), F.when(key % 2 == 0, "; it's (one)").otherwise(F.lit("")))
    place = ["$", "$", "$"]
    own = F.array(
        F.when(wall, _record(at, "IFCWALL", _text(_gid("C", key)), "$", _text(name), "$", _text(F.col("c_mktsegment")), "$", "$", "$")).otherwise(_record(at, "IFCDOOR", _text(_gid("C", key)), "$", _text(name), "$", "$", "$", "$", "$")),
        _record(at + 1, "IFCRELCONTAINEDINSPATIALSTRUCTURE", _text(_gid("RC", key)), *place, F.concat(F.lit("("), _ref(at), F.lit(")")), _ref(storey)),
        _record(at + 2, "IFCPROPERTYSINGLEVALUE", "'Market Segment'", "$", F.concat(F.lit("IFCLABEL("), _text(F.col("c_mktsegment")), F.lit(")")), "$"),
        _record(at + 3, "IFCPROPERTYSINGLEVALUE", "'In Debt'", "$", F.when(F.col("c_acctbal") < 0, "IFCBOOLEAN(.T.)").when(F.col("c_acctbal") < 100, "$").otherwise(F.lit("IFCBOOLEAN(.F.)")), "$"),
        _record(at + 4, "IFCPROPERTYLISTVALUE", "'Keys'", "$", F.concat(F.lit("(IFCINTEGER("), key.cast("string"), F.lit("),"), F.when(key % 4 == 0, "IFCLABEL('x,y')").otherwise(F.lit("IFCINTEGER(7)")), F.lit(")")), "$"),
        _record(at + 5, "IFCPROPERTYSET", _text(_gid("PC", key)), "$", "'Pset_Customer'", "$", F.concat(F.lit("("), F.concat_ws(",", _ref(at + 2), _ref(at + 3), _ref(at + 4)), F.lit(")"))),
        _record(at + 6, "IFCRELDEFINESBYPROPERTIES", _text(_gid("RP", key)), *place, F.concat(F.lit("("), _ref(at), F.lit(")")), _ref(at + 5)),
        _record(at + 7, "IFCRELASSOCIATESMATERIAL", _text(_gid("RM", key)), *place, F.concat(F.lit("("), _ref(at), F.lit(")")), _ref(segment)),
        F.when(wall, _record(at + 8, "IFCRELDEFINESBYTYPE", _text(_gid("RT", key)), *place, F.concat(F.lit("("), _ref(at), F.lit(")")), F.lit("#50"))),
    )

    def two_by_two(lines: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 2).cast("int")), lambda k: F.concat(F.get(lines, 2 * k), F.when(key % 5 == 0, " ").otherwise(F.lit("\n")), F.coalesce(F.get(lines, 2 * k + 1), F.lit(""))))

    pairs = values.once(F.array_compact(own), two_by_two)
    rows = c.select("file", F.lit(2).alias("place"), F.explode(pairs).alias("value"))
    blocks = c.groupBy("file").agg(F.collect_set("c_mktsegment").alias("segments"))
    storeys = c.select("file", F.col("c_nationkey").alias("n_nationkey")).distinct().join(nation, "n_nationkey").select("file", F.lit(1).alias("place"), _record(1 + F.col("n_nationkey"), "IFCBUILDINGSTOREY", _text(_gid("N", F.col("n_nationkey"))), "$", _text(F.col("n_name")), "$", "$", "$", "$", "$", ".ELEMENT.", "0.").alias("value"))
    materials = blocks.select("file", F.explode("segments").alias("s")).select("file", F.lit(1).alias("place"), _record(100 + F.pmod(F.crc32("s"), F.lit(800)), "IFCMATERIAL", _text(F.col("s"))).alias("value"))
    typed = [
        "ISO-10303-21;\nHEADER;\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA; /* a type; with two properties */", "#51=IFCPROPERTYSINGLEVALUE('Market Segment',$,IFCLABEL('none'),$);#52=IFCQUANTITYLENGTH('Width',\n$,$,0.25,$);",
        "#53=IFCPROPERTYSET('00000000000000000PTYPE',$,'Pset_Customer',$,(#51));", "#54=IFCELEMENTQUANTITY('00000000000000000QTYPE',$,'Qto_Wall',$,$,(#52));", "#50=IFCWALLTYPE('000000000000000000TYPE',$,'Standard',$,$,(#53,#54),$,$,$,.STANDARD.);",
    ]
    heads = blocks.select("file", F.lit(0).alias("place"), F.lit("\n".join(typed)).alias("value")).unionAll(blocks.select("file", F.lit(3), F.lit("ENDSEC;\nEND-ISO-10303-21;")))
    path = store.scratch(spark)
    every = heads.unionAll(storeys).unionAll(materials).unionAll(rows)
    every.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)
    return path


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """The records of the written files, kept as a table as several joins read them."""
    return store.kept(step.records(spark, _written(spark, sf), split_bytes=1 << 18))


def step_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Statements of the written files by class; none is unread."""
    found = step.statements(spark, _written(spark, sf), split_bytes=1 << 16)
    return found.groupBy("class").agg(F.count("*").alias("n"), F.count("id").alias("records"), F.count("raw").alias("unread"))


def step_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Rooted records that are no relations, each once however many files repeat it."""
    return step.nodes(_records(spark, sf)).select("class", "node_id", "Name", "ObjectType").distinct()


def step_edges(spark: SparkSession, sf: str) -> DataFrame:
    return step.edges(_records(spark, sf)).groupBy("type", "src").agg(F.count("*").alias("n"), F.min("dst").alias("least"))


def step_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical properties of elements: a wall has its type's width, and its own segment in place of the type's."""
    return etl.flatten_properties(step.property_rows(_records(spark, sf)).drop("json")).distinct()


def step_materials(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = etl.materials(step.material_rows(_records(spark, sf)))
    return edges.join(nodes, F.col("dst") == F.col("material_id")).groupBy("Name").agg(F.count("*").alias("n"))


def model_schema(spark: SparkSession, sf: str) -> DataFrame:
    """A model's schema from its records: products, their properties, sets and relations, and what types have besides."""
    found = schema.scanned(_records(spark, sf))
    quantity = F.when(F.col("quantity"), "quantity").otherwise(F.lit("property"))
    nothing = F.lit(None).cast("long")
    return (
        found["entities"].select(F.lit("entity").alias("kind"), F.col("entity").alias("of"), F.lit("").alias("name"), "n")
        .unionAll(found["properties"].select(quantity, "entity", "property", nothing))
        .unionAll(found["sets"].select(F.lit("set"), "pset", F.array_join("properties", ","), nothing))
        .unionAll(found["all_properties"].select(F.concat(F.lit("any "), quantity), F.lit(""), "property", nothing))
        .unionAll(found["relations"].select(F.lit("relations"), "entity", F.array_join("relations", ","), nothing))
    )


def product_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Walls and doors as JSON objects in one array, written and read again; storeys repeat in every file, so they are left out."""
    made = etl.products(_records(spark, sf)).where("type <> 'IfcBuildingStorey'")
    path = store.scratch(spark)
    sinks.write_array(made, ["file", "id"], path)
    return sinks.read_array(spark, path)


def product_dump_limit(spark: SparkSession, sf: str) -> DataFrame:
    """At most three products of each file and type, counted."""
    return etl.products(_records(spark, sf), limit=3).groupBy("type").agg(F.count("*").alias("n"))


def dump_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A dump of the nations' storeys, an array in one file, read as rows."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    made = etl.objects(n.select(F.col("n_nationkey").alias("element"), F.col("n_name").alias("Name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("Region")), n.select(F.col("n_nationkey").alias("element"), F.lit(1).alias("position"), F.lit("Long name").alias("name"), F.lit('"x"').alias("json")))
    path = store.scratch(spark)
    sinks.write_array(made, ["element"], path, files=1)
    return documents.dump(spark, path).select("Name", "Region", "Long_name")


QUERIES = {f.__name__: f for f in (step_statements, step_nodes, step_edges, step_properties, step_materials, model_schema, product_dump, product_dump_limit, dump_rows)}

_CUST = f"(SELECT *, c_custkey // {BLOCK} AS file, 'C' || lpad(c_custkey::VARCHAR, 21, '0') AS id, c_custkey % 3 <> 0 AS wall, CASE WHEN c_custkey % 3 <> 0 THEN 'IfcWall' ELSE 'IfcDoor' END AS class, c_name || CASE WHEN c_custkey % 2 = 0 THEN '; it''s (one)' ELSE '' END AS shown FROM customer)"
_NATION = "'N' || lpad({0}::VARCHAR, 21, '0')"
_KEYS = "CASE WHEN c_custkey % 4 = 0 THEN '[\"' || c_custkey || '\", \"x,y\"]' ELSE '[' || c_custkey || ', 7]' END"
_CORE = "unnest(['GlobalId', 'Name', 'Description', 'ObjectType', 'Tag', 'LongName', 'Phase', 'PredefinedType'])"

ORACLES = {
    "step_statements": f"""WITH c AS {_CUST}, b AS (SELECT DISTINCT file FROM c), s AS (
        SELECT CASE WHEN wall THEN 'IFCWALL' ELSE 'IFCDOOR' END AS class, 1 AS n FROM c UNION ALL SELECT unnest(['IFCRELCONTAINEDINSPATIALSTRUCTURE', 'IFCPROPERTYSINGLEVALUE', 'IFCPROPERTYSINGLEVALUE', 'IFCPROPERTYLISTVALUE', 'IFCPROPERTYSET', 'IFCRELDEFINESBYPROPERTIES', 'IFCRELASSOCIATESMATERIAL']), 1 FROM c
        UNION ALL SELECT 'IFCRELDEFINESBYTYPE', 1 FROM c WHERE wall UNION ALL SELECT 'IFCBUILDINGSTOREY', 1 FROM (SELECT DISTINCT file, c_nationkey FROM c) UNION ALL SELECT 'IFCMATERIAL', 1 FROM (SELECT DISTINCT file, c_mktsegment FROM c)
        UNION ALL SELECT unnest(['IFCPROPERTYSINGLEVALUE', 'IFCQUANTITYLENGTH', 'IFCPROPERTYSET', 'IFCELEMENTQUANTITY', 'IFCWALLTYPE']), 1 FROM b UNION ALL SELECT unnest(['ISO-10303-21', 'HEADER', 'FILE_SCHEMA', 'ENDSEC', 'DATA', 'ENDSEC', 'END-ISO-10303-21']), 0 FROM b)
        SELECT class, count(*) AS n, sum(n)::BIGINT AS records, 0::BIGINT AS unread FROM s GROUP BY 1""",
    "step_nodes": f"""SELECT class, id AS node_id, shown AS "Name", CASE WHEN wall THEN c_mktsegment END AS "ObjectType" FROM {_CUST}
        UNION ALL SELECT 'IfcBuildingStorey', {_NATION.format("n_nationkey")}, n_name, NULL FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'IfcWallType', '000000000000000000TYPE', 'Standard', NULL""",
    "step_edges": f"""SELECT 'CONTAINS' AS type, {_NATION.format("c_nationkey")} AS src, count(*) AS n, min(id) AS least FROM {_CUST} GROUP BY 2
        UNION ALL SELECT 'IS_OF_TYPE', id, 1, '000000000000000000TYPE' FROM {_CUST} WHERE wall""",
    "step_properties": f"""SELECT id AS element, 'Market_Segment' AS key, c_mktsegment AS value FROM {_CUST} UNION ALL SELECT id, 'In_Debt', (c_acctbal < 0)::VARCHAR FROM {_CUST} WHERE c_acctbal < 0 OR c_acctbal >= 100
        UNION ALL SELECT id, 'Keys', {_KEYS} FROM {_CUST} UNION ALL SELECT id, 'Width', '0.25' FROM {_CUST} WHERE wall
        UNION ALL SELECT '000000000000000000TYPE', unnest(['Market_Segment', 'Width']), unnest(['none', '0.25'])""",
    "step_materials": 'SELECT c_mktsegment AS "Name", count(*) AS n FROM customer GROUP BY 1',
    "model_schema": f"""WITH c AS {_CUST}, e AS (SELECT class, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'IfcBuildingStorey', count(DISTINCT c_nationkey) FROM customer)
        SELECT 'entity' AS kind, class AS of, '' AS name, n FROM e UNION ALL SELECT 'property', class, {_CORE}, NULL FROM e
        UNION ALL SELECT DISTINCT 'property', class, unnest(['Market_Segment', 'In_Debt', 'Keys']), NULL FROM c UNION ALL SELECT DISTINCT 'quantity', class, 'Width', NULL FROM c WHERE wall
        UNION ALL SELECT 'set', unnest(['Pset_Customer', 'Qto_Wall']), unnest(['In_Debt,Keys,Market_Segment', 'Width']), NULL
        UNION ALL SELECT 'any property', '', {_CORE}, NULL UNION ALL SELECT 'any property', '', unnest(['Market_Segment', 'In_Debt', 'Keys']), NULL UNION ALL SELECT 'any quantity', '', 'Width', NULL
        UNION ALL SELECT DISTINCT 'relations', class, 'CONTAINED_IN', NULL FROM c UNION ALL SELECT 'relations', 'IfcBuildingStorey', 'CONTAINS', NULL""",
    "product_dump": f"""SELECT '{{"GlobalId": "' || id || '", "type": "' || class || '", "Name": "' || shown || '"' || CASE WHEN wall THEN ', "ObjectType": "' || c_mktsegment || '"' ELSE '' END
        || CASE WHEN c_acctbal < 0 OR c_acctbal >= 100 THEN ', "In_Debt": ' || (c_acctbal < 0)::VARCHAR ELSE '' END || ', "Keys": ' || {_KEYS} || ', "Market_Segment": "' || c_mktsegment || '"}}' AS json FROM {_CUST}""",
    "product_dump_limit": f"""SELECT class AS type, sum(least(n, 3))::BIGINT AS n FROM (SELECT file, class, count(*) AS n FROM {_CUST} GROUP BY 1, 2 UNION ALL SELECT file, 'IfcBuildingStorey', count(DISTINCT c_nationkey) FROM {_CUST} GROUP BY 1) GROUP BY 1""",
    "dump_rows": """SELECT n_name AS "Name", CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END::BIGINT AS "Region", 'x' AS "Long_name" FROM nation""",
}
