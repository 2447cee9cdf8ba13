"""From STEP files to a stored graph in one call, with statistics counted while it is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propgraph.operators import etl, store
from propgraph.operators.closure import derived_containment
from propgraph.operators.graph import EdgePart, EdgeTable, NodeTable, PropertyGraph
from propgraph.sources import step

ROOT, MATERIAL = "IfcRoot", "Material"
#: Attributes of a node that are columns whatever its property sets hold.
BASE = ("Name", "Description", "ObjectType")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Loaded:
    """graph: the stored graph, read again.  statistics: (type, submitted, created) of edges; unread: statements that are no record."""

    graph: PropertyGraph
    statistics: DataFrame
    unread: int


def observed(pairs: DataFrame, nodes: DataFrame, kinds: list[str]) -> tuple[DataFrame, Observation, Observation]:
    """The pairs (type, src, dst, ...) both of whose ends are nodes, and per type how many were asked for and are there.

    Counts are taken by the pass that uses the pairs: there is no grouping and no second look at either side.
    """
    asked, made = Observation("asked"), Observation("made")
    each = lambda: [F.count_if(F.col("type") == k).alias(k) for k in kinds]
    created = etl.created_edges(pairs.observe(asked, *each()), nodes)
    return created.observe(made, *each()), asked, made


def statistics(spark: SparkSession, asked: Observation, made: Observation) -> DataFrame:
    """(type, submitted, created) of types with any pair, of what was observed (types are a handful)."""
    there = store.told(made)
    rows = [(k, n, there.get(k, 0)) for k, n in store.told(asked).items() if n]
    return spark.createDataFrame(rows, "type string, submitted long, created long")


def typed(value: Column, kind: T.DataType) -> Column:
    return F.when(value == "true", True).when(value == "false", False) if isinstance(kind, T.BooleanType) else value.cast(kind)


def column_types(flat: DataFrame) -> dict[str, dict[str, T.DataType]]:
    """By class, the type of each property key: boolean or double where all its values are, else text.  (element, class, key, value)."""
    told = flat.groupBy("class", "key").agg(F.every(F.col("value").isin("true", "false")).alias("b"), F.every(F.col("value").rlike(_NUMBER)).alias("n"))
    out: dict[str, dict[str, T.DataType]] = {}
    for r in told.collect():  # the columns of the node tables
        out.setdefault(r["class"], {})[r["key"]] = T.BooleanType() if r["b"] else T.DoubleType() if r["n"] else T.StringType()
    return out


def graph_of(spark: SparkSession, records: DataFrame) -> tuple[PropertyGraph, DataFrame, Observation, Observation]:
    """A graph of STEP records, its edges (type, src, dst, sl, dl, derived), and their observed counts.

    Nodes have their base attributes and property sets' values, which win over an attribute of the same name; keys
    that differ by case alone from an earlier one of their class are numbered like equal ones.  A repeated id is one
    node.  Materials are nodes of their own; what containers' elements decompose into is contained, too.
    """
    folder = store.scratch(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    nodes = kept(step.nodes(records).groupBy("node_id").agg(*(F.min_by(c, F.struct("file", "id")).alias(c) for c in ("class", *BASE))), "nodes")
    rows = kept(step.property_rows(records).drop("json"), "rows")  # names are ranked in several passes over them
    flat = etl.flatten_properties(rows).join(nodes.select(F.col("node_id").alias("element"), "class"), "element")
    flat = kept(flat, "properties")
    chains = {r["leaf"]: tuple(r["labels"]) for r in etl.label_closure(step.supertypes(spark)).collect()}
    types = column_types(flat)
    maps = etl.property_map(flat.select("element", "key", "value"))
    wide = kept(nodes.join(maps, nodes["node_id"] == maps["element"], "left").drop("element"), "wide")
    classes = sorted(r["class"] for r in nodes.select("class").distinct().collect())

    def table(leaf: str) -> NodeTable:
        own, columns = types.get(leaf, {}), {}
        for key in (*(b for b in BASE if b not in own), *sorted(own)):
            name, n = key, 0
            while name.lower() in {"node_id", *map(str.lower, columns)}:
                n += 1
                name = f"{key}_{n}"
            columns[name] = F.col(key) if key in BASE and key not in own else typed(F.col("props")[key], own[key])
        rows = wide.where(F.col("class") == leaf)
        return NodeTable(chains.get(leaf, (leaf, ROOT)), lambda: rows.select("node_id", *(c.alias(n) for n, c in columns.items())))

    tables = {leaf: table(leaf) for leaf in classes}
    uses = step.material_rows(records)
    materials, has = etl.materials(uses)
    materials = kept(materials.withColumnRenamed("material_id", "node_id"), "materials")
    if not materials.isEmpty():
        tables[MATERIAL] = NodeTable((MATERIAL,), lambda: materials)
    pairs = step.submitted(records).unionByName(has.select(F.lit("HAS_MATERIAL").alias("type"), "src", "dst"))
    ids = nodes.select("node_id", "class").unionAll(materials.select("node_id", F.lit(MATERIAL).alias("class")))
    kinds = sorted({k for k, _, _ in step.RELATIONS.values()} | {"HAS_MATERIAL"})
    made, asked, there = observed(pairs, ids, kinds)
    made = kept(made, "edges")
    derived = derived_containment(made.where("type = 'CONTAINS'"), made.where("type = 'DECOMPOSES'"))
    every = made.withColumn("derived", F.lit(None).cast("boolean")).unionByName(derived.select(F.lit("CONTAINS").alias("type"), "src", "dst", "derived"))
    leaf = lambda end: ids.select(F.col("node_id").alias(end), F.col("class").alias(end[0] + "l"))
    ended = kept(every.join(leaf("src"), "src").join(leaf("dst"), "dst"), "ends")
    edges: dict[str, list[EdgePart]] = {}
    for r in ended.groupBy("type", "sl", "dl").count().orderBy("type", "sl", "dl").collect():  # signatures of the schema
        own = ended.where((F.col("type") == r["type"]) & (F.col("sl") == r["sl"]) & (F.col("dl") == r["dl"])).select("src", "dst", "derived")
        edges.setdefault(r["type"], []).append(EdgePart(lambda own=own: own, r["sl"], r["dl"]))
    return PropertyGraph(tables, {k: EdgeTable(tuple(p)) for k, p in edges.items()}), ended, asked, there


def load(spark: SparkSession, path: str, into: str, buckets: int | None = None, split_bytes: int | None = None) -> Loaded:
    """Load the STEP files of a path into a stored graph, in place of what was there, and read it again.

    Files without a rooted record give no graph: an error, as there is nothing to read.
    """
    size = {} if split_bytes is None else {"split_bytes": split_bytes}
    statements = step.statements(spark, path, **size)
    kept = store.scratch(spark)
    statements.write.parquet(kept)
    statements = spark.read.schema(statements.schema).parquet(kept)
    graph, _, asked, made = graph_of(spark, statements.where("id IS NOT NULL").select("file", "id", "class", "args"))
    if not graph.tables:
        raise ValueError(f"no rooted record in {path}")
    store.write(graph, into, buckets)
    return Loaded(store.read(spark, into), statistics(spark, asked, made), statements.where("raw IS NOT NULL").count())
