"""Graphs on disk: bucketed, sorted tables with Bloom filters, and a catalogue that a reader opens them by.

    <path>/nodes/leaf=Wall              bucketed and sorted by node_id, a Bloom filter on it
    <path>/edges/type=FILLS/ends=A-B    bucketed and sorted by src
    <path>/edges_in/type=FILLS/ends=A-B the same edges by dst, for hops against their direction
    <path>/catalogue                    leaves, labels, edge parts, rows and columns, written last

Nodes and edges have the same number of buckets, so a hop joins them without an exchange; a look-up of an
id opens one bucket's file of each leaf and of it the row group that can hold the id.  A key with a large
share of all rows is dealt over several files of its bucket when it is written; to read it so that large
joins split it, set spark.sql.sources.bucketing.enabled to false.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from propgraph.operators.graph import EdgePart, EdgeTable, NodeTable, PropertyGraph

ANY = "any"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir or, on a local master only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="propgraph-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder}/propgraph-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to a new shared folder, for what reads them more than once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _prune(spark: SparkSession, folder: str, kept: set[str]) -> None:
    """Delete the children of a folder that are not kept."""
    system, at = _folder(spark, folder)
    if system.exists(at):
        for status in system.listStatus(at):
            if status.getPath().getName() not in kept:
                system.delete(status.getPath(), True)


@dataclass(frozen=True)
class Part:
    """A table of the store, as the catalogue has it.  src and dst: an edge part's leaves; key: what it is bucketed by."""

    kind: str
    name: str
    folder: str
    key: str
    columns: str
    rows: int
    labels: tuple[str, ...] = ()
    src: str | None = None
    dst: str | None = None
    unique: bool = False


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def told(seen: Observation) -> dict[str, int]:
    """What was observed.  Spark does not run what it knows to be empty, so then nothing was: no counts."""
    try:
        return dict(seen.get)
    except Py4JJavaError as e:
        if "assertion failed" in str(e.java_exception):  # a row without fields
            return {}
        raise


def _write(df: DataFrame, path: str, key: str, buckets: int) -> dict[str, int]:
    """Write a table, and count its rows in the same pass."""
    seen = Observation()
    spark, name = df.sparkSession, f"propgraph_{uuid.uuid4().hex}"
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.hint("rebalance", buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).option(f"parquet.bloom.filter.enabled#{key}", "true").mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: a reader names them anew
    return {"rows": 0} | told(seen)


def write(graph: PropertyGraph, path: str, buckets: int | None = None, both_ways: bool = True) -> dict[tuple[str, str], dict[str, int]]:
    """Write the graph in place of what was there, and return rows by ("node", leaf) and ("edge", type), counted while writing.

    buckets: of each table (None: as many as spark.sql.shuffle.partitions).  both_ways: keep edges by dst too.
    A failed write leaves the old catalogue away, so that no reader takes half of a new graph for the old one.  The
    graph must not read from the path.
    """
    spark = next(iter(graph.tables.values())).df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _prune(spark, path, {"nodes", "edges", "edges_in"})
    parts: list[Part] = []
    counts: dict[tuple[str, str], dict[str, int]] = {}
    for leaf, t in graph.tables.items():
        folder = f"nodes/leaf={leaf}"
        counts["node", leaf] = _write(t.df, f"{path}/{folder}", "node_id", buckets)
        parts.append(Part("node", leaf, folder, "node_id", _columns(t.df), counts["node", leaf]["rows"], t.labels))
    for kind, e in graph.edges.items():
        counts["edge", kind] = {"rows": 0}
        for p in e.parts:
            ends = f"type={kind}/ends={p.src or ANY}-{p.dst or ANY}"
            rows = _write(p.df, f"{path}/edges/{ends}", "src", buckets)["rows"]
            counts["edge", kind]["rows"] += rows
            part = Part("edge", kind, f"edges/{ends}", "src", _columns(p.df), rows, (), p.src, p.dst, e.unique)
            parts.append(part)
            if both_ways:
                kept = EdgePart(lambda part=part: _opened(spark, path, part, buckets)).df  # what was written is not made again
                _write(kept, f"{path}/edges_in/{ends}", "dst", buckets)
                parts.append(replace(part, kind="edge_in", folder=f"edges_in/{ends}", key="dst"))
    for top, below in (("nodes", "node"), ("edges", "edge"), ("edges_in", "edge_in")):
        own = [p.folder.split("/")[1:] for p in parts if p.kind == below]
        _prune(spark, f"{path}/{top}", {f[0] for f in own})
        for first in {f[0] for f in own if len(f) > 1}:
            _prune(spark, f"{path}/{top}/{first}", {f[1] for f in own if f[0] == first})
    rows = [(json.dumps({**p.__dict__, "buckets": buckets, "made": uuid.uuid4().hex}),) for p in parts]
    spark.createDataFrame(rows, "part string").coalesce(1).write.mode("overwrite").text(f"{path}/catalogue")
    return counts


def _opened(spark: SparkSession, path: str, part: Part, buckets: int, made: str = "") -> DataFrame:
    """A part as an external table of the session, so that its buckets are known."""
    name = "propgraph_" + hashlib.sha256(f"{path} {part.folder} {part.columns} {buckets} {made or uuid.uuid4().hex}".encode()).hexdigest()[:32]
    where = f"{path}/{part.folder}".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({part.columns}) USING parquet CLUSTERED BY ({part.key}) SORTED BY ({part.key}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, folder, rows, labels, src, dst) of the tables of a stored graph.  A missing path or catalogue is Spark's error."""
    kind = "struct<kind:string,name:string,folder:string,key:string,columns:string,rows:bigint,labels:array<string>,src:string,dst:string,unique:boolean,buckets:int,made:string>"
    return spark.read.text(f"{path}/catalogue").select(F.from_json("value", kind).alias("p")).select("p.*")


def read(spark: SparkSession, path: str) -> PropertyGraph:
    """A stored graph; each table is opened when a query first names it.  Parts without rows are known but not read."""
    rows = catalogue(spark, path).collect()  # a row a table: leaves and pairs of leaves
    graph = PropertyGraph()
    loads = {}
    for r in rows:
        part = Part(r["kind"], r["name"], r["folder"], r["key"], r["columns"], r["rows"], tuple(r["labels"] or ()), r["src"], r["dst"], r["unique"])
        loads[r["kind"], r["folder"]] = part, lambda part=part, r=r: _opened(spark, path, part, r["buckets"], r["made"])
    parts: dict[str, list[EdgePart]] = {}
    unique: dict[str, bool] = {}
    for (kind, folder), (part, load) in loads.items():
        if kind == "node":
            graph.tables[part.name] = NodeTable(part.labels, load)
        elif kind == "edge":
            inward = loads.get(("edge_in", "edges_in" + folder.removeprefix("edges")))
            parts.setdefault(part.name, []).append(EdgePart(load, part.src, part.dst, False, inward[1] if inward else None))
            unique[part.name] = part.unique
    graph.edges |= {kind: EdgeTable(tuple(own), unique[kind]) for kind, own in parts.items()}
    return graph


def lookup(graph: PropertyGraph, *ids: str) -> DataFrame:
    """(node_id, leaf, labels) and properties of the nodes with these ids; ids that no node has give no row."""
    parts = []
    for leaf, t in graph.tables.items():
        found = t.df.where(F.col("node_id").isin(*ids))
        parts.append(found.select("node_id", F.lit(leaf).alias("leaf"), F.array(*map(F.lit, t.labels)).alias("labels"), *(c for c in found.columns if c != "node_id")))
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for name, kind in p.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {name for name, own in kinds.items() if len(own) > 1}
    parts = [p.withColumns({c: F.col(f"`{c}`").cast("string") for c in p.columns if c in mixed}) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
