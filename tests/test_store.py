"""A stored graph: what is read is what was written, joins without exchange, look-ups of one row group."""

import pytest
from pyspark.sql import functions as F

from propgraph.operators import store
from propgraph.operators.graph import EdgePart, EdgeTable, NodeTable, PropertyGraph
from propgraph.operators.match import match
from propgraph.sources.tables import trading_graph


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "graph")
    counts = trading_graph(spark, sf).write(path, buckets=4)
    return path, counts, PropertyGraph.read(spark, path)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_read_is_what_was_written(spark, sf, stored):
    path, counts, again = stored
    graph = trading_graph(spark, sf)
    assert {k: t.labels for k, t in again.tables.items()} == {k: t.labels for k, t in graph.tables.items()}
    for leaf in ("Nation", "Customer", "Part", "Material"):
        assert rows(again.tables[leaf].df) == rows(graph.tables[leaf].df)
        assert counts["node", leaf]["rows"] == graph.tables[leaf].df.count()
    for kind, e in graph.edges.items():
        assert counts["edge", kind]["rows"] == e.df.count() and again.edges[kind].unique == e.unique
        assert [(p.src, p.dst) for p in again.edges[kind].parts] == [(p.src, p.dst) for p in e.parts]
    for kind in ("HAS_OPENING", "CONTAINS"):
        assert rows(again.edges[kind].df) == rows(graph.edges[kind].df)
        assert rows(again.edges[kind].between(None, None, inward=True)) == rows(graph.edges[kind].df)
    assert store.catalogue(spark, path).where("kind = 'node' AND name = 'Nation'").first()["rows"] == 25


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hops_without_exchange(spark, stored):
    graph = stored[2]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = match(graph, "n", "Nation").hop("CONTAINS", None, "Customer").select(F.col("n.Name").alias("name"))
        back = match(graph, "o", "Order").hop("DECOMPOSES", None, "Customer", direction="in").select(F.col("o.node_id").alias("o"))
        many = match(graph, "o", "Order").hop("HAS_OPENING", None, "Part", how="left").groupBy(F.col("o.node_id").alias("o")).agg(F.count("_1").alias("parts"))
        has = match(graph, "o", "Order").having("BOUNDED_BY", "Supplier").select(F.col("o.node_id").alias("o"))
        for df in (one, back, many, has):
            assert "SortMergeJoin" in plan(df) and "Exchange" not in plan(df), plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_look_up_reads_one_row_group(spark, tmp_path):
    """Ids are dealt over buckets and sorted, so equal ids' row group is found by bucket, bounds and Bloom filter."""
    path = str(tmp_path / "g")
    ids = spark.range(60_000).select(F.concat(F.lit("W:"), F.col("id").cast("string")).alias("node_id"), F.concat(F.lit("wall "), F.col("id")).alias("Name"))
    spark.conf.set("parquet.block.size", str(64 << 10))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(64 << 10))
    try:
        PropertyGraph({"Wall": NodeTable(("Wall", "Root"), lambda: ids)}, {}).write(path, buckets=4)
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    found = store.lookup(PropertyGraph.read(spark, path), "W:777")
    assert [(r["Name"], r["leaf"], r["labels"]) for r in found.collect()] == [("wall 777", "Wall", ["Wall", "Root"])]
    final = found._jdf.queryExecution().executedPlan()
    leaves = final.collectLeaves()
    scan = leaves.apply(0)
    while scan.nodeName().startswith(("AdaptiveSparkPlan", "ResultQueryStage")):
        scan = scan.executedPlan().collectLeaves().apply(0) if scan.nodeName().startswith("Adaptive") else scan.plan().collectLeaves().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read < 8_000, (read, scan.nodeName())
    assert store.lookup(PropertyGraph.read(spark, path), "W:none", "x").count() == 0


def test_parts_of_one_type_and_no_edges(spark, tmp_path):
    path = str(tmp_path / "g")
    nodes = {k: NodeTable((k, "Root"), lambda k=k: spark.createDataFrame([(k + "1", 1.5)], "node_id string, `a b` double")) for k in ("A", "B")}
    some = lambda *p: spark.createDataFrame(list(p), "src string, dst string, derived boolean")
    edges = {"T": EdgeTable((EdgePart(lambda: some(("A1", "B1", None), ("A1", "B1", None)), "A", "B"), EdgePart(lambda: some(("B1", "A1", True)), "B", None)))}
    PropertyGraph(nodes, edges).write(path, buckets=2, both_ways=False)
    again = PropertyGraph.read(spark, path)
    assert rows(again.edges["T"].df) == rows(some(("A1", "B1", None), ("A1", "B1", None), ("B1", "A1", True)))
    assert rows(again.nodes("Root")) == rows(PropertyGraph(nodes, {}).nodes())
    PropertyGraph({"A": nodes["A"]}, {"T": EdgeTable((EdgePart(lambda: some(), "A", "A"),))}).write(path, buckets=3)
    again = PropertyGraph.read(spark, path)
    assert again.nodes().count() == 1 and again.edges["T"].df.count() == 0 and [(p.src, p.dst) for p in again.edges["T"].parts] == [("A", "A")]
