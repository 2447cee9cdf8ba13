"""Few-shot templates: preconditions, order of labels, and the smoke run."""

from pyspark.sql import functions as F

from propgraph.operators import templates, wellformed
from propgraph.operators.graph import EdgePart, EdgeTable, NodeTable, PropertyGraph


def test_examples_of_a_building(spark):
    node = lambda rows, ddl: lambda: spark.createDataFrame(rows, f"node_id string, Name string{ddl}")
    tables = {
        "IfcDoor": NodeTable(("IfcDoor",), node([("d1", "D", 2.0, "EI30"), ("d2", "E", 3.5, "EI'60")], ", Width double, FireRating string")),
        "IfcSpace": NodeTable(("IfcSpace",), node([("s1", "Room", 9.0)], ", Area double")),
        "IfcBuildingStorey": NodeTable(("IfcBuildingStorey",), node([("l1", "Level 1")], "")),
    }
    edges = {"CONTAINS": EdgeTable((EdgePart(lambda: spark.createDataFrame([("l1", "d1")], "src string, dst string"), "IfcBuildingStorey", "IfcDoor"),)), "DECOMPOSES": EdgeTable((EdgePart(lambda: spark.createDataFrame([("l1", "s1")], "src string, dst string"), "IfcBuildingStorey", "IfcSpace"),))}
    graph = PropertyGraph(tables, edges)
    known = templates.Known(
        {"IfcDoor": 2, "IfcSpace": 1, "IfcBuildingStorey": 1, "IfcWall": 0}, {("IfcDoor", "FireRating"): ["EI'60"], ("IfcBuildingStorey", "Name"): ["Level 1"], ("IfcWall", "x"): ["y"]},
        [("IfcBuildingStorey", "CONTAINS", "IfcDoor"), ("IfcBuildingStorey", "DECOMPOSES", "IfcSpace")], {"IfcDoor": ["Width"]},
    )
    found = templates.examples(graph, known)
    assert [e.text for e in found] == [
        "MATCH (n:IfcDoor) RETURN count(n)", "MATCH (n:IfcDoor) WHERE n.FireRating = 'EI\\'60' RETURN n", "MATCH (s:IfcBuildingStorey)-[:CONTAINS]->(d:IfcDoor) WHERE s.Name = 'Level 1' RETURN count(d)",
        "MATCH (s:IfcBuildingStorey)-[:DECOMPOSES]->(sp:IfcSpace) WHERE s.Name = 'Level 1' RETURN count(sp)", "MATCH (n:IfcDoor) RETURN sum(n.Width)", "MATCH (n:IfcDoor) RETURN n.Name ORDER BY n.Width DESC LIMIT 1",
    ]
    assert [e.run(graph).count() for e in found] == [1, 1, 1, 1, 1, 1] and found[4].run(graph).first()[0] == 5.5 and found[5].run(graph).first()[0] == "E"
    rows = spark.createDataFrame([(e.text,) for e in found], "t string").select(wellformed.well_formed(F.col("t")).alias("ok")).collect()
    assert all(r["ok"] for r in rows)
    broken = templates.Known({"IfcDoor": 2}, {}, [], {"IfcDoor": ["Height"]})
    assert [e.question for e in templates.examples(graph, broken)] == ["How many door elements are in the model?"]
    assert templates.examples(graph, templates.Known({})) == [] and len(templates.examples(graph, known, most=2)) == 2
