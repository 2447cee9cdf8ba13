"""The load end to end: STEP files to a stored graph and back."""

import pytest
from pyspark.sql import functions as F

from propgraph.operators import load, store
from propgraph.operators.match import match
from tests.test_building import STEP, gid


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("load")
    (folder / "in").mkdir()
    (folder / "in" / "model.ifc").write_text(STEP + "\n#200=IFCWALL('broken',;\n#201=IFCRELAGGREGATES('r',$,$,$,#10,(#999));")
    return load.load(spark, str(folder / "in"), str(folder / "out"), buckets=2, split_bytes=500), str(folder / "out")


def test_nodes_edges_and_statistics(spark, loaded):
    found, path = loaded
    graph = found.graph
    assert graph.tables["IfcWallStandardCase"].labels[:3] == ("IfcWallStandardCase", "IfcWall", "IfcBuildingElement") and graph.tables["Material"].labels == ("Material",)
    walls = {int(r["node_id"]): r.asDict() for r in graph.nodes("IfcWall").collect()}
    assert sorted(walls) == [30, 31] and walls[30]["Fire_Rating_1"] == "EI60" and walls[30]["IsExternal"] is True and walls[30]["Width"] == 0.25 and walls[31]["Width"] is None
    edges = sorted((r["type"], r["src"][-2:], r["dst"][-2:], r["derived"]) for r in graph.all_edges().where("type <> 'HAS_MATERIAL'").collect())
    assert edges == [
        ("BOUNDED_BY", "20", "30", None), ("BOUNDED_BY", "21", "30", None), ("CONTAINS", "10", "30", None), ("CONTAINS", "10", "40", None), ("CONTAINS", "10", "50", True),
        ("DECOMPOSES", "10", "20", None), ("DECOMPOSES", "10", "21", None), ("DECOMPOSES", "40", "50", None), ("FILLS", "50", "60", None), ("HAS_OPENING", "30", "60", None),
    ]
    told = {r["type"]: (r["submitted"], r["created"]) for r in found.statistics.collect()}
    assert told == {"BOUNDED_BY": (2, 2), "CONTAINS": (2, 2), "DECOMPOSES": (4, 3), "FILLS": (1, 1), "HAS_MATERIAL": (3, 3), "HAS_OPENING": (1, 1)}
    assert found.unread == 1


def test_patterns_over_a_loaded_graph(spark, loaded):
    graph = store.read(spark, loaded[1])
    doors = match(graph, "d", "IfcDoor").hop("FILLS", None, "IfcOpeningElement").hop("HAS_OPENING", "w", "IfcWall", direction="in")
    assert [r["n"] for r in doors.select(F.col("w.Name").alias("n")).collect()] == ["Wall 0"]
    assert match(graph, "w", "IfcWall").hop("HAS_MATERIAL", "m", "Material").where(F.col("m.Name") == "Brick").df.count() == 2
    assert [r["Name"] for r in store.lookup(graph, gid(50)).collect()] == ["Door"]


def test_nothing_to_load(spark, tmp_path):
    (tmp_path / "m.ifc").write_text("ISO-10303-21;\nENDSEC;\n")
    with pytest.raises(ValueError, match="no rooted record"):
        load.load(spark, str(tmp_path / "m.ifc"), str(tmp_path / "out"))


def test_columns_that_differ_by_case(spark):
    """Property keys are columns: those that differ by case alone have numbers."""
    recs = spark.createDataFrame(
        [("f", 1, "IFCWALL", [f"'{gid(1)}'", "$", "'W'"]), ("f", 2, "IFCPROPERTYSINGLEVALUE", ["'width'", "$", "IFCREAL(1.)"]), ("f", 3, "IFCPROPERTYSINGLEVALUE", ["'Width'", "$", "IFCLABEL('x')"])]
        + [("f", 4, "IFCPROPERTYSET", [f"'{gid(4)}'", "$", "'P'", "$", "(#2,#3)"]), ("f", 5, "IFCRELDEFINESBYPROPERTIES", [f"'{gid(5)}'", "$", "$", "$", "(#1)", "#4"])],
        "file string, id long, class string, args array<string>",
    )
    graph = load.graph_of(spark, recs)[0]
    assert [r.asDict() for r in graph.nodes("IfcWall").collect()] == [{"node_id": gid(1), "Name": "W", "Description": None, "ObjectType": None, "Width": "x", "width_1": 1.0}]
