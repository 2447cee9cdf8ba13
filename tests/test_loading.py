"""Loading: relation subtypes, records over several lines, a reload that leaves nothing of the old model, a context's budget."""

import pytest
from pyspark.sql import functions as F

from propgraph.operators import etl
from propgraph.operators.graph import EdgePart, EdgeTable, NodeTable, PropertyGraph
from propgraph.sources import documents, step


def gid(k):
    return f"{k:022d}"


RECORDS = [
    f"#1=IFCSPACE('{gid(1)}',$,'Room; big',$,$,$,$,$,$,$,$);",
    f"#2=IFCWALL('{gid(2)}',$,'Wall',$,$,$,$,$);",
    f"#3=IFCWALL('{gid(3)}',$,'Wall',$,$,$,$,$);",
    f"#4=IFCRELSPACEBOUNDARY2NDLEVEL('{gid(4)}',$,$,$,#1,#2,$,.PHYSICAL.,.INTERNAL.,$,$);",
    f"#5=IFCRELSPACEBOUNDARY1STLEVEL('{gid(5)}',$,$,$,#1,#3,$,.PHYSICAL.,.INTERNAL.,$);",
    f"#6=IFCRELCONNECTSWITHREALIZINGELEMENTS('{gid(6)}',$,$,$,$,#2,#3,(#1),$);",
]
WANTED = [("BOUNDED_BY", 1, 2), ("BOUNDED_BY", 1, 3), ("CONNECTED_TO", 2, 3)]


def found(recs):
    return sorted((r["type"], int(r["src"]), int(r["dst"])) for r in step.edges(recs).collect())


@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
def test_records_over_several_lines(spark, tmp_path, line_break):
    whole, wrapped = tmp_path / "whole.ifc", tmp_path / "wrapped.ifc"
    head = ["ISO-10303-21;", "HEADER;", "ENDSEC;", "DATA;"]
    whole.write_bytes(line_break.join([*head, *RECORDS, "ENDSEC;"]).encode())
    wrapped.write_bytes(line_break.join([*head, *(r.replace("$,#", f"$,{line_break}  #").replace("(#1)", f"({line_break}#1)") for r in RECORDS), "ENDSEC;"]).encode())
    for path in (whole, wrapped):
        assert found(step.records(spark, str(path))) == WANTED and step.unread(spark, str(path)).count() == 0
    assert {r["Name"] for r in step.nodes(step.records(spark, str(wrapped))).collect()} == {"Room; big", "Wall"}


def graph(spark, leaves, kinds):
    nodes = {leaf: NodeTable((leaf, "Root"), lambda leaf=leaf: spark.createDataFrame([(leaf + "1", leaf)], "node_id string, Name string")) for leaf in leaves}
    pairs = EdgeTable((EdgePart(lambda: spark.createDataFrame([("a", "b")], "src string, dst string")),))
    return PropertyGraph(nodes, dict.fromkeys(kinds, pairs))


def test_reload_leaves_nothing_of_the_old_model(spark, tmp_path):
    path = str(tmp_path / "g")
    graph(spark, ["Wall", "Door"], ["CONTAINS", "FILLS"]).write(path)
    graph(spark, ["Wall", "Slab"], ["CONTAINS"]).write(path)
    assert {r["Name"] for r in spark.read.parquet(f"{path}/nodes").collect()} == {"Wall", "Slab"}
    assert {r["type"] for r in spark.read.parquet(f"{path}/edges").collect()} == {"CONTAINS"}
    again = PropertyGraph.read(spark, path)
    assert {r["Name"] for r in again.nodes().collect()} == {"Wall", "Slab"} and list(again.edges) == ["CONTAINS"]


def test_what_a_document_says_of_itself(spark, tmp_path):
    (tmp_path / "a.ids").write_text('<ids:ids xmlns:ids="x"><ids:info><ids:title> Doors </ids:title><ids:version>1.2</ids:version><ids:author>a</ids:author></ids:info></ids:ids>')
    (tmp_path / "b.ids").write_text('<ids:ids xmlns:ids="x"><ids:info><ids:author>a</ids:author></ids:info></ids:ids>')
    assert [tuple(r) for r in documents.info(spark, str(tmp_path / "a.ids")).collect()] == [("Doors", "1.2")]
    assert [tuple(r) for r in documents.info(spark, str(tmp_path / "b.ids")).collect()] == [("", "")]


def test_two_class_hierarchies_in_one_session(spark):
    one = etl.label_closure(spark.createDataFrame([("A", None), ("B", "A")], "class string, parent string"))
    two = etl.label_closure(spark.createDataFrame([("X", None), ("Y", "X")], "class string, parent string"))
    assert {r["leaf"]: r["labels"] for r in one.collect()} == {"A": ["A"], "B": ["B", "A"]} and {r["leaf"] for r in two.collect()} == {"X", "Y"}


def test_context_within_a_budget(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.lit("x" * 7)).when(F.col("id") % 5 == 0, F.lit("")).alias("t"))
    assert [r["id"] for r in documents.within_budget(rows, ["id"], "t", 7).orderBy("id").collect()] == [0, 2, 4]
    assert documents.within_budget(rows, ["id"], "t", 0).count() == 0


def test_names_by_rank_and_repair(spark):
    """Many properties on one element, and elements where a numbered name is taken by itself, as the fold over each has them."""
    rows = [("hot", "p", "Wide Name" if k % 3 else f"N {k}", str(k), k) for k in range(10_000)]
    rows += [("a", "p", n, str(k), k) for k, n in enumerate(["A", "A_1", "A", "A", "A_1", "A_1_1", "B"])] + [("b", "p", n, str(k), k) for k, n in enumerate(["A_5", "A", "A", "A_01", "A_1x"])]
    rows += [("c", "p", n, str(k), k) for k, n in enumerate(["A", "A", "A_1"])] + [("c", "p", "A", None, 9), ("c", "p", "id", "x", 10)]
    got = {(r["element"], r["key"]): r["value"] for r in etl.flatten_properties(spark.createDataFrame(rows, "element string, pset string, name string, value string, position int")).collect()}
    want = {}
    for element, _, name, value, _ in rows:
        if value is None or name == "id":
            continue
        key = base = name.replace(" ", "_")
        n = 0
        while (element, key) in want:
            n += 1
            key = f"{base}_{n}"
        want[element, key] = value
    assert got == want
