"""A small building: STEP and requirement files, patterns over its graph, closure, profiling."""

import pytest
from pyspark.sql import functions as F

from propgraph.functions import names, tokens, values
from propgraph.operators import closure, etl, grammar, profile, prompts, scoring, sinks, vocabulary
from propgraph.operators.graph import EdgePart, EdgeTable, NodeTable, PropertyGraph
from propgraph.operators.match import match
from propgraph.sources import documents, step
from propgraph.sources.tables import trading_graph


def gid(n):
    return f"{n:022d}"


STEP = "\n".join(
    ["ISO-10303-21;", "DATA;", f"#1=IFCPROJECT('{gid(1)}',$,'P',$,$,$,$,$,$);"]
    + [f"#{10 + k}=IFCBUILDINGSTOREY('{gid(10 + k)}',$,'Level {k}',$,$,$,$,$,.ELEMENT.,0.);" for k in range(2)]
    + [f"#{20 + k}=IFCSPACE('{gid(20 + k)}',$,'Room {k}; it''s (big)',$,$,$,$,$,$,$,$);" for k in range(3)]
    + [f"#{30 + k}=IFCWALLSTANDARDCASE('{gid(30 + k)}',$,'Wall {k}',$,$,$,$,$);" for k in range(2)]
    + [f"#40=IFCCURTAINWALL('{gid(40)}',$,'Curtain',$,$,$,$,$);", f"#50=IFCDOOR('{gid(50)}',$,'Door',$,$,$,$,$,2.1,0.9);", f"#60=IFCOPENINGELEMENT('{gid(60)}',$,'Hole',$,$,$,$,$);"]
    + [
        f"#70=IFCRELCONTAINEDINSPATIALSTRUCTURE('{gid(70)}',$,$,$,(#30,#40),#10);",
        f"#71=IFCRELAGGREGATES('{gid(71)}',$,$,$,#10,(#20,#21));",
        f"#72=IFCRELAGGREGATES('{gid(72)}',$,$,$,#40,(#50));",
        f"#73=IFCRELVOIDSELEMENT('{gid(73)}',$,$,$,#30,#60);",
        f"#74=IFCRELFILLSELEMENT('{gid(74)}',$,$,$,#60,#50);",
        f"#75=IFCRELSPACEBOUNDARY('{gid(75)}',$,$,$,#20,#30,$,.PHYSICAL.,.INTERNAL.);",
        f"#76=IFCRELSPACEBOUNDARY('{gid(76)}',$,$,$,#21,#30,$,.PHYSICAL.,.INTERNAL.);",
        f"#77=IFCRELSPACEBOUNDARY('{gid(77)}',$,$,$,#21,$,$,.VIRTUAL.,.INTERNAL.);",
        "#80=IFCPROPERTYSINGLEVALUE('Fire Rating',$,IFCLABEL('EI30'),$);",
        "#81=IFCPROPERTYSINGLEVALUE('Fire-Rating',$,IFCLABEL('EI60'),$);",
        "#82=IFCPROPERTYSINGLEVALUE('IsExternal',$,IFCBOOLEAN(.T.),$);",
        "#83=IFCQUANTITYLENGTH('Width',$,$,0.25,$);",
        "#84=IFCPROPERTYSINGLEVALUE('Nothing',$,$,$);",
        f"#90=IFCPROPERTYSET('{gid(90)}',$,'Pset_Wall',$,(#80,#81,#82,#84));",
        f"#91=IFCELEMENTQUANTITY('{gid(91)}',$,'Qto_Wall',$,$,(#83));",
        f"#92=IFCRELDEFINESBYPROPERTIES('{gid(92)}',$,$,$,(#30,#31),#90);",
        f"#93=IFCRELDEFINESBYPROPERTIES('{gid(93)}',$,$,$,(#30),#91);",
        "#100=IFCMATERIAL('Brick');",
        "#101=IFCMATERIALLAYER(#100,0.2,$);",
        "#102=IFCMATERIALLAYERSET((#101),'set');",
        "#103=IFCMATERIALLAYERSETUSAGE(#102,.AXIS2.,.POSITIVE.,0.);",
        f"#104=IFCRELASSOCIATESMATERIAL('{gid(104)}',$,$,$,(#30,#31),#103);",
        f"#105=IFCRELASSOCIATESMATERIAL('{gid(105)}',$,$,$,(#40),#100);",
        "ENDSEC;",
    ]
)


@pytest.fixture(scope="module")
def recs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("step") / "model.ifc"
    path.write_text(STEP)
    return step.records(spark, str(path)).cache()


@pytest.fixture(scope="module")
def building(spark, recs):
    chains = {r["leaf"]: tuple(r["labels"]) for r in etl.label_closure(step.supertypes(spark)).collect()}
    nodes, edges = step.nodes(recs).cache(), step.edges(recs).cache()
    tables = {}
    for leaf in {r["class"] for r in nodes.select("class").distinct().collect()}:
        tables[leaf] = NodeTable(chains[leaf], lambda leaf=leaf: nodes.where(F.col("class") == leaf).select("node_id", "Name"))
    kinds = {r["type"] for r in edges.select("type").distinct().collect()}
    return PropertyGraph(tables, {k: EdgeTable((EdgePart(lambda k=k: edges.where(F.col("type") == k).select("src", "dst")),)) for k in kinds})


def test_records_and_nodes(recs):
    spaces = {r["Name"] for r in step.nodes(recs).where("class = 'IfcSpace'").collect()}
    assert "Room 1; it's (big)" in spaces and len(spaces) == 3
    assert {r["class"] for r in step.nodes(recs).collect()} >= {"IfcWallStandardCase", "IfcDoor", "IfcBuildingStorey"}


def test_edges(recs):
    found = sorted((r["type"], int(r["src"]), int(r["dst"])) for r in step.edges(recs).collect())
    assert ("CONTAINS", 10, 30) in found and ("FILLS", 50, 60) in found and ("HAS_OPENING", 30, 60) in found
    assert [x for x in found if x[0] == "BOUNDED_BY"] == [("BOUNDED_BY", 20, 30), ("BOUNDED_BY", 21, 30)]


def test_properties(recs):
    flat = {(int(r["element"]), r["key"]): r["value"] for r in etl.flatten_properties(step.property_rows(recs)).collect()}
    assert flat == {(30, "Fire_Rating"): "EI30", (30, "Fire_Rating_1"): "EI60", (30, "IsExternal"): "true", (30, "Width"): "0.25", (31, "Fire_Rating"): "EI30", (31, "Fire_Rating_1"): "EI60", (31, "IsExternal"): "true"}


def test_materials(recs):
    rows = step.material_rows(recs)
    assert sorted((int(r["element"]), r["material"]) for r in rows.collect()) == [(30, "Brick"), (31, "Brick"), (40, "Brick")]
    nodes, edges = etl.materials(rows)
    assert nodes.count() == 1 and edges.count() == 3


def test_label_chain(spark):
    chain = {r["leaf"]: r["labels"] for r in etl.label_closure(step.supertypes(spark)).collect()}["IfcWallStandardCase"]
    assert chain[:3] == ["IfcWallStandardCase", "IfcWall", "IfcBuildingElement"] and chain[-1] == "IfcRoot"


def test_patterns(building):
    walls = match(building, "w", "IfcWall", "IfcCurtainWall").df.count()
    assert walls == 3
    doors = match(building, "d", "IfcDoor").hop("FILLS", None, "IfcOpeningElement").hop("HAS_OPENING", "w", "IfcWall", direction="in")
    assert [r["n"] for r in doors.select(F.col("w.Name").alias("n")).collect()] == ["Wall 0"]
    assert match(building, "s", "IfcSpace").lacking("BOUNDED_BY", "IfcWall").df.count() == 1
    met = match(building, "a", "IfcSpace").hop("BOUNDED_BY", "w", "IfcWall", same_type_again=True).hop("BOUNDED_BY", "b", "IfcSpace", direction="in", same_type_again=True)
    assert met.df.count() == 2
    assert match(building, "s", "IfcSpace").hop("BOUNDS", "d").df.count() == 0
    assert match(building, "s", "IfcSpace").flagged("f", "NOWHERE").where(F.col("f")).df.count() == 0


def test_negation_is_an_anti_join(building):
    plan = match(building, "s", "IfcSpace").lacking("BOUNDED_BY").df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Cartesian" not in plan


def test_parts_between_other_labels_are_not_read(spark, sf):
    g = trading_graph(spark, sf)
    plan = match(g, "n", "Nation").hop("CONTAINS", None, "Customer").agg(F.count("_1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "s_suppkey" not in plan and plan.count("Join") == 1


def test_derived_containment(building):
    made = closure.derived_containment(building.edges["CONTAINS"].df, building.edges["DECOMPOSES"].df)
    assert [(int(r["src"]), int(r["dst"]), r["derived"]) for r in made.collect()] == [(10, 50, True)]


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert closure.transitive_closure(edges).count() == 10
    assert closure.transitive_closure(edges, 1).count() == 4


def test_profile(building):
    counts = {r["label"]: r["n"] for r in profile.label_counts(building).collect()}
    assert counts["IfcSpace"] == 3 and counts["IfcWall"] == 2
    assert building.duplicate_ids().count() == 0
    signs = {tuple(r) for r in profile.signatures(building).collect()}
    assert ("IfcDoor", "FILLS", "IfcOpeningElement") in signs
    assert {(r["label"], r["key"]) for r in profile.known_keys(building).collect()} >= {("IfcSpace", "Name")}


def test_shared_neighbours_in_cells(spark):
    edges = [(f"s{k}", "hub") for k in range(40)] + [("s1", "x"), ("s1", "x"), ("t", "x"), ("alone", "y"), (None, "hub"), ("u", None), ("w", None)]
    made = spark.createDataFrame(edges, "src string, dst string")
    hub = {(a, b) for a in (f"s{k}" for k in range(40)) for b in (f"s{k}" for k in range(40)) if a < b}
    for block in (3, 1024):
        got = [tuple(r) for r in profile.shared_neighbours(made, block).collect()]
        assert len(got) == len(set(got)) and set(got) == hub | {("s1", "t")}
    assert profile.shared_neighbours(made.limit(0)).count() == 0


def test_write_is_idempotent(building, tmp_path, spark):
    for _ in range(2):
        building.write(str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).where("type = 'CONTAINS'").count() == 2


IDS = """<?xml version="1.0"?><ids:ids xmlns:ids="http://standards.buildingsmart.org/IDS" xmlns:xs="http://www.w3.org/2001/XMLSchema"><ids:specifications>
<ids:specification name="Doors"><ids:applicability><ids:entity><ids:name><ids:simpleValue>IFCDOOR</ids:simpleValue></ids:name></ids:entity></ids:applicability>
<ids:requirements><ids:property dataType="IFCLABEL" cardinality="required"><ids:propertySet><ids:simpleValue>Pset_Door</ids:simpleValue></ids:propertySet><ids:baseName><ids:simpleValue>FireRating</ids:simpleValue></ids:baseName>
<ids:value><xs:restriction base="xs:string"><xs:enumeration value="EI30"/><xs:enumeration value="EI60"/></xs:restriction></ids:value></ids:property>
<ids:property><ids:baseName><ids:simpleValue>IsExternal</ids:simpleValue></ids:baseName></ids:property><ids:property><ids:propertySet><ids:simpleValue>X</ids:simpleValue></ids:propertySet></ids:property></ids:requirements></ids:specification>
</ids:specifications></ids:ids>"""


def test_requirements(spark, tmp_path):
    path = tmp_path / "r.ids"
    path.write_text(IDS)
    specs = documents.specifications(spark, str(path))
    assert [r["entity"] for r in documents.entities(specs).collect()] == ["IFCDOOR"]
    props = {r["property"]: r for r in documents.properties(specs).collect()}
    assert set(props) == {"FireRating", "IsExternal"} and props["FireRating"]["choices"] == ["EI30", "EI60"] and props["IsExternal"]["cardinality"] == "optional"
    pairs = documents.entity_properties(specs)
    assert documents.properties_of(pairs, "IfcDoor").count() == documents.properties_of(pairs, "IfcRoof").count() == 2
    merged = {r["property"]: r for r in vocabulary.merge_properties(spark.createDataFrame([("IsExternal",), ("Width",)], "property string"), documents.properties(specs)).collect()}
    assert (merged["FireRating"]["kind"], merged["IsExternal"]["source"], merged["Width"]["kind"]) == ("STRICT", "both", "NUMERIC")
    assert documents.or_common(specs.where("false").select(F.lit("x").alias("entity")), "entity", documents.COMMON_ENTITIES).count() == len(documents.COMMON_ENTITIES)


def test_test_sets(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.csv"
    a.write_text('{"cases": [{"NL Query": "q1", "cypher": "c1", "difficulty": "L1"}, {"NL Query": " ", "cypher": "c2"}]}')
    b.write_text('question,expected_cypher,category\n"a, b",x,basic\n')
    assert [tuple(r) for r in documents.test_set(spark, str(a)).collect()] == [(0, "q1", "c1", None, "L1")]
    assert [tuple(r) for r in documents.test_set(spark, str(b)).collect()] == [(0, "a, b", "x", "basic", None)]


def test_names(spark):
    raw = ["Ramp Max-Slope (1/x)", "a   b---c...d", "__x__", "(weird)", "id", "é²"]
    df = spark.createDataFrame([(x,) for x in raw], "n string").withColumn("c", names.canonical(F.col("n")))
    assert [r["c"] for r in df.collect()] == ["Ramp_Max_Slope_1_x", "a_b_c_d", "x", "weird", "ifc_id", "é²"]
    assert df.where(names.canonical(F.col("c")) != F.col("c")).count() == 0
    one = spark.range(1).select(names.humanised(F.lit("IfcBuildingStorey")).alias("h"), names.class_case(F.lit("IFCWALL")).alias("c")).first()
    assert tuple(one) == ("building storey", "IfcWall")


def test_tokens(spark):
    sel = spark.range(1).select(
        tokens.record(tokens.text(F.lit("Level 1")), tokens.integer(F.lit(5))).alias("r"),
        tokens.bag(F.array(F.lit("g-b"), F.lit("g-a"), F.lit(None).cast("string"), F.lit("g-c"))).alias("b"),
        tokens.record(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("n"),
        tokens.answer_tokens(F.lit('```json\n["5", 3.14, true, "x"]\n```')).alias("a"),
        tokens.answer_tokens(F.lit("none")).alias("z"),
        tokens.value_token(values.value(F.lit(5.0), __import__("pyspark.sql.types", fromlist=["x"]).DoubleType())).alias("d"),
    ).first()
    assert sel["r"] == "Level 1\x1enum:5" and sel["b"] == "g-a\x1fg-b\x1fg-c" and sel["n"] is None and sel["z"] is None
    assert sel["a"] == ["num:5", "num:3.14", "bool:1", "x"] and sel["d"] == "num:5.0"


def test_tokens_of_numbers(spark):
    cells = ["12345678901234567890", "+0012", "-0", "12345678.9", "0.0001", "1e7", "5."]
    got = spark.range(1).select(*(tokens.text(F.lit(c)).alias(f"t{k}") for k, c in enumerate(cells))).first()
    assert list(got) == ["num:12345678901234567890", "num:12", "num:0", "num:12345678.9", "num:0.0001", "num:10000000.0", "num:5.0"]


def test_properties_leave_out_functions(spark):
    got = spark.range(1).select(scoring.used_properties(F.lit("RETURN a.id, a.Name, b.labels, b.type, c.Width")).alias("p")).first()
    assert got["p"] == ["Name", "Width"]


def test_accuracy(spark):
    df = spark.createDataFrame([(["A", "B"], ["A", "C"]), ([], []), (["A"], [])], "g array<string>, t array<string>")
    got = [r["x"] for r in df.select(scoring.execution_accuracy(F.col("g"), F.col("t")).alias("x")).collect()]
    assert got == [1 / 3, 1.0, 0.0]


def test_across_runs(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("k", 3.0)], "s string, ea double")
    got = {r["s"]: (r["ea_mean"], round(r["ea_std"], 4)) for r in scoring.across_runs(df, ["s"], ["ea"]).collect()}
    assert got == {"m": (1.5, 0.7071), "k": (3.0, 0.0)}


def test_grammar(spark):
    rx = grammar.query_regex(["IfcWall", "IfcDoor", "IfcBuildingStorey"], ["Name", "FireRating", "IsExternal"], ["CONTAINS"], {"FireRating": ["EI30"]})
    good = [
        "MATCH (w:IfcWall) RETURN count(w)",
        "MATCH (s:IfcBuildingStorey)-[:CONTAINS]->(d:IfcDoor) WHERE s.Name = 'Level 1' RETURN s.Name, count(d) AS n ORDER BY n DESC LIMIT 1",
        "MATCH (d:IfcDoor) WHERE d.FireRating = 'EI30' AND NOT (d)-[:CONTAINS]->(:IfcWall) RETURN DISTINCT d.Name",
    ]
    bad = ["MATCH (w:IfcRoof) RETURN w", "MATCH (d:IfcDoor) WHERE d.FireRating = 'EI99' RETURN d", "DROP x", "MATCH (w:IfcWall) RETURN w LIMIT 0", ""]
    df = spark.createDataFrame([(q,) for q in good + bad], "q string").select(grammar.accepted(F.col("q"), rx).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True] * 3 + [False] * 5
    more = grammar.query_regex(["IfcWall", "IfcDoor"], ["Name", "Width"], [])
    forms = ["MATCH (w:IfcWall) RETURN COUNT(w)", "MATCH (w:IfcWall) WHERE w.Name contains 'x' and w.Width > 1 or w.Name IS NULL RETURN w", "MATCH (w:IfcWall) WHERE w.Name = TRUE RETURN w.Name AS _n", "MATCH (w:IfcWall) WHERE w.Name = null RETURN w", "MATCH (w:IfcWall)-[:DECOMPOSES]->(d:IfcDoor)\tRETURN d"]
    none = ["MATCH (w:IfcWall)-[:]->(d:IfcDoor) RETURN d", "MATCH (w:IfcWall)\nRETURN w", "MATCH (w:IfcWall)-[:FILLS]->(d:IfcDoor) RETURN d", "MATCH (w:) RETURN w"]
    df = spark.createDataFrame([(q,) for q in forms + none], "q string").select(grammar.accepted(F.col("q"), more).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True] * 5 + [False] * 4
    assert grammar.cleaned("```cypher\nMATCH (n)\nRETURN n;\n``` done") == "MATCH (n) RETURN n"


def test_prompts():
    text = prompts.system_prompt(prompts.Context("Node labels: A", {"A.x": ["1"]}, [{"question": "q", "query": "m"}]), "cypher_strict")
    assert "Known values" in text and "Examples" in text and "one of them" in text
    assert "Known values" not in prompts.system_prompt(prompts.Context("s"), "cypher_soft")
    assert prompts.truncated('[{"a": 1},{"b": 2},{"c": 3}]', 20) == '[{"a": 1},{"b": 2}]'


def test_bundle_round_trip(spark):
    e = spark.createDataFrame([("A", 1)], "entity string, n long")
    p = spark.createDataFrame([("x", "OPEN")], "property string, kind string")
    s = spark.createDataFrame([("A", "R", "B")], "src_label string, type string, dst_label string")
    back = sinks.read_bundle(sinks.bundle(e, p, s), "entity:string,n:bigint", "property:string,kind:string", "src_label:string,type:string,dst_label:string")
    assert back["entities"].collect() == e.collect() and back["signatures"].collect() == s.collect()


def test_result_rows(spark):
    df = spark.createDataFrame([("q", "x" * 900, ["b", "a"])], "question string, raw_output string, invalid_labels array<string>")
    row = sinks.result_rows(df).first()
    assert len(row["raw_output"]) == 500 and row["invalid_labels"] == "a,b" and row["svr"] is None and len(row) == 18


def test_values(spark):
    from pyspark.sql import types as T

    v = lambda x, t: values.value(F.lit(x), t)
    row = spark.range(1).select(
        values.equal(v("1", T.StringType()), v(1, T.LongType())).alias("a"),
        values.equal(v(1.0, T.DoubleType()), v(1, T.LongType())).alias("b"),
        values.less(v("1", T.StringType()), v(2, T.LongType())).alias("c"),
        values.to_integer(F.lit("3.7")).alias("d"),
        values.to_integer(F.lit("x")).alias("e"),
    ).first()
    assert tuple(row) == (False, True, None, 3, None)
