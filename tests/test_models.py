"""Types' properties, listed values, a model's schema from its records, dumps, tables of runs."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from propgraph.functions import values
from propgraph.operators import etl, meetings, profile, schema, scoring, sinks
from propgraph.sources import documents, step


def gid(k):
    return f"{k:022d}"


ROWS = [
    (1, "IFCWALLTYPE", [f"'{gid(1)}'", "$", "'T'", "$", "$", "(#10,#11)", "$", "$", "$", ".STANDARD."]),
    (2, "IFCWALL", [f"'{gid(2)}'", "$", "'W'", "$", "$", "$", "$", "$"]),
    (3, "IFCWALL", [f"'{gid(3)}'", "$", "$", "'bare'", "$", "$", "$", "$"]),
    (4, "IFCPROJECT", [f"'{gid(4)}'", "$", "'Proj'", "$", "$", "$", "$", "$", "$"]),
    (5, "IFCRELDEFINESBYTYPE", [f"'{gid(5)}'", "$", "$", "$", "(#2)", "#1"]),
    (6, "IFCRELDEFINESBYPROPERTIES", [f"'{gid(6)}'", "$", "$", "$", "(#2)", "#12"]),
    (10, "IFCPROPERTYSET", [f"'{gid(10)}'", "$", "'P'", "$", "(#20,#21)"]),
    (11, "IFCELEMENTQUANTITY", [f"'{gid(11)}'", "$", "'Qto_P'", "$", "$", "(#22)"]),
    (12, "IFCPROPERTYSET", [f"'{gid(12)}'", "$", "'P'", "$", "(#23,#24,#25,#26)"]),
    (20, "IFCPROPERTYSINGLEVALUE", ["'Color'", "$", "IFCLABEL('red')", "$"]),
    (21, "IFCPROPERTYSINGLEVALUE", ["'Only Type'", "$", "IFCINTEGER(7)", "$"]),
    (22, "IFCQUANTITYAREA", ["'Area'", "$", "$", "12.", "$"]),
    (23, "IFCPROPERTYSINGLEVALUE", ["'Color'", "$", "IFCLABEL('blue')", "$"]),
    (24, "IFCPROPERTYENUMERATEDVALUE", ["'Status'", "$", "(IFCLABEL('NEW'),IFCLABEL('a, (b)'))", "$"]),
    (25, "IFCPROPERTYSINGLEVALUE", ["'Name'", "$", "IFCLABEL('own \"name\"')", "$"]),
    (26, "IFCPROPERTYLISTVALUE", ["'None'", "$", "($,$)", "$"]),
]


def records(spark):
    return spark.createDataFrame([("f", *r) for r in ROWS], "file string, id long, class string, args array<string>")


def test_an_element_has_its_types_properties(spark):
    rows = {(int(r["element"]), r["key"]): r["value"] for r in etl.flatten_properties(step.property_rows(records(spark))).collect()}
    assert rows == {
        (1, "Color"): "red", (1, "Only_Type"): "7", (1, "Area"): "12.", (2, "Color"): "blue", (2, "Only_Type"): "7", (2, "Area"): "12.", (2, "Status"): '["NEW", "a, (b)"]', (2, "Name"): 'own "name"',
    }
    assert {int(r["element"]) for r in step.property_rows(records(spark), inherit=False).collect()} == {2}


def test_lists_of_one_type(spark):
    cases = [(["1", "2"], "[1, 2]"), (["1", "true"], "[1, true]"), (["true", "1"], '["True", "1"]'), (["1", "2.0"], '["1", "2.0"]'), (['"a\\"b"', None], '["a\\"b"]'), ([None], None), ([], None), (None, None)]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, l array<string>")
    assert [r["x"] for r in df.select("k", values.coerced_list(F.transform("l", values.item)).alias("x")).orderBy("k").collect()] == [w for _, w in cases]


def test_schema_of_a_model(spark):
    found = {name: sorted(map(tuple, df.collect()), key=str) for name, df in schema.scanned(records(spark)).items()}
    assert found["entities"] == [("IfcWall", 2)] and found["info"] == [("f", "IfcProject", "Proj")]
    own = {p for e, p, q in found["properties"] if e == "IfcWall" and not q} - set(schema.CORE)
    assert own == {"Color", "Only_Type", "Status", "None"} and ("IfcWall", "Area", True) in found["properties"]
    assert found["sets"] == [("P", False, ["Color", "Name", "None", "Only_Type", "Status"]), ("Qto_P", True, ["Area"])] and ("Area", True) in found["all_properties"]
    nothing = {name: df.count() for name, df in schema.scanned(records(spark).where("id < 0")).items()}
    assert nothing == {"entities": 0, "properties": 0, "sets": 0, "all_properties": len(schema.CORE), "relations": 0, "info": 0}


def test_dump_of_products(spark, tmp_path):
    made = etl.products(records(spark))
    path = str(tmp_path / "dump")
    sinks.write_array(made, ["file", "id"], path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "dump").glob("part-*")))
    want = [{"GlobalId": gid(2), "type": "IfcWall", "Name": 'own "name"', "Color": "blue", "Status": ["NEW", "a, (b)"]}, {"GlobalId": gid(3), "type": "IfcWall", "Description": "bare"}]
    assert json.loads(text) == want and [json.loads(r["json"]) for r in sinks.read_array(spark, path).collect()] == want
    assert etl.products(records(spark), limit=1).count() == 1
    sinks.write_array(made.where("id < 0"), ["file", "id"], path)
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "dump").glob("part-*")))) == [] and sinks.read_array(spark, path).count() == 0
    sinks.write_array(made, ["file", "id"], path, files=1)
    assert documents.dump(spark, path).count() == 2


def test_tables_of_runs(spark):
    rows = [("m", "cypher_soft", "", 1, 0.5, 1.0, 0.125), ("m", "cypher_soft", "", 2, 1.0, 1.0, 0.375), ("m", "direct_qa_baseline", "", 1, 1.0, None, 0.0), ("m", "own", "", 1, 1.0, 1.0, 1.0)]
    runs = spark.createDataFrame(rows, "model string, setting string, difficulty string, run int, svr_mean double, scr_mean double, ea_mean double")
    shown = {(r["setting"], r["metric"]): (r["values"], r["shown"]) for r in scoring.run_table(runs).collect()}
    assert shown["cypher_soft", "SVR"] == ("0.5000, 1.0000", "0.75 ± 0.35") and shown["cypher_soft", "SCR"] == ("1.0000, 1.0000", "1.00") and ("direct_qa_baseline", "SCR") not in shown
    lines = [r["line"] for r in scoring.latex_rows(runs.fillna(0.0)).orderBy("model", "place", "setting").collect()]
    assert lines == ["\\textit{m}", "  & S1 (Naive QA) & 1.00 & 0.00 & 0.00 \\\\", "  & S3 (Soft Cypher) & $0.75 \\pm 0.35$ & 1.00 & $0.25 \\pm 0.18$ \\\\", "  & own & 1.00 & 1.00 & 1.00 \\\\", "\\hline"]


def counted(spark, df):
    """df, and a count of the rows that are computed of it."""
    n = spark.sparkContext.accumulator(0)
    first = df.columns[0]

    @F.udf(dict(df.dtypes)[first])
    def seen(x):
        n.add(1)
        return x

    return df.withColumn(first, seen(F.col(first))), n


def test_rows_of_an_array_are_computed_once(spark, tmp_path):
    rows, n = counted(spark, spark.range(40).select("id", F.format_string('{"a": %d}', "id").alias("json")))
    sinks.write_array(rows, ["id"], str(tmp_path / "dump"))
    assert n.value == 40 and sinks.read_array(spark, str(tmp_path / "dump")).count() == 40


def test_properties_are_computed_once_before_they_are_numbered(spark):
    names = ["Flag", "Flag 1", "Flag", "id", "Other"]
    made = spark.createDataFrame([(f"e{e}", "s", name, str(k), k) for e in range(5) for k, name in enumerate(names)], "element string, pset string, name string, value string, position int")
    rows, n = counted(spark, made)
    found = etl.flatten_properties(rows)
    assert {(r["key"], r["value"]) for r in found.where("element = 'e3'").collect()} == {("Flag", "0"), ("Flag_1", "1"), ("Flag_2", "2"), ("Other", "4")}
    assert found.count() == 20 and n.value == 20  # "id" goes first


def test_names_of_a_query_are_sought_once(spark):
    query = F.concat(F.lit("MATCH (a:Wall:Lost) WHERE a.x = 'b.c' RETURN a.Name, "), F.col("id").cast("string"))
    made = spark.range(3).select(scoring.schema_compliance(query, F.array(F.lit("wall")), F.array(F.lit("name")), mask=True).alias("s")).select("s.*")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert [tuple(r) for r in made.collect()] == [(0.5, ["Lost"], ["x"])] * 3


def test_properties_of_wanted_elements(spark):
    wanted = spark.createDataFrame([(gid(1),)], "node_id string")
    assert {int(r["element"]) for r in step.property_rows(records(spark), wanted=wanted).collect()} == {1}


def test_a_schema_keeps_names_and_not_elements(spark):
    many = [("f", k, "IFCWALL", [f"'{gid(k)}'", "$", "$", "$", "$", "$", "$", "$"]) for k in range(100, 160)] + [("f", 6000 + k, "IFCRELDEFINESBYPROPERTIES", [f"'{gid(6000 + k)}'", "$", "$", "$", f"(#{k})", "#12"]) for k in range(100, 160)]
    recs = records(spark).unionAll(spark.createDataFrame(many, "file string, id long, class string, args array<string>"))
    found = schema.scanned(recs)
    assert found["entities"].collect()[0]["n"] == 62 and found["sets"].count() == 2
    plan = found["properties"]._jdf.queryExecution().optimizedPlan().toString()
    assert "RELDEFINES" not in plan and "RELDEFINES" in found["relations"]._jdf.queryExecution().optimizedPlan().toString()


def test_shared_neighbours_are_dealt_by_how_many_meet(spark):
    rows = [(f"s{k * 7 % 23}", f"t{k % 5}") for k in range(60)] + [("s1", "t1"), (None, "t1"), ("s2", None)]
    edges = spark.createDataFrame(rows, "src string, dst string")
    of = {}
    for s, t in rows:
        if s and t:
            of.setdefault(t, set()).add(s)
    want = {(a, b) for group in of.values() for a in group for b in group if a < b}
    for block, pairs in ((1024, 1 << 20), (3, 40), (1, 1)):
        found = profile.shared_neighbours(edges, block, pairs)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_shared_neighbours_send_each_pair_once_and_not_what_meets(spark):
    """Few sources that meet at many targets: what is written between tasks stays below a byte for each pair that meets."""

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        own = context.statusStore().executorList(False)
        return sum(own.apply(k).totalShuffleWrite() for k in range(own.size()))

    draw = random.Random(4)
    of = {t: draw.sample(range(80), 60) for t in range(600)}
    edges = spark.createDataFrame([(f"s{s}", f"t{t}") for t, own in of.items() for s in own], "src string, dst string")
    before = written()
    found = profile.shared_neighbours(edges).collect()
    sent = written() - before
    assert 0 < sent < len(of) * 60 * 59 / 2
    assert sorted(map(tuple, found)) == sorted((a, b) for a in (f"s{k}" for k in range(80)) for b in (f"s{k}" for k in range(80)) if a < b)


def test_shared_neighbours_in_ranges_with_names_joined(spark, monkeypatch):
    """Many tasks that find, names too many to broadcast, targets cut in blocks, edges that repeat."""
    monkeypatch.setattr(profile, "NAMES", 0)
    draw = random.Random(5)
    rows = [(f"s{draw.randrange(150)}", f"t{draw.randrange(40)}") for _ in range(500)] + [(None, "t1"), ("s2", None)]
    of = {}
    for s, t in rows:
        if s and t:
            of.setdefault(t, set()).add(s)
    want = {(a, b) for group in of.values() for a in group for b in group if a < b}
    for block, ahead in ((1024, 500), (4, 500), (4, 1 << 20)):
        found = profile.shared_neighbours(spark.createDataFrame(rows * 2, "src string, dst string"), block, 2000, ahead)
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_lists_that_begin_alike_are_dealt_to_many_tasks(spark):
    lists = spark.createDataFrame([([1, 2, 3],)] * 400, "ids array<int>")
    for block, n in ((8, 400), (2, 1200)):
        sizes = [r["count"] for r in profile._dealt(lists, block, 8).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and len(sizes) > 4 and max(sizes) < n / 2


def test_pairs_met_beyond_what_is_held(monkeypatch):
    draw = random.Random(6)
    lists = sorted(sorted(draw.sample(range(at, at + 30), draw.choice((1, 2, 12)))) for at in range(0, 400, 4) for _ in range(3))
    cuts = [draw.choice((0, len(x) // 2)) for x in lists]
    want = {(x, y) for own, cut in zip(lists, cuts, strict=True) for i, x in enumerate(own) for k, y in enumerate(own) if k > i and (not cut or i < cut <= k)}
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[k : k + 50], pa.list_(pa.int32())), pa.array(cuts[k : k + 50], pa.int32())], names=["ids", "cut"]) for k in range(0, 300, 50)]
    for held, once in ((1 << 20, True), (2000, True), (40, False)):
        monkeypatch.setattr(meetings, "AT_ONCE", 100)
        monkeypatch.setattr(meetings, "HELD", held)
        got = [(r["x"], y) for batch in meetings.meet(iter(batches)) for r in batch.to_pylist() for y in r["ys"]]
        assert set(got) == want and (not once or len(got) == len(want))
    assert list(meetings.meet(iter([]))) == []
