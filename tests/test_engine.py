import pytest
from pyspark.sql import functions as F

from propgraph.engine import Engine, Gold, Scripted
from propgraph.operators.match import match
from propgraph.sources.tables import trading_graph
from propgraph.streaming import rates


@pytest.fixture(scope="module")
def engine(spark, sf):
    queries = {
        "nations": lambda g: match(g, "n", "Nation").select("n"),
        "rich": lambda g: match(g, "c", "Customer").agg(F.count("c").alias("n")),
    }
    return Engine(trading_graph(spark, sf), queries)


def test_execute(engine):
    assert {r["token"] for r in engine.execute("nations").collect()} >= {"N:0", "N:24"}
    got = {r["index"]: (len(r["gold"]) > 0, r["error"]) for r in engine.gold(["rich", "nothing"]).collect()}
    assert got == {0: (True, None), 1: (False, "no query: nothing")}


def test_failing_queries_are_rows(engine, spark):
    """A query that cannot be planned, and one that fails as it runs, give no tokens and a message; the others go on."""
    engine.queries["unknown"] = lambda g: g.tables["Nation"].df.select("no_such_column")
    engine.queries["fails"] = lambda g: g.tables["Nation"].df.select(F.raise_error(F.lit("broken")).alias("x"))
    got = {r["index"]: (len(r["gold"]), r["error"]) for r in engine.gold(["unknown", "rich", "fails"]).collect()}
    assert got[1][0] > 0 and got[1][1] is None
    assert all(got[k][0] == 0 and got[k][1].startswith("execution_failed") for k in (0, 2))
    del engine.queries["unknown"], engine.queries["fails"]


def test_validate(engine, spark):
    q = spark.createDataFrame([("MATCH (c:Customer) RETURN count(c)",), ("MATCH (c:Planet) RETURN c",)], "query string")
    assert [r["valid"] for r in engine.validate(q).collect()] == [True, False]
    assert [r["scr"] for r in engine.compliance(q).collect()] == [1.0, 0.0]


def test_gold_scores_one(engine, spark):
    cases = engine.gold(["nations", "rich"])
    outputs = cases.select("index", F.lit(1.0).alias("svr"), F.lit(1.0).alias("scr"), F.col("gold").alias("tokens"))
    assert [r["ea"] for r in engine.evaluate(cases, outputs).collect()] == [1.0, 1.0]


def test_generators(engine):
    out = engine.run(["a", "b"], Gold({"a": "x"}), "cypher_soft")
    assert out[0]["output"] == "x" and out[1]["error"].startswith("generation_failed")
    assert engine.run(["a"], Scripted(["y"]), "direct_qa_baseline")[0]["output"] == "y"
    assert engine.health()


def test_stream_of_rates(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    typed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = rates.rates(typed, "user_id").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("rates").agg(F.sum("n")).first()[0]
    assert got == 6 * events.count()
    assert rates.within_rate(spark.table("rates"), 1, 1e9).count() >= 0


def test_scores_and_comparison_of_settings(engine, spark):
    made = spark.createDataFrame(
        [(0, "cypher_soft", "cypher", "MATCH (n:Nation) RETURN n.Name", ["a"]), (0, "direct_qa_baseline", "direct_qa", "no list", ["a"]), (1, "cypher_soft", "cypher", "MATCH (n:Planet) RETURN n.Name", None)],
        "index int, setting string, output_type string, output string, tokens array<string>",
    ).select("*", F.lit(None).cast("string").alias("difficulty"), F.lit("names").alias("category"))
    scored = engine.score(made)
    assert sorted((r["setting"], r["index"], r["svr"], r["scr"]) for r in scored.collect()) == [("cypher_soft", 0, 1.0, 1.0), ("cypher_soft", 1, 0.0, 0.5), ("direct_qa_baseline", 0, 0.0, 1.0)]
    cases = spark.createDataFrame([(0, ["a"]), (1, ["b"])], "index int, gold array<string>")
    means = {r["setting"]: (r["n"], r["ea_mean"], r["perfect"]) for r in engine.compare(cases, scored)["setting_results"].collect()}
    assert means == {"cypher_soft": (2, 0.5, 1), "direct_qa_baseline": (1, 0.0, 0)}


def test_one_output(engine):
    names = ["nations", "rich"]
    assert [r["ea"] for r in engine.evaluate_one('["x", "y"]', "direct_qa", gold_ids=["x"]).collect()] == [0.5]
    n = engine.gold_at(names, 1).first()["gold"][0].removeprefix("num:")
    assert [(r["index"], r["ea"]) for r in engine.evaluate_one(f"[{n}]", "direct_qa", names=names, index=1).collect()] == [(1, 1.0)]
    with pytest.raises(IndexError):
        engine.evaluate_one("[]", "direct_qa", names=names, index=2)
    with pytest.raises(ValueError, match="gold ids or"):
        engine.evaluate_one("[]", "direct_qa", gold_ids=["x"], names=names, index=0)


def test_whole_bundle_round_trip(engine, spark):
    from propgraph.operators import sinks, vocabulary

    stats = engine.vocabulary()
    document = (spark.createDataFrame([("Wall",)], "entity string"), spark.createDataFrame([("Name", "IFCLABEL", ["a"])], "property string, data_type string, choices array<string>"))
    v = vocabulary.merge_whole(document, None, spark.createDataFrame([("OWNS",)], "type string"), stats)
    choices = spark.createDataFrame([("Nation", "Name", ["b", "a"])], "label string, key string, choices array<string>")
    text = sinks.whole_bundle(v, {k: stats[k] for k in ("labels", "types")}, choices, [{"question": "q", "cypher": "MATCH (n) RETURN n"}], {"ifc_file": "m.ifc", "ids_file": None}, "/dump")
    schemas = {"entities": "entity:string,n:bigint,from_model:boolean,from_document:boolean", "relations": "type:string,n:bigint,in_vocabulary:boolean", "signatures": "src_label:string,type:string,dst_label:string"}
    frames, listed, examples, source = sinks.read_whole_bundle(text, schemas)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(frames["entities"]) == rows(v.entities) and rows(frames["signatures"]) == rows(v.signatures) and rows(frames["relations"]) == rows(v.relations)
    assert {r["type"]: r["in_vocabulary"] for r in v.relations.collect()}["OWNS"] and listed == {"Nation.Name": ["a", "b"]}
    assert examples == [{"question": "q", "cypher": "MATCH (n) RETURN n"}] and source["ifc_file"] == "m.ifc"
