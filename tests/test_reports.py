import json

from pyspark.sql import functions as F

from propgraph.operators import grammar, prompts, reports, schema, scoring, vocabulary
from propgraph.sources.settings import Settings, default_test_set

RESULTS = "setting string, difficulty string, category string, svr double, scr double, ea double, precision double, recall double, f1 double, gold array<string>"


def results(spark):
    return spark.createDataFrame(
        [
            ("cypher_soft", "Level 1", "count", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, ["num:5"]),
            ("cypher_soft", None, None, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, ["a", "b"]),
            ("direct_qa_baseline", "L1", "count", 1.0, 1.0, 0.5, 0.5, 0.5, 0.5, ["num:5"]),
        ],
        RESULTS,
    )


def test_comparison_is_one_object(spark):
    parts = reports.comparison(results(spark))
    got = json.loads(reports.comparison_json(parts, {"model": "m"}, "2020-01-01T00:00:00"))
    assert got["model_name"] == "m" and got["setting_results"]["cypher_soft"]["ea_mean"] == 0.5
    assert got["setting_matrix"]["direct_qa"]["baseline"]["n"] == 1 and got["setting_matrix"]["cypher"]["strict"] == {}
    assert got["complexity_results"]["cypher_soft"]["easy"]["perfect"] == 1 and got["category_results"]["cypher_soft"]["unknown"]["n"] == 1
    # equal accuracy: the order of the settings decides, not the name
    assert got["ranking"]["ea_mean"] == ["direct_qa_baseline", "cypher_soft"] and got["ranking"]["svr_mean"] == ["direct_qa_baseline", "cypher_soft"]
    assert [tuple(r) for r in reports.best(parts).collect()] == [("direct_qa_baseline", 0.5)]


def test_comparison_of_nothing(spark):
    parts = reports.comparison(spark.createDataFrame([], RESULTS))
    assert reports.best(parts).count() == 0 and json.loads(reports.comparison_json(parts, {}, "t"))["model_name"] == "unknown"


def test_ranking_by_name_without_an_order(spark):
    s = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "setting string, m double")
    assert [r["setting"] for r in scoring.ranking(s, "setting", ["m"]).orderBy("place").collect()] == ["c", "a", "b"]
    assert [r["setting"] for r in scoring.ranking(s, "setting", ["m"], ("b", "a")).orderBy("place").collect()] == ["c", "b", "a"]


def test_client_rows_without_scores(spark):
    schema_ = "svr double, scr double, ea double, precision double, recall double, f1 double, is_valid_syntax boolean, error string, num_gold_results int, difficulty string"
    rows = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, "late", 2, "Hard")], schema_)
    one = reports.client_summary(rows).first()
    assert (one["count"], one["ea_mean"], one["syntax_valid_count"], one["error_count"], one["non_trivial_count"], one["ea_mean_non_trivial"]) == (2, 0.5, 1, 1, 1, 1.0)
    assert {r["difficulty"] for r in reports.client_difficulties(rows).collect()} == {"unknown", "Hard"}
    assert reports.client_summary(rows.limit(0)).first()["count"] == 0


def test_syntax_by_output_type(spark):
    regex = grammar.query_regex(["Wall"], ["Name"], ["CONTAINS"])
    rows = spark.createDataFrame([("MATCH (n:Wall) RETURN n.Name", "cypher"), ("[1]", "cypher"), ("[1]", "direct_qa"), (None, "direct_qa"), (None, "cypher")], "o string, t string")
    got = [r[0] for r in rows.select(reports.syntax_validity(F.col("o"), F.col("t"), regex)).collect()]
    assert got == [1.0, 0.0, 1.0, 0.0, 0.0]


def test_gold_statistics_of_none(spark):
    empty = spark.createDataFrame([], "index int, gold array<string>")
    assert tuple(reports.gold_statistics(empty).first()) == (0, 0, 0)
    assert tuple(reports.gold_statistics(spark.createDataFrame([(0, None), (1, []), (2, ["a", "b"])], "index int, gold array<string>")).first()) == (3, 2, 1)


def test_property_sets(spark):
    props = spark.createDataFrame([("Wall", "Qto_Base", "Net Area"), ("Wall", "Pset_X", "id"), ("Wall", "Pset_X", "Fire-Rating"), ("Door", "Pset_X", "Fire-Rating")], "entity string, pset string, key string")
    got = {(r["pset"], r["quantity"]): r["properties"] for r in schema.property_sets(props).collect()}
    assert got == {("Qto_Base", True): ["Net_Area"], ("Pset_X", False): ["Fire_Rating"]}
    door = {(r["property"], r["quantity"]) for r in schema.entity_properties(props).where("entity = 'Door'").collect()}
    assert door == {("Fire_Rating", False)} | {(p, False) for p in schema.CORE}


def test_vocabulary_of_each_source(spark):
    document = (spark.createDataFrame([("Wall",)], "entity string"), spark.createDataFrame([("Width", "IfcReal", [])], "property string, data_type string, choices array<string>"))
    counts, keys = spark.createDataFrame([("Door", 3)], "label string, n long"), spark.createDataFrame([("Door", "Height")], "label string, key string")
    entities, properties = vocabulary.merge(document, None)
    assert [r["entity"] for r in entities.collect()] == ["Wall"] and [r["property"] for r in properties.collect()] == ["Width"]
    entities, properties = vocabulary.merge(document, None, (counts, keys))
    assert {r["entity"]: r["n"] for r in entities.collect()} == {"Wall": 0, "Door": 3}
    assert [r["property"] for r in properties.collect()] == ["Height"]


def test_prompts_of_settings():
    assert "no schema loaded" in prompts.choose("cypher_soft", None) and "  - Wall" in prompts.choose("cypher_strict", None, ["Wall"], ["Name"])
    assert "Schema:\nS" in prompts.choose("cypher_soft", prompts.Context("S"))
    assert prompts.choose("direct_qa_baseline", None, grounding="G") == prompts.choose("direct_qa_grounded", None) and prompts.choose("direct_qa_grounded", None, grounding="G").endswith("G")


def test_settings(tmp_path):
    s = Settings.of({"PROPGRAPH_MODEL_PATH": "  ", "PROPGRAPH_MODEL": "m", "PROPGRAPH_MAX_CONTEXT_CHARS": "12"})
    assert (s.model_path, s.model, s.max_context_chars) == (None, "m", 12)
    assert default_test_set(" ", str(tmp_path)) is None
    for name in ("test_set.json", "test_set.csv"):
        (tmp_path / name).write_text("x")
    assert default_test_set("missing", str(tmp_path)) == str(tmp_path / "test_set.csv")
    assert default_test_set(str(tmp_path / "test_set.json"), str(tmp_path)) == str(tmp_path / "test_set.json")


def test_json_rows(spark):
    row = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, DATE'2020-01-02' AS c, array(1.5D) AS d, CAST(2.50 AS DECIMAL(5,2)) AS e")
    assert json.loads(reports.json_rows(row).first()[0]) == {"a": 1, "b": None, "c": "2020-01-02", "d": [1.5], "e": "2.50"}
