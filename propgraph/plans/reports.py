"""Reports over scored outputs, and what a model's schema says."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.functions import tokens
from propgraph.operators import grammar, profile, reports, runs, schema, scoring, store, templates
from propgraph.operators.prompts import SETTINGS
from propgraph.plans.aggregation import EDGES
from propgraph.plans.model import ORACLES as MODEL
from propgraph.plans.scores import _RESULTS, _results
from propgraph.sources.tables import trading_graph as graph


def _nth(names: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as outputs of four settings, with levels by priority (some unknown) and categories by status."""
    level = F.substring_index("o_orderpriority", "-", 1)
    return _results(spark, sf).select(
        "*", _nth(SETTINGS, F.col("index") % 4).alias("setting"), F.when(F.col("index") % 4 < 2, reports.DIRECT).otherwise(reports.QUERY).alias("output_type"),
        F.when(level.isin("1", "2", "3"), level).when(level == "4", F.lit(" ")).alias("difficulty"), F.when(F.col("index") % 7 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("category"),
    )


def comparison_report(spark: SparkSession, sf: str) -> DataFrame:
    """Means by setting, by setting and level, by setting and category, one below the other."""
    return reports.grouped(_compared(spark, sf)).select("part", "setting", "level", "n", "valid", "perfect", F.round("ea_mean", 4).alias("ea"), F.round("f1_mean_non_trivial", 4).alias("f1"))


def comparison_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Settings by each metric; equal ones in the fixed order."""
    return reports.comparison(_compared(spark, sf))["ranking"]


def best_setting(spark: SparkSession, sf: str) -> DataFrame:
    return reports.best(reports.comparison(_compared(spark, sf))).select("setting", F.round("score", 4).alias("score"))


def means_by_output_type(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.by_output_type(_compared(spark, sf))
    return found.select("n", "valid", "perfect", *(F.round(c, 4).alias(c) for c in found.columns if c.endswith("_mean")))


def gold_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.gold_statistics(_results(spark, sf))


def _client(spark: SparkSession, sf: str) -> DataFrame:
    """Client rows: some without accuracy, with an empty or a real error, without or with mixed-case levels."""
    return _results(spark, sf).select(
        "svr", "scr", F.when(F.col("index") % 9 != 0, F.col("ea")).alias("ea"), "precision", "recall", "f1", (F.col("svr") > 0).alias("is_valid_syntax"), F.size("gold").alias("num_gold_results"),
        F.when(F.col("index") % 5 == 0, F.lit("timeout")).when(F.col("index") % 5 == 1, F.lit("")).alias("error"), _nth(("", "Easy", "easy"), F.col("index") % 3).alias("difficulty"),
    )


def client_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.client_summary(_client(spark, sf))
    return found.select(*(F.round(c, 4).alias(c) if "_mean" in c else c for c in found.columns))


def client_difficulties(spark: SparkSession, sf: str) -> DataFrame:
    return reports.client_difficulties(_client(spark, sf)).select("difficulty", F.col("count").alias("n"), F.round("ea_mean", 4).alias("ea"), F.round("f1_mean", 4).alias("f1"))


def setting_order(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of model and setting with the setting's fixed place; unknown settings come last."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    groups = o.groupBy(F.col("o_orderstatus").alias("model"), _nth((*SETTINGS, "other"), F.col("o_orderkey") % 5).alias("setting")).agg(F.count("*").alias("n"))
    return reports.in_group_order(groups).select("model", "setting", "n", reports.setting_place(F.col("setting")).alias("place"))


def svr_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Query texts by the grammar and direct answers as JSON lists; a direct answer complies always."""
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("k", F.col("o_orderkey") % 4)
    made = o.select("o_orderkey", _nth(("MATCH (n:Order) RETURN n.Name", '["a"]', "MATCH (n:Planet) RETURN n.Name", "none"), F.col("k")).alias("output"), _nth((reports.QUERY, reports.DIRECT), F.col("k") % 2).alias("kind"))
    regex = grammar.query_regex(["Order"], ["Name"], ["CONTAINS"])
    valid = [F.array(F.lit(x)) for x in ("order", "name")]
    return made.select("o_orderkey", reports.syntax_validity(F.col("output"), F.col("kind"), regex).alias("svr"), reports.compliance(F.col("output"), F.col("kind"), *valid).alias("scr"))


def _props(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as elements of a brand with keys in a property or a quantity set; some keys are internal."""
    pset = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Qto_").otherwise(F.lit("Pset_")), F.col("p_size").cast("string"))
    key = F.when(F.col("p_partkey") % 10 == 3, F.lit("OwnerHistory")).otherwise(F.concat(F.lit("Key "), (F.col("p_partkey") % 10).cast("string")))
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("entity"), pset.alias("pset"), key.alias("key"))


def property_sets(spark: SparkSession, sf: str) -> DataFrame:
    return schema.property_sets(_props(spark, sf)).select("pset", "quantity", F.array_join("properties", ",").alias("properties"))


def entity_properties(spark: SparkSession, sf: str) -> DataFrame:
    return schema.entity_properties(_props(spark, sf))


def class_relations(spark: SparkSession, sf: str) -> DataFrame:
    return schema.class_relations(graph(spark, sf)).select("leaf", F.array_join("relations", ",").alias("relations"))


def first_names(spark: SparkSession, sf: str) -> DataFrame:
    """The first region, nation and order (orders have no name), and a label that no node has."""
    return schema.first_names(graph(spark, sf), ["Region", "Nation", "Order", "Planet"])


def name_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and properties of the graph."""
    g = graph(spark, sf)
    return schema.label_names(g).select(F.lit("label").alias("kind"), F.col("label").alias("name")).unionAll(schema.property_names(g).select(F.lit("property"), "property"))


def first_choice(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return schema.first_choice(profile.enumerations(g), profile.label_counts(g))


def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON objects: a date is text, null stays."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return reports.json_rows(o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), (F.col("o_custkey") > 50).alias("late")))


def perfect_scores(spark: SparkSession, sf: str) -> DataFrame:
    """An output is perfect only if syntax, compliance and accuracy all are 1."""
    rows = _results(spark, sf).withColumn("scr", F.when(F.col("index") % 2 == 0, 0.5).otherwise(F.lit(1.0)))
    return scoring.summary(rows, ["o_orderstatus"]).select("o_orderstatus", "n", "perfect", F.round("scr_mean", 4).alias("scr"))


class Script:
    """A generator whose outputs follow from the question's number: some are right, some no list, some fail now and then or always."""

    def __init__(self) -> None:
        self.asked: dict[str, int] = {}

    def generate(self, question: str, setting: str, context: str) -> str:
        k = int(question.rsplit(" ", 1)[1])
        self.asked[question] = self.asked.get(question, 0) + 1
        if k % 7 == 0 or k % 7 == 1 and self.asked[question] < 3:
            raise RuntimeError(f"no answer to {k}")
        if setting == "cypher_soft":
            return f"Here it is:\n```\nMATCH (n:Nation)\n RETURN n.Name{k % 2};\n```"
        return "none" if k % 7 == 2 else f'The regions: ["{k % 5}", 99]'


def setting_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two settings over a question for each nation: asked in tasks, scored by type, with an error row where all attempts failed."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    cases = n.select(F.col("n_nationkey").cast("int").alias("index"), F.concat(F.lit("the region of nation "), F.col("n_nationkey")).alias("question"), F.array(tokens.integer(F.col("n_regionkey"))).alias("gold"), F.lit("1").alias("difficulty"))
    texts = spark.createDataFrame([("MATCH (n:Nation) RETURN n.Name0", ["num:0", "num:1"])], "output string, tokens array<string>")
    run = runs.Run(Script, store.scratch(spark), ("Nation",), ("Name0",), grammar.query_regex(["Nation"], ["Name0", "Name1"], []), texts)
    results = [runs.scored(cases, runs.answers(cases, run, s), run) for s in ("direct_qa_grounded", "cypher_soft")]
    rows = results[0].unionByName(results[1])
    return rows.select("index", "setting", "output_type", "svr", "scr", F.round("ea", 6).alias("ea"), "error", "num_generated_results", F.array_join("invalid_properties", ",").alias("invalid_properties"))


def few_shot_templates(spark: SparkSession, sf: str) -> DataFrame:
    """The templates' examples over the trading graph, each with what it gives: a count, a sum, a name or the nodes found."""
    g = graph(spark, sf)
    signatures = [("Nation", "CONTAINS", "Customer"), ("Nation", "CONTAINS", "Supplier"), ("Customer", "DECOMPOSES", "Order")]
    known = templates.Known({"Customer": 1, "Supplier": 1, "Nation": 1, "Order": 1, "Part": 0}, {("Customer", "c_mktsegment"): ["BUILDING"], ("Nation", "Name"): ["NATION_3"], ("Supplier", "s_none"): ["x"]}, signatures, {"Customer": ["c_acctbal"], "Supplier": ["s_none"]})
    domain = templates.Domain(("Part", "Customer"), ("Part", "Customer"), ("Order", "Customer"), ("Customer",), ("Supplier", "Customer"), "Nation", "Supplier", "suppliers")
    parts = []
    for e in templates.examples(g, known, domain):
        df = e.run(g)
        name = df.columns[0]
        found = F.count("*").cast("string") if name == "n" else F.max(F.round(F.col(f"`{name}`"), 2).cast("decimal(18,2)").cast("string") if name.startswith("sum") else F.col(f"`{name}`").cast("string"))
        parts.append(df.agg(found.alias("found")).select(F.lit(e.question).alias("question"), F.lit(e.text).alias("text"), "found"))
    return functools.reduce(DataFrame.unionAll, parts)


QUERIES = {
    f.__name__: f
    for f in (
        comparison_report, comparison_ranking, best_setting, means_by_output_type, gold_statistics, client_summary, client_difficulties, setting_order, svr_dispatch, property_sets, entity_properties,
        class_relations, first_names, name_lists, first_choice, json_rows, perfect_scores, setting_run, few_shot_templates,
    )
}


def _names(of: str, names: tuple[str, ...]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(names)) + " END"


#: The settings as files have them, written out, so that SQL would notice another name.
_WRITTEN = ("direct_qa_baseline", "direct_qa_grounded", "cypher_soft", "cypher_strict")
_SETTING = _names("index % 4", _WRITTEN)
_LEVEL = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'easy' WHEN '2' THEN 'medium' WHEN '3' THEN 'hard' ELSE 'unknown' END"
_CATEGORY = "CASE WHEN index % 7 = 0 THEN 'unknown' ELSE o_orderstatus END"


def _part(name: str, level: str) -> str:
    return f"""SELECT '{name}' AS part, {_SETTING} AS setting, {level} AS level, count(*) AS n, count(*) FILTER (svr > 0) AS valid, count(*) FILTER (svr = 1 AND ea = 1) AS perfect,
        round(avg(ea), 4) AS ea, round(coalesce(avg(f1) FILTER (gold IS NOT NULL), 0), 4) AS f1 FROM {_RESULTS} GROUP BY 1, 2, 3"""


_CLIENT_EA = "CASE WHEN index % 9 = 0 THEN 0 ELSE ea END"
_SCORES = {"svr": "svr", "scr": "1::DOUBLE", "ea": _CLIENT_EA, "precision": "p", "recall": "r", "f1": "f1"}
_PROPS = "(SELECT p_brand AS entity, CASE p_partkey % 2 WHEN 0 THEN 'Qto_' ELSE 'Pset_' END || p_size AS pset, 'Key_' || p_partkey % 10 AS property FROM part WHERE p_partkey % 10 <> 3)"

ORACLES = {
    "comparison_report": f"{_part('all', chr(39) * 2)} UNION ALL {_part('difficulty', _LEVEL)} UNION ALL {_part('category', _CATEGORY)}",
    "comparison_ranking": f"""WITH s AS (SELECT index % 4 AS k, avg(ea) AS ea_mean, avg(svr) AS svr_mean, 1::DOUBLE AS scr_mean, avg(f1) AS f1_mean FROM {_RESULTS} GROUP BY 1),
        u AS (UNPIVOT s ON ea_mean, svr_mean, scr_mean, f1_mean INTO NAME metric VALUE score)
        SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY score DESC, k)::INT AS place, {_names("k", _WRITTEN)} AS setting FROM u""",
    "best_setting": f"SELECT {_SETTING} AS setting, round(avg(ea), 4) AS score FROM {_RESULTS} GROUP BY 1 ORDER BY avg(ea) DESC LIMIT 1",
    "means_by_output_type": f"""SELECT count(*) AS n, count(*) FILTER (svr > 0) AS valid, count(*) FILTER (svr = 1 AND ea = 1) AS perfect, round(avg(svr) FILTER (index % 4 > 1), 4) AS cypher_svr_mean, 1::DOUBLE AS cypher_scr_mean,
        round(avg(ea) FILTER (index % 4 > 1), 4) AS cypher_ea_mean, round(avg(svr) FILTER (index % 4 < 2), 4) AS direct_qa_svr_mean, round(avg(ea) FILTER (index % 4 < 2), 4) AS direct_qa_ea_mean FROM {_RESULTS}""",
    "gold_statistics": f"SELECT count(*) AS cases, coalesce(sum(size), 0)::BIGINT AS tokens, count(gold) AS non_empty FROM {_RESULTS}",
    "client_summary": f"""SELECT count(*) AS count, {", ".join(f"round(avg({x}), 4) AS {m}_mean" for m, x in _SCORES.items())}, count(*) FILTER (svr > 0) AS syntax_valid_count, count(*) FILTER (index % 5 = 0) AS error_count,
        count(gold) AS non_trivial_count, {", ".join(f"round(coalesce(avg({x}) FILTER (gold IS NOT NULL), 0), 4) AS {m}_mean_non_trivial" for m, x in _SCORES.items() if m not in ("svr", "scr"))} FROM {_RESULTS}""",
    "client_difficulties": f"SELECT {_names('index % 3', ('unknown', 'Easy', 'easy'))} AS difficulty, count(*) AS n, round(avg({_CLIENT_EA}), 4) AS ea, round(avg(f1), 4) AS f1 FROM {_RESULTS} GROUP BY 1",
    "setting_order": f"""SELECT o_orderstatus AS model, {_names("o_orderkey % 5", (*_WRITTEN, "other"))} AS setting, count(*) AS n, CASE WHEN o_orderkey % 5 = 4 THEN 99 ELSE (o_orderkey % 5)::INT END AS place
        FROM orders GROUP BY model, setting, place""",
    "svr_dispatch": "SELECT o_orderkey, (o_orderkey % 4 < 2)::INT::DOUBLE AS svr, CASE WHEN o_orderkey % 4 = 2 THEN 0.5 ELSE 1 END::DOUBLE AS scr FROM orders",
    "property_sets": f"SELECT pset, pset LIKE 'Qto%' AS quantity, string_agg(DISTINCT property, ',' ORDER BY property) AS properties FROM {_PROPS} GROUP BY 1",
    "entity_properties": f"""SELECT DISTINCT entity, property, pset LIKE 'Qto%' AS quantity FROM {_PROPS} UNION ALL
        SELECT DISTINCT p_brand, unnest(['GlobalId', 'Name', 'Description', 'ObjectType', 'Tag', 'LongName', 'Phase', 'PredefinedType']), false FROM part""",
    "class_relations": f"""SELECT leaf, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM (
        SELECT sl AS leaf, type AS relation FROM {EDGES} WHERE type IN ('CONTAINS', 'DECOMPOSES', 'HAS_OPENING', 'FILLS')
        UNION ALL SELECT dl, CASE type WHEN 'CONTAINS' THEN 'CONTAINED_IN' ELSE 'DECOMPOSED_BY' END FROM {EDGES} WHERE type IN ('CONTAINS', 'DECOMPOSES')) GROUP BY 1""",
    "first_names": """SELECT 'Region' AS label, arg_min(r_name, 'R:' || r_regionkey) AS name FROM region UNION ALL SELECT 'Nation', arg_min(n_name, 'N:' || n_nationkey) FROM nation
        UNION ALL SELECT 'Order', NULL UNION ALL SELECT 'Planet', NULL""",
    "name_lists": f"SELECT 'label' AS kind, label AS name FROM ({MODEL['label_counts']}) UNION ALL SELECT DISTINCT 'property', key FROM ({MODEL['known_keys']})",
    "first_choice": f"SELECT key, min(label) AS label, arg_min(split_part(choices, '|', 1), label) AS value FROM ({MODEL['value_enumerations']}) GROUP BY 1",
    "json_rows": """SELECT '{"o_orderkey":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","status":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END
        || ',"late":' || (o_custkey > 50)::VARCHAR || '}' AS json FROM orders""",
    "perfect_scores": f"SELECT o_orderstatus, count(*) AS n, count(*) FILTER (svr = 1 AND ea = 1 AND index % 2 = 1) AS perfect, round(avg(CASE index % 2 WHEN 0 THEN 0.5 ELSE 1 END), 4) AS scr FROM {_RESULTS} GROUP BY 1",
    "setting_run": """WITH c AS (SELECT n_nationkey::INT AS index, n_regionkey AS r, n_nationkey % 7 AS k, n_nationkey % 5 AS said FROM nation), e AS (SELECT *, CASE WHEN k = 0 THEN 'Generation failed: no answer to ' || index END AS error FROM c)
        SELECT index, 'direct_qa_grounded' AS setting, 'direct_qa' AS output_type, CASE WHEN k IN (0, 2) THEN 0 ELSE 1 END::DOUBLE AS svr, CASE WHEN k = 0 THEN 0 ELSE 1 END::DOUBLE AS scr,
          CASE WHEN k IN (0, 2) OR said <> r THEN 0 ELSE 0.5 END::DOUBLE AS ea, error, CASE WHEN k IN (0, 2) THEN 0 ELSE 2 END AS num_generated_results, NULL AS invalid_properties FROM e
        UNION ALL SELECT index, 'cypher_soft', 'cypher', CASE WHEN k = 0 THEN 0 ELSE 1 END, CASE WHEN k = 0 THEN 0 WHEN index % 2 = 1 THEN 0.5 ELSE 1 END,
          CASE WHEN k = 0 OR index % 2 = 1 OR r > 1 THEN 0 ELSE 0.5 END, error, CASE WHEN k = 0 OR index % 2 = 1 THEN 0 ELSE 2 END, CASE WHEN k = 0 THEN NULL WHEN index % 2 = 1 THEN 'Name1' ELSE '' END FROM e""",
    "few_shot_templates": """SELECT 'How many customer elements are in the model?' AS question, 'MATCH (n:Customer) RETURN count(n)' AS text, count(*)::VARCHAR AS found FROM customer
        UNION ALL SELECT 'Find customer elements where c_mktsegment is ''BUILDING''', 'MATCH (n:Customer) WHERE n.c_mktsegment = ''BUILDING'' RETURN n', count(*)::VARCHAR FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT 'How many customer elements are on ''NATION_3''?', 'MATCH (s:Nation)-[:CONTAINS]->(d:Customer) WHERE s.Name = ''NATION_3'' RETURN count(d)', count(*)::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'
        UNION ALL SELECT 'How many suppliers are on ''NATION_3''?', 'MATCH (s:Nation)-[:CONTAINS]->(sp:Supplier) WHERE s.Name = ''NATION_3'' RETURN count(sp)', count(*)::VARCHAR FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3'
        UNION ALL SELECT 'What is the total c_acctbal of all customer elements?', 'MATCH (n:Customer) RETURN sum(n.c_acctbal)', sum(c_acctbal)::DECIMAL(18,2)::VARCHAR FROM customer""",
}
