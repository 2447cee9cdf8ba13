"""Files of results, summaries and test cases, written from the tables and read again; names, tokens and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.engine import Engine
from propgraph.functions import names, values
from propgraph.operators import etl, grammar, scoring, sinks, store
from propgraph.operators.match import match
from propgraph.operators.prompts import SETTINGS
from propgraph.plans.scores import _RESULTS, _results
from propgraph.sources import documents
from propgraph.sources.tables import trading_graph as graph


def _nth(names_of: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names_of)), (k + 1).cast("int"))


def _result_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Scored orders with questions over two lines, quotes, long outputs and lists of names."""
    long = F.concat(F.lit('said "'), F.col("o_orderstatus"), F.lit('"\n'), F.repeat(F.lit("x"), (F.col("index") % 3 * 400).cast("int")))
    return _results(spark, sf).select(
        "index", F.concat(F.lit("order, "), F.col("index"), F.lit("\nof status \""), "o_orderstatus", F.lit("\"?")).alias("question"), _nth(SETTINGS, F.col("index") % 4).alias("experiment_setting"), long.alias("raw_output"),
        "svr", "scr", "ea", "precision", "recall", "f1", F.array(F.lit("Zone"), "o_orderstatus", F.lit("Area")).alias("invalid_labels"), F.size("gold").alias("num_gold_results"), F.col("o_orderpriority").alias("difficulty"), F.col("o_orderstatus").alias("model"),
    )


def results_file(spark: SparkSession, sf: str) -> DataFrame:
    """A results file as it is read again: raw output is cut, names are sorted, what was not given is empty."""
    path = store.scratch(spark)
    sinks.write_results(_result_rows(spark, sf), path)
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return read.select("question", "experiment_setting", F.length("raw_output").alias("characters"), F.substring("raw_output", 1, 10).alias("begins"), F.round(F.col("ea").cast("double"), 6).alias("ea"), F.round(F.col("f1").cast("double"), 6).alias("f1"), "invalid_labels", "error", F.col("num_gold_results").cast("int").alias("gold"))


def client_file(spark: SparkSession, sf: str) -> DataFrame:
    """A client's file: its columns in their places, and how many rows have each."""
    path = store.scratch(spark)
    sinks.write_results(_result_rows(spark, sf), path, sinks.CLIENT_COLUMNS)
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return read.agg(*(F.count(f"`{c}`").alias(c) for c in read.columns)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(k).alias("place"), F.col(f"`{c}`").alias("n")) for k, c in enumerate(read.columns)))))


def summary_files(spark: SparkSession, sf: str) -> DataFrame:
    """A summary file for each of three settings, read as one table of runs; a file without a model is left out."""
    path, rows = store.scratch(spark), _result_rows(spark, sf)
    for k, setting in enumerate((*SETTINGS[:3], "none")):
        own = rows.where(F.col("index") % 4 == k).agg(F.count("*").alias("n"), F.avg("ea").alias("ea_mean"), F.avg("svr").alias("svr_mean"))
        sinks.write_summary(own, {"setting": setting} if setting == "none" else {"model": "m", "setting": setting}, f"{path}/{setting}")
    found = documents.summaries(spark, f"{path}/*")
    return found.select("model", "setting", F.col("metrics")["n"].cast("long").alias("n"), F.round(F.col("metrics")["ea_mean"], 6).alias("ea"), F.round(F.col("metrics")["svr_mean"], 6).alias("svr"))


def test_set_files(spark: SparkSession, sf: str) -> DataFrame:
    """The nations' questions as a CSV file with other names of the fields, and as a JSON object with cases; blank questions go."""
    n = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").coalesce(1)
    asked = F.when(F.col("n_nationkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Who trades, \"really\", in "), "n_name", F.lit("?")))
    path = store.scratch(spark)
    n.select(asked.alias("NL Query"), F.concat(F.lit("MATCH (n) RETURN "), F.col("n_nationkey")).alias(" Cypher"), F.col("n_regionkey").alias("Difficulty")).write.option("header", True).option("escape", '"').csv(f"{path}/set.csv")
    cases = n.select(asked.alias("question"), F.lit("x").alias("expected_cypher"), F.col("n_name").alias("category"))
    cases.agg(F.to_json(F.struct(F.collect_list(F.struct(*cases.columns)).alias("cases"))).alias("value")).write.text(f"{path}/set.json")
    both = [documents.test_set(spark, f"{path}/{name}").select(F.lit(name).alias("file"), "*") for name in ("set.csv", "set.json")]
    return both[0].unionByName(both[1])


def latex_table(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses as models with three runs of each setting: the lines of a table, in order by model, place and setting."""
    return scoring.latex_rows(_table_runs(spark, sf))


def run_table(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.run_table(_table_runs(spark, sf), ("model", "setting"))


def _table_runs(spark: SparkSession, sf: str) -> DataFrame:
    setting = _nth((*SETTINGS, "other"), F.col("index") % 5)
    rows = _results(spark, sf).groupBy(F.col("o_orderstatus").alias("model"), setting.alias("setting"), F.pmod(F.floor(F.col("index") / 5), F.lit(3)).alias("run"))
    return rows.agg(F.avg("svr").alias("svr_mean"), F.avg("scr").alias("scr_mean"), F.avg(F.col("ea") * 0.97).alias("ea_mean"))


def merged_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Base attributes with property sets over them: a set's value wins, null attributes go."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    base = F.create_map(F.lit("Name"), F.col("c_name"), F.lit("Description"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit("ObjectType"), F.lit("own"))
    sets = F.when(F.col("c_custkey") % 3 != 0, F.create_map(F.lit("ObjectType"), F.lit("set"), F.lit("Phase"), F.col("c_nationkey").cast("string")))
    pairs = F.array_sort(F.transform(F.map_entries(etl.merged(base, sets)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return c.select("c_custkey", F.array_join(pairs, ",").alias("props"))


def coerced_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of a whole number, a decimal, a boolean or a text beside another: of one type as they are, else all texts."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    number = F.col("p_size").cast("string")
    other = F.when(F.col("p_partkey") % 5 == 0, number).when(F.col("p_partkey") % 5 == 1, "2.5").when(F.col("p_partkey") % 5 == 2, "true").when(F.col("p_partkey") % 5 == 3, values.json_text(F.col("p_brand")))
    items = F.when(F.col("p_partkey") % 7 == 0, F.array(other)).when(F.col("p_partkey") % 7 == 1, F.array(other, number)).otherwise(F.array(number, other))
    return p.select("p_partkey", values.coerced_list(F.transform(items, values.item)).alias("list"))


def class_names(spark: SparkSession, sf: str) -> DataFrame:
    """Upper-case class names in their proper case, by a map of some, and names made fit for files."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    raw = _nth(("IFCWALLSTANDARDCASE", "IFCDOOR", "ifcrooftop", "Other"), F.col("p_partkey") % 4)
    known = F.create_map(F.lit("IFCWALLSTANDARDCASE"), F.lit("IfcWallStandardCase"))
    return p.select("p_partkey", names.class_case(raw, known).alias("class"), names.file_safe(F.concat_ws("/", "p_brand", F.lit("a:b c\\d"), F.repeat(F.col("p_type"), 3))).alias("file"))


def cleaned_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Query texts out of prose and fences, over several lines, or as they stand."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    forms = ["Sure:\n```cypher\nMATCH (o)\n  WHERE o.x = {0}\nRETURN o.y;\n```\nDone.", "`match (o) return {0}` and more", "no query {0} ;", "MATCH (a)  RETURN {0}\nLIMIT 5"]
    text = F.replace(_nth(tuple(forms), F.col("o_orderkey") % 4), F.lit("{0}"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", grammar.cleaned_column(text).alias("query"))


def gold_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Named queries run for their tokens: an id for a node, numbers marked, records joined; a failing or missing one has none and a message."""

    def by_nation(g: object) -> DataFrame:
        return match(g, "n", "Nation").hop("CONTAINS", "c", "Customer").groupBy(F.col("n.Name").alias("name")).agg(F.count("c").alias("n"), F.min("c.c_acctbal").alias("least"))

    queries = {
        "nodes": lambda g: match(g, "n", "Region").df.select(F.col("n")),
        "rows": by_nation,
        "fails": lambda g: match(g, "n", "Region").df.select("n.nothing"),
    }
    engine = Engine(graph(spark, sf), queries)
    made = engine.gold(["nodes", "rows", "fails", "missing"])
    shown = made.select("index", F.explode_outer("gold").alias("t"), F.split("error", "[:_]")[0].alias("error"))
    return shown.select("index", F.replace("t", F.lit("\x1e"), F.lit("~")).alias("token"), "error")


def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Part names, in order, that fit a context of 5000 tokens."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 6 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    return documents.within_budget(p, ["p_partkey"], "text", 5000)


QUERIES = {
    f.__name__: f
    for f in (
        results_file, client_file, summary_files, test_set_files, latex_table, run_table, merged_attributes, coerced_lists, class_names, cleaned_queries, gold_tokens, context_budget,
    )
}

_WRITTEN = ("direct_qa_baseline", "direct_qa_grounded", "cypher_soft", "cypher_strict")
_SHOWN = ("S1 (Naive QA)", "S2 (Grounded QA)", "S3 (Soft Cypher)", "S4 (Strict Cypher)", "other")


def _named(of: str, given: tuple[str, ...]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(given)) + " END"


_COLUMNS = (
    "index", "question", "experiment_setting", "output_type", "generated_cypher", "gold_cypher", "raw_output", "svr", "scr", "ea", "is_valid_syntax", "invalid_labels", "invalid_properties", "num_generated_results", "num_gold_results",
    "precision", "recall", "f1", "error", "category", "difficulty", "model",
)
_ABSENT = ("output_type", "generated_cypher", "gold_cypher", "is_valid_syntax", "invalid_properties", "num_generated_results", "error", "category")
_RUNS = f"(SELECT o_orderstatus AS model, index % 5 AS k, index // 5 % 3 AS run, avg(svr) AS svr, 1::DOUBLE AS scr, avg(ea * 0.97) AS ea FROM {_RESULTS} GROUP BY 1, 2, 3)"


def _stat(metric: str, latex: bool) -> str:
    mean, std = f"printf('%.2f', avg({metric}))", f"coalesce(stddev_samp({metric}), 0)"
    both = f"'$' || {mean} || ' \\pm ' || printf('%.2f', {std}) || '$'" if latex else f"{mean} || ' ± ' || printf('%.2f', {std})"
    return f"CASE WHEN {std} = 0 THEN {mean} ELSE {both} END"


ORACLES = {
    "results_file": f"""SELECT 'order, ' || index || chr(10) || 'of status "' || o_orderstatus || '"?' AS question, {_named("index % 4", _WRITTEN)} AS experiment_setting, least(500, 9 + index % 3 * 400)::INT AS characters,
        left('said "' || o_orderstatus || '"' || chr(10) || CASE WHEN index % 3 = 0 THEN '' ELSE 'xx' END, 10) AS begins, round(ea, 6) AS ea, round(f1, 6) AS f1, CASE WHEN o_orderstatus < 'Area' THEN o_orderstatus || ',Area,Zone' ELSE 'Area,' || o_orderstatus || ',Zone' END AS invalid_labels,
        NULL::VARCHAR AS error, coalesce(size, 0)::INT AS gold FROM {_RESULTS}""",
    "client_file": "SELECT name, place, CASE WHEN given THEN (SELECT count(*) FROM orders) ELSE 0 END AS n FROM (VALUES " + ", ".join(f"('{c}', {k}, {str(c not in _ABSENT).lower()})" for k, c in enumerate(_COLUMNS)) + ") t(name, place, given)",
    "summary_files": f"SELECT 'm' AS model, {_named('index % 4', _WRITTEN)} AS setting, count(*) AS n, round(avg(ea), 6) AS ea, round(avg(svr), 6) AS svr FROM {_RESULTS} WHERE index % 4 < 3 GROUP BY index % 4",
    "test_set_files": """WITH c AS (SELECT *, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS index, 'Who trades, "really", in ' || n_name || '?' AS question FROM nation WHERE n_nationkey % 5 <> 0)
        SELECT 'set.csv' AS file, index, question, 'MATCH (n) RETURN ' || n_nationkey AS gold_cypher, NULL AS category, n_regionkey::VARCHAR AS difficulty FROM c UNION ALL SELECT 'set.json', index, question, 'x', n_name, NULL FROM c""",
    "latex_table": f"""SELECT model, (k + 1)::INT AS place, {_named("k", (*_WRITTEN, "other"))} AS setting, '  & ' || {_named("k", _SHOWN)} || ' & ' || {_stat("svr", True)} || ' & ' || {_stat("scr", True)} || ' & ' || {_stat("ea", True)} || ' \\\\' AS line FROM {_RUNS} GROUP BY model, k
        UNION ALL SELECT DISTINCT o_orderstatus, unnest([0, 6]), '', unnest(['\\textit{{' || o_orderstatus || '}}', '\\hline']) FROM orders""",
    "run_table": " UNION ALL ".join(
        f"SELECT model, {_named('k', (*_WRITTEN, 'other'))} AS setting, '{m.upper()}' AS metric, count(*) AS runs, string_agg(printf('%.4f', {m}), ', ' ORDER BY run) AS values, {_stat(m, False)} AS shown FROM {_RUNS} GROUP BY model, k" for m in ("svr", "scr", "ea")
    ),
    "merged_attributes": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Description=' || c_mktsegment || ',' ELSE '' END || 'Name=' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ',ObjectType=own' ELSE ',ObjectType=set,Phase=' || c_nationkey END AS props FROM customer""",
    "coerced_lists": """WITH p AS (SELECT p_partkey, p_partkey % 5 AS f, p_partkey % 7 AS h, p_size::VARCHAR AS n, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '2.5' WHEN 2 THEN 'true' WHEN 3 THEN '"' || p_brand || '"' END AS o,
          CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '2.5' WHEN 2 THEN 'True' WHEN 3 THEN p_brand END AS t FROM part)
        SELECT p_partkey, CASE WHEN h = 0 THEN '[' || o || ']' WHEN f = 4 THEN '[' || n || ']' WHEN f = 0 THEN '[' || n || ', ' || n || ']' WHEN f = 2 AND h <> 1 THEN '[' || n || ', true]'
          WHEN h = 1 THEN '["' || t || '", "' || n || '"]' ELSE '["' || n || '", "' || t || '"]' END AS list FROM p""",
    "class_names": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'IfcWallStandardCase' WHEN 1 THEN 'IfcDoor' WHEN 2 THEN 'IfcRooftop' ELSE 'Other' END AS class,
        left(translate(p_brand || '/a:b c' || chr(92) || 'd/' || p_type || p_type || p_type, '/: ' || chr(92), '____'), 50) AS file FROM part""",
    "cleaned_queries": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'MATCH (o) WHERE o.x = ' || o_custkey || ' RETURN o.y' WHEN 1 THEN 'match (o) return ' || o_custkey || ' and more' WHEN 2 THEN 'no query ' || o_custkey ELSE 'MATCH (a) RETURN ' || o_custkey END AS query FROM orders""",
    "gold_tokens": """SELECT 0 AS index, 'R:' || r_regionkey AS token, NULL AS error FROM region
        UNION ALL SELECT 1, n_name || '~num:' || count(*) || '~num:' || min(c_acctbal)::DOUBLE::VARCHAR, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
        UNION ALL SELECT 2, NULL, 'execution' UNION ALL SELECT 3, NULL, 'no query'""",
    "context_budget": """SELECT p_partkey, text FROM (SELECT p_partkey, p_name || ' ' || p_type AS text, sum(ceil(length(p_name || ' ' || p_type) / 4)) OVER (ORDER BY p_partkey) AS so_far FROM part WHERE p_partkey % 6 <> 0) WHERE so_far <= 5000""",
}
