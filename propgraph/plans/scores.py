"""Tokens and scores, over cases made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.functions import tokens
from propgraph.operators import reports, scoring


def record_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of text, whole and decimal cells as records; an all-null row has none."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    some = F.col("c_custkey") % 7 != 0
    cells = [tokens.text(F.when(some, F.col("c_mktsegment"))), tokens.integer(F.when(some, F.col("c_nationkey"))), tokens.boolean(F.when(some, F.col("c_acctbal") > 0))]
    return c.select("c_custkey", F.replace(tokens.record(*cells), F.lit(tokens.CELL), F.lit("~")).alias("token"))


def list_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A list stands for the sorted bag of its elements."""
    n = spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit("g-"), "n_name")).alias("all"))
    return n.select("n_regionkey", F.replace(tokens.bag(F.col("all")), F.lit(tokens.ELEMENT), F.lit("+")).alias("token"))


def numeric_text(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric text counts as a number, other text as itself."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    cell = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return p.groupBy(tokens.text(cell).alias("token")).agg(F.count("*").alias("n"))


def svr_json(spark: SparkSession, sf: str) -> DataFrame:
    """Direct answers as JSON lists: fenced, within prose, or none at all."""
    return _answers(spark.read.parquet(f"{sf}/orders.parquet"))


def _answers(o: DataFrame) -> DataFrame:
    answer = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('```json\n["'), "o_orderstatus", F.lit('", 5]\n```')))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("The answer is [true, "), F.col("o_custkey").cast("string"), F.lit(', "7"].')))
        .when(F.col("o_orderkey") % 5 == 2, F.lit('{"a": 1}'))
        .when(F.col("o_orderkey") % 5 == 3, F.lit("[1, 2"))
        .otherwise(F.lit("[]"))
    )
    found = o.select("o_orderkey", tokens.answer_tokens(answer).alias("tokens"))
    return found.select("o_orderkey", F.col("tokens").isNotNull().alias("valid"), F.array_join(F.array_sort("tokens"), ",").alias("tokens"))


def svr_json_all(spark: SparkSession, sf: str) -> DataFrame:
    """Direct answers whose elements are of every form: null, nested, with blanks, long, with exponents, empty."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    forms = ['[null, {"a": 1}, [1, "q"]]', '[" pad ", "  5 "]', '[0.00005, 1e20]', '[5.0, "5.50", "1e3"]', '["0123456789012345678901", true, "true"]']
    own = F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(', ""]'))
    answer = F.coalesce(F.get(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 6).cast("int")), own)
    found = o.select("o_orderkey", tokens.answer_tokens(answer).alias("tokens"))
    return found.select("o_orderkey", F.size("tokens").alias("n"), F.array_join(F.array_sort("tokens"), "|").alias("tokens"))


def scr_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Compliance of queries with texts and decimals that look like names, as they stand and masked."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_type").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # few bytes, much work a row
    query = F.concat(F.lit("MATCH (p:Part) WHERE p.p_type = 'a.wide "), F.col("p_type"), F.lit(" (x:Planet)' AND p.p_retailprice > "), F.when(F.col("p_partkey") % 2 == 0, "10.25").otherwise(F.lit("10")), F.lit(' RETURN p.p_name, "b.c"'))
    valid = [F.array(F.lit("part")), F.array(*map(F.lit, ("p_type", "p_retailprice", "p_name")))]
    shown = lambda s: F.array_join(F.concat(s["invalid_labels"], s["invalid_properties"]), ",")
    s = p.select("p_partkey", scoring.schema_compliance(query, *valid).alias("plain"), scoring.schema_compliance(query, *valid, mask=True).alias("masked"))
    return s.select("p_partkey", F.round("plain.scr", 6).alias("scr"), shown(F.col("plain")).alias("invalid"), F.col("masked.scr").alias("scr_masked"), shown(F.col("masked")).alias("invalid_masked"))


def svr_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Query texts of several clauses, some with a name that nothing binds, a bracket too few or clauses out of order."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    forms = [
        "MATCH (o:Order)-[:R]->(p:Part)<-[r:S]-(x) WHERE o.price * 2 > {0} AND NOT (o)-[:T]->(:Lot) RETURN o.id AS id, count(DISTINCT p) AS n, r ORDER BY n DESC LIMIT 5",
        "MATCH (o:Order) WHERE q.price > {0} RETURN o", "MATCH (o:Order) WITH o.price / {0} AS part, o WHERE part > 1 RETURN o.id, part", "MATCH (o:Order) WITH o.price AS part RETURN o.id",
        "MATCH (o:Order) WHERE (o.price > {0} RETURN o", "MATCH (o:Order) UNWIND keys(o) AS k WITH DISTINCT k WHERE k CONTAINS 'RETURN (' RETURN collect(k), {0}", "RETURN o MATCH (o) WHERE o.x = {0}", "MATCH (o:Order) RETURN o.a, {0}, o.a",
    ]
    text = F.replace(F.get(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 8).cast("int")), F.lit("{0}"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", reports.syntax_validity(text, F.lit(reports.QUERY), None).alias("svr"))


def scr_labels_props(spark: SparkSession, sf: str) -> DataFrame:
    """Compliance of queries whose labels and properties are partly unknown."""
    n = spark.read.parquet(f"{sf}/customer.parquet")
    query = F.concat(
        F.lit("MATCH (s:"), F.when(F.col("c_custkey") % 3 == 0, "Nation").otherwise("Planet"), F.lit(")-[:CONTAINS]->(c:customer) WHERE s."), F.when(F.col("c_custkey") % 4 == 0, "Name").otherwise("Width"), F.lit(" = 'x' RETURN c.c_acctbal, c.id, s.labels, s.type")
    )
    blank = F.when(F.col("c_custkey") % 11 == 0, F.lit("  ")).when(F.col("c_custkey") % 13 == 0, F.lit("RETURN 1")).otherwise(query)
    valid = [F.array(*map(F.lit, names)) for names in (("nation", "customer"), ("name", "c_acctbal"))]
    s = n.select("c_custkey", scoring.schema_compliance(blank, *valid).alias("s"))
    return s.select("c_custkey", F.round("s.scr", 6).alias("scr"), F.array_join("s.invalid_labels", ",").alias("labels"), F.array_join("s.invalid_properties", ",").alias("properties"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a case: its parts are the gold tokens, those of even number (and one more) the generated ones."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    gold = F.collect_set(tokens.integer(F.col("l_partkey")))
    generated = F.array_union(F.collect_set(F.when(F.col("l_partkey") % 2 == 0, tokens.integer(F.col("l_partkey")))), F.array(F.lit("x")))
    own = line.groupBy(F.col("l_orderkey").alias("index")).agg(gold.alias("gold"), generated.alias("tokens"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("index"), "o_orderstatus", "o_orderpriority")
    return orders.join(own, "index", "left")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cases(spark, sf)
    outputs = rows.select("index", "o_orderstatus", "o_orderpriority", "tokens", F.when(F.col("index") % 6 == 0, 0.0).otherwise(1.0).alias("svr"), F.lit(1.0).alias("scr"))
    return scoring.evaluate(rows.where("gold IS NOT NULL").select("index", "gold"), outputs)


def token_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).select("index", F.round("ea", 6).alias("ea"))


def ea_prf(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf)
    return r.select("index", F.round("precision", 6).alias("p"), F.round("recall", 6).alias("r"), F.round("f1", 6).alias("f1"))


def gold_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar gold (numbers and booleans alone), other gold, and none."""
    r = _results(spark, sf)
    shape = F.when(F.size("gold") == 0, "empty").when(scoring.scalar_gold(F.col("gold")), "scalar").otherwise("set")
    return r.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


def difficulty_summary(spark: SparkSession, sf: str) -> DataFrame:
    level = F.substring_index("o_orderpriority", "-", 1)
    named = scoring.difficulty(F.when(level.isin("1", "2", "3"), level).when(level == "4", F.lit(" ")))
    return scoring.summary(_results(spark, sf).withColumn("difficulty", named), ["difficulty"]).select("difficulty", "n", "valid", "perfect", F.round("ea_mean", 4).alias("ea"), F.round("f1_mean_non_trivial", 4).alias("f1"))


def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.summary(_results(spark, sf), ["o_orderstatus"])
    return s.select(F.col("o_orderstatus").alias("category"), "n", F.round("svr_mean", 4).alias("svr"), F.round("ea_mean_non_trivial", 4).alias("ea"))


def metrics_by_group(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.summary(_results(spark, sf), ["o_orderstatus", "o_orderpriority"])
    return s.select("o_orderstatus", "o_orderpriority", "n", F.round("ea_mean", 4).alias("ea"))


def metric_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sum, least and most of the metrics by status."""
    s = scoring.summary(_results(spark, sf), ["o_orderstatus"])
    return s.select("o_orderstatus", *(F.round(f"{m}_{k}", 2).alias(f"{m}_{k}") for m in ("svr", "ea", "f1") for k in ("sum", "min", "max")))


def scalar_set_split(spark: SparkSession, sf: str) -> DataFrame:
    """Means over scalar and over set gold, 0 where there is none."""
    s = scoring.summary(_results(spark, sf), [])
    return s.select(F.round("ea_mean_scalar", 4).alias("scalar"), F.round("ea_mean_set", 4).alias("sets"), "n")


def stddev_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as runs of their nations: mean and sample deviation, 0 for a single run."""
    return _runs(spark.read.parquet(f"{sf}/customer.parquet"))


def stddev_by_group_all(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs of their status and priority: two metrics, and their text for a table."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderstatus", "o_orderpriority", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    s = scoring.across_runs(o, ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"])
    rounded = {m: F.round(m, 2).alias(m) for m in ("o_totalprice_mean", "o_totalprice_std", "o_custkey_mean", "o_custkey_std")}
    return s.select("o_orderstatus", "o_orderpriority", "runs", *rounded.values(), scoring.mean_and_deviation(F.round(F.col("o_custkey_mean"), 1), F.lit(0.5), digits=3).alias("shown"))


def _runs(c: DataFrame) -> DataFrame:
    s = scoring.across_runs(c, ["c_nationkey"], ["c_acctbal"])
    return s.select("c_nationkey", "runs", F.round("c_acctbal_mean", 4).alias("mean"), F.round("c_acctbal_std", 4).alias("std"))


QUERIES = {
    f.__name__: f
    for f in (
        record_tokens, list_tokens, numeric_text, svr_json, scr_labels_props, token_jaccard, ea_prf, gold_shape, difficulty_summary, category_summary, metrics_by_group, scalar_set_split, stddev_by_group,
        svr_json_all, stddev_by_group_all, scr_masked, svr_bound, metric_totals,
    )
}

_RESULTS = """(SELECT o_orderkey AS index, o_orderstatus, o_orderpriority, gold, size, CASE WHEN o_orderkey % 6 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS svr, coalesce(both_, 0) AS both_, coalesce(made, 0) AS made,
      CASE WHEN o_orderkey % 6 = 0 THEN 0 WHEN size IS NULL THEN 1 ELSE both_ / (size + made - both_) END::DOUBLE AS ea,
      CASE WHEN made IS NULL THEN 0 ELSE both_ / made END::DOUBLE AS p, CASE WHEN size IS NULL THEN 0 ELSE both_ / size END::DOUBLE AS r,
      CASE WHEN coalesce(both_, 0) = 0 THEN 0 ELSE 2.0 * both_ / (size + made) END::DOUBLE AS f1
    FROM orders LEFT JOIN (SELECT l_orderkey AS gold, count(DISTINCT l_partkey)::DOUBLE AS size, count(DISTINCT l_partkey) FILTER (l_partkey % 2 = 0)::DOUBLE AS both_,
      1.0 + count(DISTINCT l_partkey) FILTER (l_partkey % 2 = 0)::DOUBLE AS made FROM lineitem GROUP BY 1) ON gold = o_orderkey)"""

ORACLES = {
    "record_tokens": "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || '~num:' || c_nationkey || '~bool:' || (c_acctbal > 0)::INT END AS token FROM customer",
    "list_tokens": "SELECT n_regionkey, string_agg('g-' || n_name, '+' ORDER BY 'g-' || n_name) AS token FROM nation GROUP BY 1",
    "numeric_text": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'num:' || p_size ELSE p_brand END AS token, count(*) AS n FROM part GROUP BY 1",
    "svr_json": """SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 4) AS valid, CASE o_orderkey % 5 WHEN 0 THEN o_orderstatus || ',num:5' WHEN 1 THEN array_to_string(list_sort(list_distinct(['bool:1', 'num:' || o_custkey, 'num:7'])), ',') WHEN 4 THEN '' END AS tokens
        FROM orders""",
    "scr_labels_props": """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 13 = 0 THEN 1 ELSE round((2 + (c_custkey % 3 = 0)::INT + (c_custkey % 4 = 0)::INT) / 4, 6) END::DOUBLE AS scr,
          CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 3 = 0 THEN '' ELSE 'Planet' END AS labels, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 4 = 0 THEN '' ELSE 'Width' END AS properties FROM customer""",
    "token_jaccard": f"SELECT index, round(ea, 6) AS ea FROM {_RESULTS}",
    "ea_prf": f"SELECT index, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM {_RESULTS}",
    "gold_shape": f"SELECT CASE WHEN gold IS NULL THEN 'empty' ELSE 'scalar' END AS shape, count(*) AS n FROM {_RESULTS} GROUP BY 1",
    "difficulty_summary": f"""SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'easy' WHEN '2' THEN 'medium' WHEN '3' THEN 'hard' ELSE 'unknown' END AS difficulty, count(*) AS n, count(*) FILTER (svr > 0) AS valid,
          count(*) FILTER (ea >= 1) AS perfect, round(avg(ea), 4) AS ea, round(coalesce(avg(f1) FILTER (gold IS NOT NULL), 0), 4) AS f1 FROM {_RESULTS} GROUP BY 1""",
    "category_summary": f"SELECT o_orderstatus AS category, count(*) AS n, round(avg(svr), 4) AS svr, round(avg(ea) FILTER (gold IS NOT NULL), 4) AS ea FROM {_RESULTS} GROUP BY 1",
    "metrics_by_group": f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(ea), 4) AS ea FROM {_RESULTS} GROUP BY 1, 2",
    "scalar_set_split": f"SELECT round(avg(ea) FILTER (gold IS NOT NULL), 4) AS scalar, 0::DOUBLE AS sets, count(*) AS n FROM {_RESULTS}",
    "stddev_by_group": "SELECT c_nationkey, count(*) AS runs, round(avg(c_acctbal), 4) AS mean, round(coalesce(stddev_samp(c_acctbal), 0), 4) AS std FROM customer GROUP BY 1",
    "svr_json_all": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 3, 4) THEN 3 ELSE 2 END AS n, CASE o_orderkey % 6 WHEN 0 THEN 'None|[1, ''q'']|{''a'': 1}' WHEN 1 THEN ' pad |num:5' WHEN 2 THEN 'num:1e+20|num:5e-05'
          WHEN 3 THEN 'num:1000.0|num:5.0|num:5.5' WHEN 4 THEN 'bool:1|num:123456789012345678901|true' ELSE '|num:' || o_custkey END AS tokens FROM orders""",
    "stddev_by_group_all": """SELECT o_orderstatus, o_orderpriority, count(*) AS runs, round(avg(o_totalprice), 2) AS o_totalprice_mean, round(coalesce(stddev_samp(o_totalprice), 0), 2) AS o_totalprice_std,
          round(avg(o_custkey), 2) AS o_custkey_mean, round(coalesce(stddev_samp(o_custkey), 0), 2) AS o_custkey_std, printf('%.3f ± 0.500', round(avg(o_custkey), 1)) AS shown FROM orders GROUP BY 1, 2""",
    "scr_masked": """SELECT p_partkey, round((4 + 0) / (CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 7 END), 6)::DOUBLE AS scr, CASE WHEN p_partkey % 2 = 0 THEN 'Planet,25,c,wide' ELSE 'Planet,c,wide' END AS invalid,
          1::DOUBLE AS scr_masked, '' AS invalid_masked FROM part""",
    "svr_bound": "SELECT o_orderkey, (o_orderkey % 8 IN (0, 2, 5))::INT::DOUBLE AS svr FROM orders",
    "metric_totals": f"SELECT o_orderstatus, {', '.join(f'round({k}({m}), 2) AS {m}_{k}' for m in ('svr', 'ea', 'f1') for k in ('sum', 'min', 'max'))} FROM {_RESULTS} GROUP BY 1",
}
