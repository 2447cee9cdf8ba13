"""Scans, projections, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.functions import values
from propgraph.operators import profile
from propgraph.operators.match import match
from propgraph.sources.tables import trading_graph as graph


def label_count(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "c", "Customer").agg(F.count("c").alias("n"))


def label_count_inner(spark: SparkSession, sf: str) -> DataFrame:
    """A label above several leaves."""
    return match(graph(spark, sf), "e", "Element").agg(F.count("e").alias("n"))


def all_nodes_count(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "n").agg(F.count("n").alias("n"))


def unknown_label(spark: SparkSession, sf: str) -> DataFrame:
    """A label that no node has matches nothing, and its count is one row."""
    return match(graph(spark, sf), "n", "Nowhere").agg(F.count("n").alias("n"))


def label_project(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "n", "Nation").select(F.col("n.Name").alias("name"))


def node_return(spark: SparkSession, sf: str) -> DataFrame:
    """A returned node stands for its id."""
    return match(graph(spark, sf), "c", "Customer").where(F.col("c.c_acctbal") > 9000).select(F.col("c.node_id").alias("id"))


def eq_filter_count(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "c", "Customer").where(F.col("c.c_mktsegment") == "BUILDING").agg(F.count("c").alias("n"))


def range_filter_count(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "p", "Part").where(F.col("p.p_size") > 25, F.col("p.p_size") <= 40).agg(F.count("p").alias("n"))


def inequality(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "o", "Order").where(F.col("o.o_orderstatus") != "F").agg(F.count("o").alias("n"))


def boolean_filter(spark: SparkSession, sf: str) -> DataFrame:
    done = (F.col("o.o_orderstatus") == "F").alias("done")
    return match(graph(spark, sf), "o", "Order").df.withColumn("done", done).where("done").select(F.col("o.node_id").alias("id"))


def multi_col_project(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "s", "Supplier").where(F.col("s.s_acctbal") < 0)
    return m.select(F.col("s.Name").alias("name"), F.col("s.s_nationkey").alias("nation"), F.col("s.s_acctbal").alias("balance"))


def not_null_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "p", "Part").where(F.col("p.p_brand").isNotNull()).select(F.col("p.p_brand").alias("brand")).distinct()


def missing_property(spark: SparkSession, sf: str) -> DataFrame:
    """A property that only some leaves have is null on the others."""
    m = match(graph(spark, sf), "e", "Party")
    return m.groupBy(F.col("e.c_mktsegment").isNull().alias("missing")).agg(F.count("e").alias("n"))


def string_contains(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "p", "Part").where(F.col("p.Name").contains("red")).select(F.col("p.node_id").alias("id"))


def starts_ends_with(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "c", "Customer").where(F.col("c.Name").startswith("Customer"), F.col("c.Name").endswith("7"))
    return m.agg(F.count("c").alias("n"))


def not_contains(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "p", "Part").where(~F.col("p.Name").contains("red")).agg(F.count("p").alias("n"))


def in_list(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "c", "Customer").where(F.col("c.c_mktsegment").isin("BUILDING", "MACHINERY")).agg(F.count("c").alias("n"))


def bool_kleene(spark: SparkSession, sf: str) -> DataFrame:
    """AND, OR and NOT over a property that is null on some nodes."""
    segment = F.col("e.c_mktsegment")
    m = match(graph(spark, sf), "e", "Party").where(~((segment == "BUILDING") & (F.col("e.c_acctbal") > 0)) | (F.col("e.s_acctbal") > 5000))
    return m.agg(F.count("e").alias("n"))


def case_when(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p.p_size")
    kind = F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("kind")
    return match(graph(spark, sf), "p", "Part").groupBy(kind).agg(F.count("p").alias("n"))


def arith_project(spark: SparkSession, sf: str) -> DataFrame:
    p = match(graph(spark, sf), "p", "Part").df
    return p.select(F.col("p.node_id").alias("id"), F.round(F.col("p.p_retailprice") * F.col("p.p_size") - 1, 2).alias("x"), F.expr("p.p_size div 7").cast("long").alias("q"))


def conversions(spark: SparkSession, sf: str) -> DataFrame:
    """toInteger, toFloat and toBoolean give null where the text is none."""
    tail = F.substring_index("o.o_orderpriority", "-", 1)
    return (
        match(graph(spark, sf), "o", "Order")
        .select(values.to_integer(tail).alias("i"), values.to_float(F.col("o.o_orderstatus")).alias("f"), values.to_boolean(F.when(F.col("o.o_orderstatus") == "F", "True").otherwise("no")).alias("b"))
        .groupBy("i", "f", "b")
        .agg(F.count("*").alias("n"))
    )


def abs_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.abs(F.coalesce(F.col("e.c_acctbal"), F.lit(0.0)) - F.coalesce(F.col("e.s_acctbal"), F.lit(0.0)))
    return match(graph(spark, sf), "e", "Party").where(balance >= 5000).agg(F.count("e").alias("n"))


def lower_upper(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "r", "Region").select(F.lower("r.Name").alias("l"), F.upper("r.Name").alias("u"))


def guarded_division(spark: SparkSession, sf: str) -> DataFrame:
    """A float quotient over zero is infinite, zero over zero NaN; reported as text."""
    x = values.divide(F.col("p.p_retailprice") - F.col("p.p_retailprice"), F.col("p.p_size") - F.col("p.p_size"))
    y = values.divide(F.col("p.p_retailprice"), F.lit(0.0))
    return match(graph(spark, sf), "p", "Part").select(F.isnan(x).alias("nan"), (y == float("inf")).alias("inf")).groupBy("nan", "inf").agg(F.count("*").alias("n"))


def mixed_types(spark: SparkSession, sf: str) -> DataFrame:
    """One key with text on some nodes and numbers on others: unlike types are unequal, not errors."""
    g = graph(spark, sf)
    size, brand = g.nodes("Part").select("node_id", "p_size", "p_brand").schema["p_size"].dataType, g.nodes("Part").schema["p_brand"].dataType
    rows = g.nodes("Part").select(F.when(F.col("p_size") % 2 == 0, values.value(F.col("p_size"), size)).otherwise(values.value(F.col("p_brand"), brand)).alias("v"))
    same = values.equal(F.col("v"), values.value(F.lit(10), size))
    below = values.less(F.col("v"), values.value(F.lit(20), size))
    return rows.groupBy(same.alias("same"), below.alias("below")).agg(F.count("*").alias("n"))


def keys_unwind(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct keys of a label's nodes that a condition selects."""
    keys = profile.known_keys(graph(spark, sf)).where("label = 'Customer'").select("key")
    return keys.where(F.col("key").isin("Name", "Width") | F.lower("key").contains("seg"))


def constant_project(spark: SparkSession, sf: str) -> DataFrame:
    """A constant for every node of a label."""
    return match(graph(spark, sf), "r", "Region").select(F.lit(1).alias("one"))


QUERIES = {
    f.__name__: f
    for f in (
        label_count, label_count_inner, all_nodes_count, unknown_label, label_project, node_return, eq_filter_count, range_filter_count, inequality, boolean_filter, multi_col_project,
        not_null_distinct, missing_property, string_contains, starts_ends_with, not_contains, in_list, bool_kleene, case_when, arith_project, conversions, abs_coalesce, lower_upper,
        guarded_division, mixed_types, keys_unwind, constant_project,
    )
}

_PARTY = "(SELECT c_name AS name, c_mktsegment, c_acctbal, NULL AS s_acctbal FROM customer UNION ALL SELECT s_name, NULL, NULL, s_acctbal FROM supplier)"

ORACLES = {
    "label_count": "SELECT count(*) AS n FROM customer",
    "label_count_inner": "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) AS n",
    "all_nodes_count": "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(DISTINCT p_type) FROM part) AS n",
    "unknown_label": "SELECT 0::BIGINT AS n",
    "label_project": "SELECT n_name AS name FROM nation",
    "node_return": "SELECT 'C:' || c_custkey AS id FROM customer WHERE c_acctbal > 9000",
    "eq_filter_count": "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'",
    "range_filter_count": "SELECT count(*) AS n FROM part WHERE p_size > 25 AND p_size <= 40",
    "inequality": "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'",
    "boolean_filter": "SELECT 'O:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'",
    "multi_col_project": "SELECT s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier WHERE s_acctbal < 0",
    "not_null_distinct": "SELECT DISTINCT p_brand AS brand FROM part WHERE p_brand IS NOT NULL",
    "missing_property": f"SELECT c_mktsegment IS NULL AS missing, count(*) AS n FROM {_PARTY} GROUP BY 1",
    "string_contains": "SELECT 'P:' || p_partkey AS id FROM part WHERE contains(p_name, 'red')",
    "starts_ends_with": "SELECT count(*) AS n FROM customer WHERE starts_with(c_name, 'Customer') AND ends_with(c_name, '7')",
    "not_contains": "SELECT count(*) AS n FROM part WHERE NOT contains(p_name, 'red')",
    "in_list": "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "bool_kleene": f"SELECT count(*) AS n FROM {_PARTY} WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR s_acctbal > 5000",
    "case_when": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "arith_project": "SELECT 'P:' || p_partkey AS id, round(p_retailprice * p_size - 1, 2) AS x, (p_size // 7)::BIGINT AS q FROM part",
    "conversions": "SELECT try_cast(split_part(o_orderpriority, '-', 1) AS BIGINT) AS i, NULL::DOUBLE AS f, CASE WHEN o_orderstatus = 'F' THEN true END AS b, count(*) AS n FROM orders GROUP BY 1, 2, 3",
    "abs_coalesce": f"SELECT count(*) AS n FROM {_PARTY} WHERE abs(coalesce(c_acctbal, 0) - coalesce(s_acctbal, 0)) >= 5000",
    "lower_upper": "SELECT lower(r_name) AS l, upper(r_name) AS u FROM region",
    "guarded_division": "SELECT true AS nan, true AS inf, count(*) AS n FROM part",
    "mixed_types": "SELECT CASE WHEN p_size % 2 = 0 THEN p_size = 10 ELSE false END AS same, CASE WHEN p_size % 2 = 0 THEN p_size < 20 END AS below, count(*) AS n FROM part GROUP BY 1, 2",
    "keys_unwind": "SELECT unnest(['Name', 'c_mktsegment']) AS key",
    "constant_project": "SELECT 1 AS one FROM region",
}
