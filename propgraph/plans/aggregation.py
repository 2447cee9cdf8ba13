"""Grouping, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.functions import values
from propgraph.operators import profile
from propgraph.operators.etl import first_per_type
from propgraph.operators.match import match, with_scalar
from propgraph.sources.tables import trading_graph as graph


def global_aggs(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p.p_retailprice")
    m = match(graph(spark, sf), "p", "Part")
    return m.agg(F.min(x).alias("least"), F.max(x * F.col("p.p_size")).alias("most"), F.round(F.avg(x), 4).alias("mean"), F.round(values.total(x), 2).alias("total"), F.count("*").alias("n"))


def empty_sum_zero(spark: SparkSession, sf: str) -> DataFrame:
    """The sum of nothing is 0, its mean null."""
    m = match(graph(spark, sf), "p", "Part").where(F.col("p.p_size") < 0)
    return m.agg(values.total(F.col("p.p_retailprice")).alias("total"), F.avg("p.p_retailprice").alias("mean"), F.count("p").alias("n"))


def filtered_average(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "p", "Part").where(F.col("p.Name").contains("green")).agg(F.round(F.avg("p.p_size"), 6).alias("mean"))


def hop_sum(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "n", "Nation").where(F.col("n.Name") == "NATION_2").hop("CONTAINS", "c", "Customer")
    return m.agg(F.round(values.total(F.col("c.c_acctbal") * 2), 2).alias("total"))


def distinct_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "p", "Part")
    return m.agg(F.count_distinct("p.p_brand").alias("brands"), F.sum_distinct(F.col("p.p_size")).alias("sizes"))


def group_with_null_key(spark: SparkSession, sf: str) -> DataFrame:
    """Null is a group of its own."""
    return match(graph(spark, sf), "e", "Party").groupBy(F.col("e.c_mktsegment").alias("segment")).agg(F.count("e").alias("n"))


def group_order_limit(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "n", "Nation").hop("CONTAINS", "c", "Customer")
    n = m.groupBy(F.col("n.Name").alias("name")).agg(F.count("c").alias("n"))
    return n.orderBy(values.descending(F.col("n")), "name").limit(1)


def order_by_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "n", "Nation").hop("CONTAINS", "s", "Supplier")
    n = m.groupBy(F.col("n.Name").alias("name")).agg(F.round(values.total(F.col("s.s_acctbal")), 2).alias("total"))
    return n.orderBy(values.descending(F.col("total")), "name").limit(5)


def having_with(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "c", "Customer").hop("DECOMPOSES", "o", "Order")
    return m.groupBy(F.col("c.node_id").alias("c")).agg(F.count("o").alias("orders")).where("orders > 14")


def agg_ratio_case(spark: SparkSession, sf: str) -> DataFrame:
    """A ratio of two sums, null where there is nothing to divide by."""
    m = match(graph(spark, sf), "n", "Nation").where(F.col("n.Name") == "NATION_4").hop("CONTAINS", "c", "Customer")
    sums = m.agg(F.sum(F.when(F.col("c.c_acctbal") > 0, F.col("c.c_acctbal"))).alias("net"), F.sum("c.c_acctbal").alias("gross"))
    return sums.select(F.when(F.col("gross").isNull() | (F.col("gross") == 0), None).otherwise(F.round(F.col("net") / F.col("gross"), 6)).alias("ratio"))


def ratio_of_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Two labels' aggregates, one divided by the other."""
    g = graph(spark, sf)
    one = match(g, "c", "Customer").agg(values.total(F.col("c.c_acctbal")).alias("a"))
    two = match(g, "s", "Supplier").agg(values.total(F.col("s.s_acctbal")).alias("b"))
    return with_scalar(two, one).select(F.round(values.divide(F.col("a"), F.col("b")), 6).alias("ratio"))


def collect_sorted(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "r", "Region").hop("DECOMPOSES", "n", "Nation")
    return m.groupBy(F.col("r.Name").alias("region")).agg(F.array_join(F.sort_array(F.collect_list("n.Name")), ",").alias("nations"))


def top1_before_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the largest price times size, and then one of its properties."""
    p = match(graph(spark, sf), "p", "Part").df
    top = p.orderBy(values.descending(F.col("p.p_retailprice") * F.col("p.p_size")), "p.node_id").limit(1)
    return top.select(F.col("p.p_brand").alias("brand"))


def nulls_largest_order(spark: SparkSession, sf: str) -> DataFrame:
    """Descending order begins with null."""
    e = match(graph(spark, sf), "e", "Party").df.select(F.col("e.Name").alias("name"), F.col("e.c_acctbal").alias("balance"))
    return e.orderBy(values.descending(F.col("balance")), "name").limit(20)


def ascending_order(spark: SparkSession, sf: str) -> DataFrame:
    e = match(graph(spark, sf), "e", "Party").df.select(F.col("e.Name").alias("name"), F.col("e.c_acctbal").alias("balance"))
    return e.orderBy(values.ascending(F.col("balance")), "name").limit(20)


def priority_order(spark: SparkSession, sf: str) -> DataFrame:
    """A label's keys with the place that priority and name give them."""
    keys = profile.known_keys(graph(spark, sf)).where("label = 'Part'").select("key", profile.priority(F.col("key")).alias("rank"))
    rows = keys.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("all"))
    return rows.select(F.posexplode("all.key").alias("place", "key"))


def ranking_desc(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by customers and by balance, best first."""
    from propgraph.operators.scoring import ranking

    m = match(graph(spark, sf), "n", "Nation").hop("CONTAINS", "c", "Customer")
    s = m.groupBy(F.col("n.Name").alias("setting")).agg(F.count("c").alias("customers"), F.max("c.c_acctbal").alias("balance"))
    return ranking(s, "setting", ["customers", "balance"])


def distinct_records(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "o", "Order")
    return m.select(F.col("o.o_orderstatus").alias("status"), F.col("o.o_orderpriority").alias("priority")).distinct()


def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The leaf labels by their number of nodes, 25 at most."""
    n = graph(spark, sf).labelled().groupBy("leaf").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "leaf").limit(25)


def two_level_count(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "p", "Part").hop("HAS_MATERIAL", "m", "Material")
    return m.groupBy(F.col("m.Name").alias("material"), F.col("p.p_brand").alias("brand")).agg(F.count("*").alias("n"))


def non_null_rate(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "e", "Element")
    return m.agg(*(F.round(F.avg(F.col(f"e.{c}").isNotNull().cast("double")), 6).alias(c) for c in ("c_mktsegment", "s_acctbal", "o_orderstatus")))


def per_type_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Export: a node appears once under each of its labels, at most five to a label."""
    rows = graph(spark, sf).labelled().select(F.explode("labels").alias("type"), "node_id")
    return first_per_type(rows, "type", ["node_id"], 5)


def rolling_60s_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Per user, the events and values of the 60 seconds up to each event.  (Partitioned by user: a rate is a user's.)"""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "value")
    span = "PARTITION BY user_id ORDER BY unix_micros(cast(ts AS timestamp)) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW"
    return e.select("event_id", F.expr(f"count(*) OVER ({span})").alias("n"), F.expr(f"round(sum(value) OVER ({span}), 4)").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        global_aggs, empty_sum_zero, filtered_average, hop_sum, distinct_aggregates, group_with_null_key, group_order_limit, order_by_aggregate, having_with, agg_ratio_case, ratio_of_scalars,
        collect_sorted, top1_before_projection, nulls_largest_order, ascending_order, priority_order, ranking_desc, distinct_records, type_histogram, two_level_count, non_null_rate,
        per_type_limit, rolling_60s_sum,
    )
}

_PARTY = "(SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, NULL, NULL FROM supplier)"
_LABELS = {
    "Region": ("region", "'R:' || r_regionkey", ("Region", "Spatial", "Root")),
    "Nation": ("nation", "'N:' || n_nationkey", ("Nation", "Spatial", "Root")),
    "Customer": ("customer", "'C:' || c_custkey", ("Customer", "Party", "Element", "Root")),
    "Supplier": ("supplier", "'S:' || s_suppkey", ("Supplier", "Party", "Element", "Root")),
    "Order": ("orders", "'O:' || o_orderkey", ("Order", "Element", "Root")),
    "Part": ("part", "'P:' || p_partkey", ("Part", "TypeProduct", "Root")),
    "Material": ("(SELECT DISTINCT p_type FROM part)", "'M:' || p_type", ("Material",)),
}
#: (leaf, label, place, node_id) of all nodes, for other modules' SQL too.
LABELLED = "(" + " UNION ALL ".join(f"SELECT '{leaf}' AS leaf, '{label}' AS label, {k} AS place, {key} AS node_id FROM {table}" for leaf, (table, key, labels) in _LABELS.items() for k, label in enumerate(labels)) + ")"
#: (type, sl, dl, src, dst) of all edges, with the leaves of their ends.
EDGES = """(SELECT 'DECOMPOSES' AS type, 'Region' AS sl, 'Nation' AS dl, 'R:' || n_regionkey AS src, 'N:' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'DECOMPOSES', 'Customer', 'Order', 'C:' || o_custkey, 'O:' || o_orderkey FROM orders
    UNION ALL SELECT 'CONTAINS', 'Nation', 'Customer', 'N:' || c_nationkey, 'C:' || c_custkey FROM customer
    UNION ALL SELECT 'CONTAINS', 'Nation', 'Supplier', 'N:' || s_nationkey, 'S:' || s_suppkey FROM supplier
    UNION ALL SELECT 'IS_OF_TYPE', 'Order', 'Part', 'O:' || l_orderkey, 'P:' || l_partkey FROM lineitem
    UNION ALL SELECT 'BOUNDED_BY', 'Order', 'Supplier', 'O:' || l_orderkey, 'S:' || l_suppkey FROM lineitem
    UNION ALL SELECT DISTINCT 'HAS_OPENING', 'Order', 'Part', 'O:' || l_orderkey, 'P:' || l_partkey FROM lineitem
    UNION ALL SELECT DISTINCT 'FILLS', 'Supplier', 'Part', 'S:' || l_suppkey, 'P:' || l_partkey FROM lineitem
    UNION ALL SELECT DISTINCT 'HAS_MATERIAL', 'Part', 'Material', 'P:' || p_partkey, 'M:' || p_type FROM part
    UNION ALL SELECT 'CONNECTED_TO', 'Customer', 'Customer', 'C:' || c, 'C:' || d FROM (SELECT c_custkey AS c, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS d FROM customer) WHERE d IS NOT NULL)"""

ORACLES = {
    "global_aggs": "SELECT min(p_retailprice) AS least, max(p_retailprice * p_size) AS most, round(avg(p_retailprice), 4) AS mean, round(sum(p_retailprice), 2) AS total, count(*) AS n FROM part",
    "empty_sum_zero": "SELECT 0::DOUBLE AS total, NULL::DOUBLE AS mean, 0::BIGINT AS n",
    "filtered_average": "SELECT round(avg(p_size), 6) AS mean FROM part WHERE contains(p_name, 'green')",
    "hop_sum": "SELECT round(sum(c_acctbal * 2), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_2'",
    "distinct_aggregates": "SELECT count(DISTINCT p_brand) AS brands, sum(DISTINCT p_size)::BIGINT AS sizes FROM part",
    "group_with_null_key": f"SELECT segment, count(*) AS n FROM {_PARTY} GROUP BY 1",
    "group_order_limit": "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, name LIMIT 1",
    "order_by_aggregate": "SELECT n_name AS name, round(sum(s_acctbal), 2) AS total FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY total DESC, name LIMIT 5",
    "having_with": "SELECT 'C:' || o_custkey AS c, count(*) AS orders FROM orders GROUP BY 1 HAVING count(*) > 14",
    "agg_ratio_case": "SELECT round(sum(c_acctbal) FILTER (c_acctbal > 0) / sum(c_acctbal), 6) AS ratio FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_4'",
    "ratio_of_scalars": "SELECT round((SELECT sum(c_acctbal) FROM customer) / (SELECT sum(s_acctbal) FROM supplier), 6) AS ratio",
    "collect_sorted": "SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    "top1_before_projection": "SELECT p_brand AS brand FROM part ORDER BY p_retailprice * p_size DESC, 'P:' || p_partkey LIMIT 1",
    "nulls_largest_order": f"SELECT name, balance FROM {_PARTY} ORDER BY balance DESC NULLS FIRST, name LIMIT 20",
    "ascending_order": f"SELECT name, balance FROM {_PARTY} ORDER BY balance ASC NULLS LAST, name LIMIT 20",
    "priority_order": "SELECT unnest(['Name', 'p_brand', 'p_name', 'p_partkey', 'p_retailprice', 'p_size', 'p_type']) AS key, unnest([0, 1, 2, 3, 4, 5, 6]) AS place",
    "ranking_desc": """WITH s AS (SELECT n_name AS setting, count(*) AS customers, max(c_acctbal) AS balance FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT 'customers' AS metric, row_number() OVER (ORDER BY customers DESC, setting)::INT AS place, setting FROM s
        UNION ALL SELECT 'balance', row_number() OVER (ORDER BY balance DESC, setting)::INT, setting FROM s""",
    "distinct_records": "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders",
    "type_histogram": f"SELECT leaf, count(*) AS n FROM {LABELLED} WHERE place = 0 GROUP BY 1 ORDER BY n DESC, leaf LIMIT 25",
    "two_level_count": "SELECT p_type AS material, p_brand AS brand, count(*) AS n FROM part GROUP BY 1, 2",
    "non_null_rate": """SELECT round(avg((k = 1)::INT::DOUBLE), 6) AS c_mktsegment, round(avg((k = 2)::INT::DOUBLE), 6) AS s_acctbal, round(avg((k = 3)::INT::DOUBLE), 6) AS o_orderstatus
        FROM (SELECT 1 AS k FROM customer UNION ALL SELECT 2 FROM supplier UNION ALL SELECT 3 FROM orders)""",
    "per_type_limit": f"SELECT type, node_id FROM (SELECT label AS type, node_id, row_number() OVER (PARTITION BY label ORDER BY node_id) AS k FROM {LABELLED}) WHERE k <= 5",
    "rolling_60s_sum": """SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""",
}
