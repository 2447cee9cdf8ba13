"""Hops, semi and anti joins, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.operators import profile
from propgraph.operators.closure import derived_containment, transitive_closure
from propgraph.operators.match import match, with_scalar
from propgraph.sources.tables import trading_graph as graph


def one_hop_count(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "n", "Nation").hop("CONTAINS", None, "Customer").where(F.col("n.Name") == "NATION_3")
    return m.agg(F.count("_1").alias("n"))


def reverse_hop(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "o", "Order").where(F.col("o.o_totalprice") > 400000).hop("DECOMPOSES", "c", "Customer", direction="in")
    return m.select(F.col("o.node_id").alias("o"), F.col("c.Name").alias("customer"))


def two_hop_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that fill a part which an order opens: FILLS, then HAS_OPENING backwards."""
    m = match(graph(spark, sf), "s", "Supplier").hop("FILLS", None, "Part").hop("HAS_OPENING", "o", "Order", direction="in").where(F.col("o.o_totalprice") > 450000)
    return m.distinct(F.col("s.node_id").alias("s"))


def untyped_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "n", "Nation").where(F.col("n.Name") == "NATION_5").hop("CONTAINS", "e")
    return m.agg(F.count("e").alias("n"))


def from_untyped(spark: SparkSession, sf: str) -> DataFrame:
    """From any node to a named material: an edge join, as the start is only counted."""
    g = graph(spark, sf)
    m = match(g, "m", "Material").hop("HAS_MATERIAL", "e", direction="in")
    return m.groupBy(F.col("m.Name").alias("material")).agg(F.count("e").alias("n"))


def any_type_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).all_edges().agg(F.count("*").alias("n"))


def unknown_type(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "n", "Nation").hop("BOUNDS", "x").agg(F.count("x").alias("n"))


def self_meeting_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Two orders of one customer meet over different edges of one type; the pattern never takes an edge twice."""
    g = graph(spark, sf)
    m = match(g, "a", "Order").where(F.col("a.o_totalprice") > 400000).hop("DECOMPOSES", "c", "Customer", direction="in", same_type_again=True).hop("DECOMPOSES", "b", "Order", same_type_again=True)
    pairs = m.groupBy(F.col("a.node_id").alias("a")).agg(F.count("b").alias("connections"))
    return pairs.where("connections > 1")


def undirected_degree(spark: SparkSession, sf: str) -> DataFrame:
    return profile.degrees(graph(spark, sf), "CONNECTED_TO", "Customer")


def undirected_hop(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "c", "Customer").where(F.col("c.c_acctbal") > 9500).hop("CONNECTED_TO", "d", direction="both")
    return m.select(F.col("c.node_id").alias("c"), F.col("d.node_id").alias("d"))


def optional_match(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with how many parts they open, those without any too."""
    m = match(graph(spark, sf), "o", "Order").hop("HAS_OPENING", None, "Part", how="left")
    n = m.groupBy(F.col("o.node_id").alias("o")).agg(F.count("_1").alias("parts"))
    return n.groupBy("parts").agg(F.count("*").alias("n"))


def cartesian_scalar(spark: SparkSession, sf: str) -> DataFrame:
    """A global aggregate beside every nation."""
    g = graph(spark, sf)
    most = match(g, "c", "Customer").agg(F.max("c.c_acctbal").alias("most"))
    return with_scalar(match(g, "n", "Nation").df, most).select(F.col("n.Name").alias("name"), "most")


def label_disjunction(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "n", "Nation").where(F.col("n.Name") == "NATION_1").hop("CONTAINS", "e", "Customer", "Supplier")
    return m.where(F.coalesce(F.col("e.c_acctbal"), F.col("e.s_acctbal")) > 0).select(F.col("e.node_id").alias("id"))


def hop_property_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "n", "Nation").hop("CONTAINS", "c", "Customer").where((F.col("n.Name").contains("1") | F.col("n.Name").contains("2")) & (F.col("c.c_acctbal") > 9000))
    return m.select(F.col("c.node_id").alias("id"))


def pattern_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "o", "Order").having("BOUNDED_BY", "Supplier").agg(F.count("o").alias("n"))


def negated_pattern_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return match(graph(spark, sf), "o", "Order").lacking("BOUNDED_BY", "Supplier").select(F.col("o.node_id").alias("id"))


def predicate_in_or(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "o", "Order").flagged("open", "HAS_OPENING", "Part").where(~F.col("open") | (F.col("o.o_totalprice") > 450000))
    return m.agg(F.count("o").alias("n"))


def orders_without_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics: per status, elements that lack a relation they should have."""
    return match(graph(spark, sf), "o", "Order").lacking("IS_OF_TYPE").groupBy(F.col("o.o_orderstatus").alias("status")).agg(F.count("o").alias("n"))


def hop_through_opening(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics: orders one of whose parts a supplier of low balance fills."""
    g = graph(spark, sf)
    poor = match(g, "s", "Supplier").where(F.col("s.s_acctbal") < -900).hop("FILLS", None, "Part").distinct(F.col("_1.node_id").alias("part"))
    opened = g.edges["HAS_OPENING"].df.join(poor, F.col("dst") == F.col("part"), "left_semi").select("src")
    return opened.distinct().agg(F.count("*").alias("n"))


def count_distinct_hop(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct sources of a hop: those that have one, so a semi join counts them."""
    return match(graph(spark, sf), "o", "Order").having("IS_OF_TYPE", "Part").agg(F.count("o").alias("n"))


def distinct_property_hop(spark: SparkSession, sf: str) -> DataFrame:
    m = match(graph(spark, sf), "n", "Nation").where(F.col("n.Name") == "NATION_7").hop("CONTAINS", "c", "Customer")
    return m.distinct(F.col("c.c_mktsegment").alias("segment"))


def closure_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Everything reached from a region: nations, and what they contain, and their orders."""
    g = graph(spark, sf)
    edges = g.edges["DECOMPOSES"].df.unionAll(g.edges["CONTAINS"].df.select("src", "dst"))
    reach = transitive_closure(edges, sources=edges.where(F.col("src").startswith("R:")))
    return reach.groupBy("src").agg(F.count("*").alias("n"))


def derived_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Nations contain what their customers decompose into."""
    g = graph(spark, sf)
    made = derived_containment(g.edges["CONTAINS"].df, g.edges["DECOMPOSES"].df)
    return made.groupBy("src").agg(F.count("*").alias("n"), F.count_if("derived").alias("derived"))


def shared_neighbour_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that fill a part together."""
    return profile.shared_neighbours(graph(spark, sf).edges["FILLS"].between(None, None, raw=True))


QUERIES = {
    f.__name__: f
    for f in (
        one_hop_count, reverse_hop, two_hop_chain, untyped_endpoint, from_untyped, any_type_edges, unknown_type, self_meeting_pattern, undirected_degree, undirected_hop, optional_match,
        cartesian_scalar, label_disjunction, hop_property_filter, pattern_predicate, negated_pattern_predicate, predicate_in_or, orders_without_lines, hop_through_opening,
        count_distinct_hop, distinct_property_hop, closure_pairs, derived_contains, shared_neighbour_pairs,
    )
}

_LINKED = "(SELECT c_custkey AS c, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS d FROM customer)"
_BOTH = f"(SELECT c, d FROM {_LINKED} WHERE d IS NOT NULL UNION ALL SELECT d, c FROM {_LINKED} WHERE d IS NOT NULL)"

ORACLES = {
    "one_hop_count": "SELECT count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'",
    "reverse_hop": "SELECT 'O:' || o_orderkey AS o, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    "two_hop_chain": "SELECT DISTINCT 'S:' || f.l_suppkey AS s FROM lineitem f JOIN (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 450000) h ON f.l_partkey = h.l_partkey",
    "untyped_endpoint": "SELECT (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_5') + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_5') AS n",
    "from_untyped": "SELECT p_type AS material, count(*) AS n FROM part GROUP BY 1",
    "any_type_edges": """SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 2 * (SELECT count(*) FROM lineitem)
        + (SELECT count(*) FROM (SELECT DISTINCT p_partkey, p_type FROM part)) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
        + (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) + (SELECT count(*) FROM customer) - (SELECT count(DISTINCT c_nationkey) FROM customer) AS n""",
    "unknown_type": "SELECT 0::BIGINT AS n",
    "self_meeting_pattern": "SELECT 'O:' || a.o_orderkey AS a, count(*) AS connections FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_totalprice > 400000 GROUP BY 1 HAVING count(*) > 1",
    "undirected_degree": f"SELECT coalesce(k, 0)::BIGINT AS degree, count(*) AS nodes FROM customer LEFT JOIN (SELECT c, count(*) AS k FROM {_BOTH} GROUP BY c) e ON c_custkey = e.c GROUP BY 1",
    "undirected_hop": f"SELECT 'C:' || b.c AS c, 'C:' || b.d AS d FROM {_BOTH} b JOIN customer ON c_custkey = b.c WHERE c_acctbal > 9500",
    "optional_match": "SELECT parts, count(*) AS n FROM (SELECT o_orderkey, count(DISTINCT l_partkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1",
    "cartesian_scalar": "SELECT n_name AS name, (SELECT max(c_acctbal) FROM customer) AS most FROM nation",
    "label_disjunction": "SELECT 'C:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_1' AND c_acctbal > 0 UNION ALL SELECT 'S:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_1' AND s_acctbal > 0",
    "hop_property_filter": "SELECT 'C:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (contains(n_name, '1') OR contains(n_name, '2')) AND c_acctbal > 9000",
    "pattern_predicate": "SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "negated_pattern_predicate": "SELECT 'O:' || o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "predicate_in_or": "SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) OR o_totalprice > 450000",
    "orders_without_lines": "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1",
    "hop_through_opening": "SELECT count(DISTINCT h.l_orderkey) AS n FROM lineitem h WHERE h.l_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < -900)",
    "count_distinct_hop": "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem",
    "distinct_property_hop": "SELECT DISTINCT c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'",
    "closure_pairs": """WITH RECURSIVE e(src, dst) AS (
          SELECT 'R:' || n_regionkey, 'N:' || n_nationkey FROM nation UNION SELECT 'C:' || o_custkey, 'O:' || o_orderkey FROM orders
          UNION SELECT 'N:' || c_nationkey, 'C:' || c_custkey FROM customer UNION SELECT 'N:' || s_nationkey, 'S:' || s_suppkey FROM supplier),
        up(src, dst) AS (SELECT src, dst FROM e WHERE starts_with(src, 'R:') UNION SELECT up.src, e.dst FROM up JOIN e ON up.dst = e.src)
        SELECT src, count(*) AS n FROM up GROUP BY 1""",
    "derived_contains": "SELECT 'N:' || c_nationkey AS src, count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) AS derived FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "shared_neighbour_pairs": """WITH f AS (SELECT DISTINCT 'S:' || l_suppkey AS s, l_partkey AS p FROM lineitem)
        SELECT DISTINCT x.s AS a, y.s AS b FROM f x JOIN f y ON x.p = y.p AND x.s < y.s""",
}
