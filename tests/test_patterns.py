"""Distinct columns of patterns: semi-join reduction gives what the whole match gives, and multiplies nothing it need not."""

import random

import pytest
from pyspark.sql import functions as F

from propgraph.operators.graph import EdgePart, EdgeTable, NodeTable, PropertyGraph
from propgraph.operators.match import match
from propgraph.plans import traversal


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(2)
    node = lambda leaf, n: spark.createDataFrame([(f"{leaf}{k}", k % 3, f"n{k % 4}") for k in range(n)], "node_id string, v int, Name string")
    tables = {leaf: NodeTable((leaf, "Root"), lambda leaf=leaf: node(leaf, 6)) for leaf in "ABC"}
    pair = lambda x, y, n: spark.createDataFrame([(f"{x}{r.randrange(8)}", f"{y}{r.randrange(8)}") for _ in range(n)], "src string, dst string").cache()  # noqa: E731  (some ends are no nodes)
    part = lambda x, y, n: (lambda df: EdgePart(lambda: df, x, y))(pair(x, y, n))
    return PropertyGraph(tables, {"R": EdgeTable((part("A", "B", 14), part("B", "C", 9))), "S": EdgeTable((part("C", "B", 12),)), "T": EdgeTable((EdgePart(lambda df=pair("A", "A", 9): df),))})


PATTERNS = {
    "chain": (lambda g: match(g, "a", "A").hop("R", None, "B").hop("S", "c", "C", direction="in").where(F.col("c.v") > 0), ["a.node_id"]),
    "far end": (lambda g: match(g, "a", "A").where(F.col("a.v") == 1).hop("R", "b", "B").hop("R", "c", "C"), ["c.Name"]),
    "middle": (lambda g: match(g, "a", "A").hop("R", "b", "B").hop("R", "c", "C").where("a.v < 2", F.col("c.v") != 1), ["b.node_id", "b.v"]),
    "two ends": (lambda g: match(g, "a", "A").hop("R", "b", "B").hop("R", "c", "C"), ["a.node_id", "c.node_id"]),
    "star": (lambda g: match(g, "b", "B").hop("R", "c", "C").from_("b").hop("S", "d", direction="in").from_("b").hop("R", "a", "A", direction="in").where(F.col("d.v") > 0), ["b.Name", "a.v"]),
    "shared condition": (lambda g: match(g, "a", "A").hop("R", "b", "B").where(F.col("a.v") == F.col("b.v")).hop("R", "c", "C"), ["a.node_id"]),
    "optional": (lambda g: match(g, "a", "A").hop("R", "b", "B", how="left"), ["a.Name"]),
    "optional needed": (lambda g: match(g, "a", "A").hop("R", "b", "B", how="left"), ["a.Name", "b.node_id"]),
    "inner after optional": (lambda g: match(g, "a", "A").hop("R", "b", "B", how="left").hop("R", "c", "C"), ["a.Name"]),
    "undirected": (lambda g: match(g, "b", "B").hop("R", "x", direction="both").where(F.col("x.v") == 1), ["b.node_id"]),
    "any type": (lambda g: match(g, "b", "B").hop(None, "x").where("x.v > 0"), ["b.node_id"]),
    "unknown leaves": (lambda g: match(g, "a", "A").hop("T", None, "A").hop("R", "b", "B"), ["a.node_id"]),
    "semi": (lambda g: match(g, "a", "A").having("R", "B").hop("R", "b").lacking("S", direction="in"), ["a.node_id", "b.v"]),
    "flag": (lambda g: match(g, "a", "A").flagged("f", "R", "B").where(F.col("f") | (F.col("a.v") == 0)), ["a.node_id"]),
    "edges once": (lambda g: match(g, "a", "A").hop("R", "b", "B", same_type_again=True).hop("R", "c", "A", direction="in", same_type_again=True), ["a.node_id"]),
    "nothing": (lambda g: match(g, "a", "A").hop("NONE", "b"), ["a.node_id"]),
    "expression": (lambda g: match(g, "a", "A").hop("R", "b", "B").where(F.expr("b['v'] > 0")), ["a.node_id"]),
}


@pytest.mark.parametrize("name", PATTERNS)
def test_distinct_is_that_of_the_whole_match(graph, name):
    make, columns = PATTERNS[name]
    m = make(graph)
    cols = [F.col(c).alias(c.replace(".", "_")) for c in columns]
    assert sorted(map(str, m.distinct(*cols).collect())) == sorted(map(str, m.select(*cols).distinct().collect()))


def test_plan_of_a_chain(spark, sf):
    """Two hops to a condition, of which only the start is asked for: semi joins, no pair of ends."""
    plan = traversal.two_hop_chain(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 3 and "Join Inner" not in plan
