"""The graph projected from the trading tables: places, parties, orders, products and materials."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.operators.graph import EdgePart, EdgeTable, NodeTable, PropertyGraph

PREFIX = {"Region": "R", "Nation": "N", "Customer": "C", "Supplier": "S", "Order": "O", "Part": "P", "Material": "M"}
LABELS = {
    "Region": ("Region", "Spatial", "Root"),
    "Nation": ("Nation", "Spatial", "Root"),
    "Customer": ("Customer", "Party", "Element", "Root"),
    "Supplier": ("Supplier", "Party", "Element", "Root"),
    "Order": ("Order", "Element", "Root"),
    "Part": ("Part", "TypeProduct", "Root"),
    "Material": ("Material",),
}


def _id(leaf: str, col: str) -> Column:
    return F.concat(F.lit(PREFIX[leaf] + ":"), F.col(col).cast("string"))


def trading_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes and edges as in FIXTURES.md; a table is opened when a query first names it."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nodes(leaf: str, table: str, key: str, name: str | None) -> NodeTable:
        def load() -> DataFrame:
            named = [F.col(name).alias("Name")] if name else []
            df = read(table)
            return df.select(_id(leaf, key).alias("node_id"), *named, *df.columns)

        return NodeTable(LABELS[leaf], load)

    def pairs(table: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        return read(table).select(_id(*src).alias("src"), _id(*dst).alias("dst"))

    def materials() -> DataFrame:
        types = read("part").select(F.col("p_type").alias("Name")).distinct()
        return types.select(_id("Material", "Name").alias("node_id"), "Name")

    def connected() -> DataFrame:
        after = read("customer").select("c_custkey", F.expr("lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey)").alias("after"))
        return after.where("after IS NOT NULL").select(_id("Customer", "c_custkey").alias("src"), _id("Customer", "after").alias("dst"))

    def part(src: str, dst: str, load: Callable[[], DataFrame], merge: bool = False) -> EdgePart:
        return EdgePart(load, src, dst, merge)

    order, product, supplier = ("Order", "l_orderkey"), ("Part", "l_partkey"), ("Supplier", "l_suppkey")
    return PropertyGraph(
        {
            "Region": nodes("Region", "region", "r_regionkey", "r_name"),
            "Nation": nodes("Nation", "nation", "n_nationkey", "n_name"),
            "Customer": nodes("Customer", "customer", "c_custkey", "c_name"),
            "Supplier": nodes("Supplier", "supplier", "s_suppkey", "s_name"),
            "Order": nodes("Order", "orders", "o_orderkey", None),
            "Part": nodes("Part", "part", "p_partkey", "p_name"),
            "Material": NodeTable(LABELS["Material"], materials),
        },
        {
            "DECOMPOSES": EdgeTable(
                (
                    part("Region", "Nation", lambda: pairs("nation", ("Region", "n_regionkey"), ("Nation", "n_nationkey"))),
                    part("Customer", "Order", lambda: pairs("orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"))),
                ),
                True,
            ),
            "CONTAINS": EdgeTable(
                (
                    part("Nation", "Customer", lambda: pairs("customer", ("Nation", "c_nationkey"), ("Customer", "c_custkey"))),
                    part("Nation", "Supplier", lambda: pairs("supplier", ("Nation", "s_nationkey"), ("Supplier", "s_suppkey"))),
                ),
                True,
            ),
            "IS_OF_TYPE": EdgeTable((part("Order", "Part", lambda: pairs("lineitem", order, product)),)),
            "HAS_MATERIAL": EdgeTable((part("Part", "Material", lambda: pairs("part", ("Part", "p_partkey"), ("Material", "p_type")), True),), True),
            "BOUNDED_BY": EdgeTable((part("Order", "Supplier", lambda: pairs("lineitem", order, supplier)),)),
            "HAS_OPENING": EdgeTable((part("Order", "Part", lambda: pairs("lineitem", order, product), True),), True),
            "FILLS": EdgeTable((part("Supplier", "Part", lambda: pairs("lineitem", supplier, product), True),), True),
            "CONNECTED_TO": EdgeTable((part("Customer", "Customer", connected),), True),
        },
    )
