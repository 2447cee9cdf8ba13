"""The property graph: typed node tables and edge tables.

Nodes of one leaf label share a wide table (node_id and a column per property), so filters on properties
are pushed to the scan and unused properties are pruned.  A label above leaves is the union of its
leaves' tables.  Edges of one type share a table (src, dst, derived); they form a multigraph.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propgraph.functions import values


@dataclass(frozen=True)
class NodeTable:
    """labels: leaf first, root last.  load: makes the table of node_id and properties, once, when a query first names it."""

    labels: tuple[str, ...]
    load: Callable[[], DataFrame]

    @cached_property
    def df(self) -> DataFrame:
        return self.load()


@dataclass(frozen=True)
class EdgePart:
    """Edges of one type between two leaf labels (None: not known).

    load: makes the table of src, dst and, on edges made by closure, derived = true (null on others).
    merge: of equal pairs one counts; whether a pair is there at all can be asked without merging.
    load_in: the same table laid out by dst, if there is one.
    """

    load: Callable[[], DataFrame]
    src: str | None = None
    dst: str | None = None
    merge: bool = False
    load_in: Callable[[], DataFrame] | None = None

    @cached_property
    def raw(self) -> DataFrame:
        return self.load()

    @cached_property
    def inward(self) -> DataFrame:
        """The same edges, laid out for hops against their direction where there is such a table."""
        return self.load_in() if self.load_in else self.raw

    @cached_property
    def df(self) -> DataFrame:
        return self.raw.distinct() if self.merge else self.raw


@dataclass(frozen=True)
class EdgeTable:
    """The parts of an edge type.  unique: no pair is there twice."""

    parts: tuple[EdgePart, ...]
    unique: bool = False

    @property
    def df(self) -> DataFrame:
        return self.between(None, None)

    def between(self, src: set[str] | None, dst: set[str] | None, raw: bool = False, inward: bool = False) -> DataFrame:
        """The edges whose ends may have these leaf labels (None: any); parts between others are not read.

        raw: equal pairs may repeat.  inward: they are going to be joined by dst.
        """
        fits = lambda leaf, wanted: leaf is None or wanted is None or leaf in wanted
        kept = [p.inward if inward and p.load_in else p.raw if raw else p.df for p in self.parts if fits(p.src, src) and fits(p.dst, dst)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept) if kept else self.parts[0].df.where(F.lit(False))

    def ends(self) -> DataFrame | None:
        """(sl, dl): leaf labels that edges join, a part with any edge being asked for one; None if a part's leaves are not known."""
        if not (self.known("src") and self.known("dst")):
            return None
        return reduce(DataFrame.unionAll, [p.raw.limit(1).select(F.lit(p.src).alias("sl"), F.lit(p.dst).alias("dl")) for p in self.parts])

    def known(self, end: str) -> bool:
        """Whether every part names the leaf of its src or dst."""
        return all(getattr(p, end) is not None for p in self.parts)


def with_ids(pairs: DataFrame, unique: bool) -> DataFrame:
    """src, dst and edge_id: the pair itself where pairs are unique, else with a number among equal pairs."""
    if unique:
        return pairs.withColumn("edge_id", F.concat_ws("\x1f", "src", "dst"))
    n = F.row_number().over(Window.partitionBy("src", "dst").orderBy("src"))
    return pairs.withColumn("edge_id", F.concat_ws("\x1f", "src", "dst", n.cast("string")))


@dataclass
class PropertyGraph:
    tables: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[str, EdgeTable] = field(default_factory=dict)

    def leaves(self, *labels: str) -> list[str]:
        """Leaf labels under any of the labels; none given: all."""
        return [leaf for leaf, t in self.tables.items() if not labels or set(labels) & set(t.labels)]

    def nodes(self, *labels: str) -> DataFrame | None:
        """node_id and properties of the nodes with any of the labels; None if no table has them.  A property of different types is text."""
        found = [self.tables[leaf] for leaf in self.leaves(*labels)]
        if not found:
            return None
        kinds: dict[str, set[str]] = {}
        for t in found:
            for name, kind in t.df.dtypes:
                kinds.setdefault(name, set()).add(kind)
        mixed = {name for name, own in kinds.items() if len(own) > 1}
        parts = [t.df.withColumns({c: F.col(c).cast("string") for c in t.df.columns if c in mixed}) if mixed & set(t.df.columns) else t.df for t in found]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def labelled(self) -> DataFrame:
        """(node_id, leaf, labels) of all nodes."""
        parts = [t.df.select("node_id", F.lit(leaf).alias("leaf"), F.array(*map(F.lit, t.labels)).alias("labels")) for leaf, t in self.tables.items()]
        return reduce(DataFrame.unionAll, parts)

    def properties(self) -> DataFrame:
        """(node_id, leaf, labels, key, value) of every property that a node has: the schema-free form."""
        parts = []
        for leaf, t in self.tables.items():
            names = [f for f in t.df.schema.fields if f.name != "node_id"]
            pairs = F.array(*(F.struct(F.lit(f.name).alias("key"), values.value(F.col(f"`{f.name}`"), f.dataType).alias("value")) for f in names))
            rows = t.df.select("node_id", F.lit(leaf).alias("leaf"), F.array(*map(F.lit, t.labels)).alias("labels"), F.inline(pairs))
            parts.append(rows.where("value IS NOT NULL"))
        return reduce(DataFrame.unionAll, parts)

    def all_edges(self) -> DataFrame:
        """(type, src, dst, derived) of all edges."""
        parts = [e.df.select(F.lit(kind).alias("type"), "src", "dst", F.col("derived") if "derived" in e.df.columns else F.lit(None).cast("boolean").alias("derived")) for kind, e in self.edges.items()]
        return reduce(DataFrame.unionAll, parts)

    def duplicate_ids(self) -> DataFrame:
        """node_ids that more than one node has: empty if ids are the keys they should be."""
        return self.labelled().groupBy("node_id").count().where("count > 1")

    def write(self, path: str, **options: object) -> dict[tuple[str, str], dict[str, int]]:
        """Write the graph in place of what was there (see store.write)."""
        from propgraph.operators import store

        return store.write(self, path, **options)

    @staticmethod
    def read(spark: SparkSession, path: str) -> PropertyGraph:
        """The graph that was written (see store.read)."""
        from propgraph.operators import store

        return store.read(spark, path)
