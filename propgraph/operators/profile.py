"""What a graph holds: labels, types, signatures, property keys and value enumerations, each in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from propgraph.operators import meetings, store
from propgraph.operators.graph import PropertyGraph

#: How many distinct values make an enumeration, their greatest mean length, and probes per label.
MOST_VALUES, MEAN_LENGTH, PROBES = 50, 80, 12
#: Fixed value: properties that come first.
PRIORITY = ("Name", "LongName", "ObjectType", "PredefinedType", "FireRating", "Material", "Category")
#: Fixed value: properties whose values are never listed.
EXCLUDED = ("GlobalId", "Tag", "OwnerHistory", "ObjectPlacement", "Description", "LongDescription", "Representation")
#: Sources of one target that are compared within one cell.
SOURCES = 1024
#: Pairs of sources, in both orders, that one task of shared_neighbours meets: to make those found in several tasks one, and to find them.
PAIRS, AHEAD = 4 << 20, 64 << 20
#: Rows that one task of shared_neighbours puts into lists, and names that are broadcast.
ROWS, NAMES = 1 << 20, 1 << 20


def label_counts(graph: PropertyGraph) -> DataFrame:
    """(label, n): a node counts once for each of its labels.  Leaves are counted first, so no node row is multiplied."""
    leaves = graph.labelled().groupBy("leaf", "labels").agg(F.count("*").alias("n"))
    return leaves.select(F.explode("labels").alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))


def type_counts(graph: PropertyGraph) -> DataFrame:
    """(type, n) of edges."""
    return graph.all_edges().groupBy("type").agg(F.count("*").alias("n"))


def totals(graph: PropertyGraph) -> DataFrame:
    """One row: nodes, edges."""
    nodes = graph.labelled().agg(F.count("*").alias("nodes"))
    return nodes.join(F.broadcast(graph.all_edges().agg(F.count("*").alias("edges"))), how="cross")


def joined_leaves(graph: PropertyGraph) -> DataFrame:
    """(type, sl, dl): the leaf labels that edges of a type join.  Parts between known leaves are asked for one edge; only others join the nodes."""
    rows = []
    for kind, table in graph.edges.items():
        pairs = table.ends()
        if pairs is None:
            at = graph.labelled().select("node_id", "leaf")
            one = table.df.join(at.select(F.col("node_id").alias("src"), F.col("leaf").alias("sl")), "src")
            pairs = one.join(at.select(F.col("node_id").alias("dst"), F.col("leaf").alias("dl")), "dst").select("sl", "dl").distinct()
        rows.append(pairs.select(F.lit(kind).alias("type"), "sl", "dl"))
    return reduce(DataFrame.unionAll, rows)


def signatures(graph: PropertyGraph) -> DataFrame:
    """(src_label, type, dst_label): the distinct rarest labels that edges of a type join."""
    leaves = [(leaf, k, label) for leaf, t in graph.tables.items() for k, label in enumerate(t.labels)]
    places = graph.labelled().sparkSession.createDataFrame(leaves, "leaf string, place int, label string")
    counts = label_counts(graph)
    rarest = places.join(F.broadcast(counts), "label").groupBy("leaf").agg(F.min_by("label", F.struct("n", "place")).alias("label"))
    named = joined_leaves(graph).join(F.broadcast(rarest.select(F.col("leaf").alias("sl"), F.col("label").alias("src_label"))), "sl")
    return named.join(F.broadcast(rarest.select(F.col("leaf").alias("dl"), F.col("label").alias("dst_label"))), "dl").select("src_label", "type", "dst_label").distinct()


def endpoint_labels(graph: PropertyGraph) -> DataFrame:
    """(type, src_labels, dst_labels): the distinct label lists at the ends of edges."""
    own = F.create_map(*(F.lit(x) for leaf, t in graph.tables.items() for x in (leaf, ":".join(t.labels))))
    return joined_leaves(graph).select("type", own[F.col("sl")].alias("src_labels"), own[F.col("dl")].alias("dst_labels")).distinct()


def _per_key(graph: PropertyGraph, aggregates: Callable[[str], list[Column]]) -> DataFrame:
    """(leaf, labels, key, kind, aggregates): a row per leaf and key with aggregates of its column.

    One aggregate per node table, so no row is multiplied by its properties.
    """
    parts = []
    for leaf, t in graph.tables.items():
        fields = [f for f in t.df.schema.fields if f.name != "node_id"]
        if not fields:
            continue
        own = [F.struct(F.lit(f.name).alias("key"), F.lit(f.dataType.simpleString()).alias("kind"), *aggregates(f.name)) for f in fields]
        parts.append(t.df.agg(F.array(*own).alias("all")).select(F.lit(leaf).alias("leaf"), F.array(*map(F.lit, t.labels)).alias("labels"), F.inline("all")))
    return reduce(DataFrame.unionAll, parts)


def key_statistics(graph: PropertyGraph) -> DataFrame:
    """(leaf, labels, key, kind, n, about): per leaf and key its column type, how many nodes have it, and about how many values there are."""
    return _per_key(graph, lambda name: [F.count(f"`{name}`").alias("n"), F.approx_count_distinct(f"`{name}`").alias("about")])


def known_keys(graph: PropertyGraph) -> DataFrame:
    """(label, key): every property key that occurs on nodes of a label."""
    return _per_key(graph, lambda name: [F.count(f"`{name}`").alias("n")]).where("n > 0").select(F.explode("labels").alias("label"), "key").distinct()


def degrees(graph: PropertyGraph, kind: str, label: str) -> DataFrame:
    """(degree, nodes): how many nodes of a label have so many undirected edges of a type; 0 included."""
    edges = graph.edges[kind].df
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.where("src <> dst").select(F.col("dst").alias("node_id")))
    own = graph.nodes(label).select("node_id")
    count = own.join(ends.groupBy("node_id").agg(F.count("*").alias("n")), "node_id", "left").select(F.coalesce("n", F.lit(0)).alias("degree"))
    return count.groupBy("degree").agg(F.count("*").alias("nodes"))


def priority(name: Column) -> Column:
    """The rank of a property: listed ones first, in their order, then the others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), name), F.lit(0)), F.lit(len(PRIORITY) + 1))


def enumerations(graph: PropertyGraph, excluded: tuple[str, ...] = EXCLUDED, most: int = MOST_VALUES, probes: int = PROBES, strict: tuple[str, ...] = ()) -> DataFrame:
    """(label, key, choices): properties whose values on a label are few, all text, none blank and short on average.

    Of a label's keys the first `probes` by priority and name are looked at, those left out that are excluded or strict
    (their values are listed by a document).  A first pass over each node
    table counts its columns (and about how many values each has, within 5 %), which settles what cannot
    be an enumeration: other types, and more than four times as many values as allowed.  Only what is
    left is grouped by value.
    """
    out = (*excluded, *strict)
    stats = key_statistics(graph).where((F.col("n") > 0) & ~F.col("key").isin(*out)) if out else key_statistics(graph).where("n > 0")
    of_label = stats.select(F.explode("labels").alias("label"), "leaf", "key", "kind", "about")
    place = F.dense_rank().over(Window.partitionBy("label").orderBy(priority(F.col("key")), "key"))
    probed = of_label.withColumn("place", place).where(F.col("place") <= probes)
    text = probed.groupBy("label", "key").agg(F.max("about").alias("about"), F.min(F.col("kind") == "string").alias("text"), F.collect_set("leaf").alias("leaves"))
    wanted = text.where(F.col("text") & (F.col("about") <= 4 * most)).select("label", "key", F.explode("leaves").alias("leaf")).collect()  # a row per label, key and leaf
    columns: dict[str, set[str]] = {}
    for r in wanted:
        columns.setdefault(r["leaf"], set()).add(r["key"])
    spark = graph.labelled().sparkSession
    if not wanted:
        return spark.createDataFrame([], "label string, key string, choices array<string>")
    parts = []
    for leaf, keys in columns.items():
        pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("s")) for k in sorted(keys)))
        values_of = graph.tables[leaf].df.select(F.inline(pairs)).where("s IS NOT NULL")
        parts.append(values_of.groupBy("key", "s").agg(F.count("*").alias("n")).select(F.lit(leaf).alias("leaf"), "key", "s"))
    labels = spark.createDataFrame([(r["label"], r["key"], r["leaf"]) for r in wanted], "label string, key string, leaf string")
    few = reduce(DataFrame.unionAll, parts).join(F.broadcast(labels), ["key", "leaf"]).select("label", "key", "s").distinct()
    own = few.groupBy("label", "key").agg(F.count("*").alias("n"), F.min(F.trim("s") != "").alias("filled"), F.avg(F.length("s")).alias("mean"), F.sort_array(F.collect_list("s")).alias("choices"))
    return own.where(F.col("filled") & F.col("n").between(1, most) & (F.col("mean") <= MEAN_LENGTH)).select("label", "key", "choices")


def class_profile(graph: PropertyGraph) -> DataFrame:
    """(leaf, n, keys): per leaf label its nodes and sorted property keys."""
    n = graph.labelled().groupBy("leaf").agg(F.count("*").alias("n"))
    keys = _per_key(graph, lambda name: [F.count(f"`{name}`").alias("n")]).where("n > 0").groupBy("leaf").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return n.join(keys, "leaf", "left")


def _dealt(lists: DataFrame, block: int, tasks: int) -> DataFrame:
    """(ids, cut) for meetings.meet: lists cut in blocks, every two as a row, dealt by their first numbers.  Lists that begin alike may go to several tasks."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("ids") / block).cast("int") - 1), lambda k: F.slice("ids", k * block + 1, block))
    each = lists.select(blocks.alias("blocks")).select("blocks", F.posexplode("blocks").alias("k", "own"))
    two = each.select("own", F.posexplode(F.slice("blocks", F.col("k") + 1, F.size("blocks"))).alias("on", "other"))
    rows = two.select(F.when(F.col("on") == 0, F.col("own")).otherwise(F.concat("own", "other")).alias("ids"), F.when(F.col("on") == 0, 0).otherwise(F.size("own")).alias("cut"))
    first = F.get("ids", F.lit(0))
    spread = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(tasks, first, F.get("ids", F.col("cut")), "at")
    return spread.sortWithinPartitions(first).select("ids", "cut")


def shared_neighbours(edges: DataFrame, block: int = SOURCES, pairs: int = PAIRS, ahead: int = AHEAD) -> DataFrame:
    """(a, b): pairs of sources that have a target in common, a < b, once each.

    Sources are numbered in an order that has like names side by side.  The numbers of a target are one list;
    a list of more than `block` is cut in blocks, and two of them meet as a row of their own, so that a target with very many
    sources is compared by many tasks.  Lists go by their first number to tasks that meet about `ahead` pairs each (in both
    orders), and such a task gives each pair that it finds once, or again if it can't hold all in between: what is
    sent is about what the result has, not what meets, where targets with much the same sources are many.  Pairs from several tasks become one in as many tasks
    as give each about `pairs` of the pairs that meet.  Edges may repeat and are read twice.  Rows with a null end have no part in it.
    """
    ends = edges.select("src", "dst").dropna()
    seen = Observation()
    counted = ends.groupBy("src").agg(F.count("*").alias("rows")).orderBy(F.length("src"), "src")
    placed = store.kept(counted.observe(seen, F.count("*").alias("names"), F.sum("rows").alias("rows")).select("src", F.monotonically_increasing_id().alias("at")))
    there = store.told(seen)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)  # as numbers of rows are made
    parts = {r["part"]: r["n"] for r in placed.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).collect()}  # a row per file
    before = [sum(n for k, n in parts.items() if k < own) for own in range(max(parts, default=0) + 1)]
    names = placed.select("src", (F.get(F.array(*map(F.lit, before)), part.cast("int")) + place).cast("int").alias("id"))
    known = F.broadcast(names) if (there.get("names") or 0) <= NAMES else names

    lists = ends.join(known, "src").select("dst", "id").repartition(math.ceil((there.get("rows") or 0) / ROWS) + 1, "dst")
    lists = lists.groupBy("dst").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").where(F.size("ids") > 1)
    seen = Observation()
    lists = store.kept(lists.observe(seen, F.sum(F.size("ids").cast("double") * F.size("ids")).alias("met")))
    met = store.told(seen).get("met") or 0.0

    found = _dealt(lists, block, math.ceil(met / ahead) + 1).mapInArrow(meetings.meet, "x int, ys array<int>")
    once = found.repartition(math.ceil(met / pairs) + 1, "x").select("x", F.explode("ys").alias("y")).distinct()
    named = once.join(known.toDF("a", "x"), "x").join(known.toDF("b", "y"), "y")
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
