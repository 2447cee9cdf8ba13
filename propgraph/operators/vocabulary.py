"""The vocabulary: what a requirement document and a model say of entities and properties, merged.

Frames: entities (entity, n, from_model, from_document), properties (property, source, kind, choices),
signatures (src_label, type, dst_label).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Property names of boolean and numeric kind in lower case, and what document types contain.
BOOLEANS = ("isexternal", "loadbearing", "isclosed", "islandmark", "compartmentation", "status")
NUMBERS = (
    "height", "width", "length", "depth", "thickness", "area", "volume", "netarea", "grossarea", "netvolume", "grossvolume",
    "perimeter", "slope", "rise", "run", "nominalheight", "nominalwidth", "nominallength", "thermaltransmittance",
)
NUMERIC_TYPES = ("REAL", "INTEGER", "LENGTH", "AREA", "VOLUME")
TEXT_TYPES = ("LABEL", "TEXT")


def merge_entities(model: DataFrame, document: DataFrame) -> DataFrame:
    """Model entities (entity, n) and document entities (entity), one row per name; the document's own have no nodes."""
    left = model.select("entity", "n", F.lit(True).alias("m"))
    right = document.select("entity").distinct().withColumn("d", F.lit(True))
    both = left.join(right, "entity", "full")
    return both.select("entity", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("m", F.lit(False)).alias("from_model"), F.coalesce("d", F.lit(False)).alias("from_document"))


def merge_properties(model: DataFrame, document: DataFrame) -> DataFrame:
    """Model properties (property) and document properties (property, data_type, choices): source model, document or both."""
    left = model.select("property").distinct().withColumn("m", F.lit(True))
    right = document.groupBy("property").agg(F.max("data_type").alias("data_type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("choices")))).alias("choices")).withColumn("d", F.lit(True))
    both = left.join(right, "property", "full")
    source = F.when(F.col("m") & F.col("d"), "both").when(F.col("m"), "model").otherwise("document")
    return both.select("property", source.alias("source"), "data_type", "choices", classify(F.col("property"), F.col("data_type"), F.col("choices")).alias("kind"))


def classify(name: Column, data_type: Column, choices: Column) -> Column:
    """STRICT if its values are listed; BOOLEAN by name (listed, or beginning with is); NUMERIC by name; else by what the document's type contains (BOOLEAN, NUMERIC, STRING); else OPEN.  In any case of letters."""
    kind, lower = F.upper(F.coalesce(data_type, F.lit(""))), F.lower(name)
    among = lambda parts: reduce(lambda a, b: a | b, (kind.contains(p) for p in parts))
    return (
        F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, "STRICT")
        .when(lower.isin(*BOOLEANS) | lower.startswith("is"), "BOOLEAN")
        .when(lower.isin(*NUMBERS), "NUMERIC")
        .when(kind.contains("BOOLEAN"), "BOOLEAN")
        .when(among(NUMERIC_TYPES), "NUMERIC")
        .when(among(TEXT_TYPES), "STRING")
        .otherwise("OPEN")
    )


def with_graph(entities: DataFrame, properties: DataFrame, label_counts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary corrected by a graph: its labels are added, properties it never has are dropped (none, if it lists no keys)."""
    more = label_counts.select(F.col("label").alias("entity"), "n").join(entities, "entity", "left_anti")
    added = more.select("entity", "n", F.lit(True).alias("from_model"), F.lit(False).alias("from_document"))
    seen = keys.select(F.col("key").alias("property")).distinct()
    kept = properties if seen.isEmpty() else properties.join(seen, "property", "left_semi")
    return entities.unionByName(added), kept


def merge(document: tuple[DataFrame, DataFrame] | None, model: tuple[DataFrame, DataFrame] | None, graph: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and properties of a document, a model and a graph, each of which may be absent.

    document: (entity) and (property, data_type, choices); model: (entity, n) and (property); graph: label counts and
    known keys.  First the entities and properties are merged, then corrected by the graph.
    """
    given = document or model or graph
    if given is None:
        raise ValueError("a vocabulary needs a document, a model or a graph")
    nothing = lambda schema: given[0].sparkSession.createDataFrame([], schema)
    own = document or (nothing("entity string"), nothing("property string, data_type string, choices array<string>"))
    seen = model or (nothing("entity string, n long"), nothing("property string"))
    if model is None and graph is not None:
        seen = (seen[0], graph[1].select(F.col("key").alias("property")).distinct())
    entities, properties = merge_entities(seen[0], own[0]), merge_properties(seen[1], own[1])
    return (entities, properties) if graph is None else with_graph(entities, properties, *graph)


@dataclass(frozen=True)
class Vocabulary:
    """entities and properties as above, relations (type, n: edges of the graph, in_vocabulary), signatures (src_label, type, dst_label)."""

    entities: DataFrame
    properties: DataFrame
    relations: DataFrame
    signatures: DataFrame


def with_relations(relations: DataFrame, type_counts: DataFrame) -> DataFrame:
    """(type, n, in_vocabulary): relations (type) and those of a graph (type, n), one row each; the graph's own are new."""
    own = relations.select("type").distinct().withColumn("v", F.lit(True))
    return own.join(type_counts.select("type", "n"), "type", "full").select("type", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", F.lit(False)).alias("in_vocabulary"))


def additions(entities: DataFrame, relations: DataFrame, label_counts: DataFrame, type_counts: DataFrame) -> DataFrame:
    """(kind, name): labels and relations that a graph has and a vocabulary (entities, relations: type) has not."""
    labels = label_counts.where(F.col("label") != "").select("label").distinct().join(entities, F.col("label") == F.col("entity"), "left_anti")
    types = type_counts.select("type").distinct().join(relations.select(F.col("type").alias("_t")), F.col("type") == F.col("_t"), "left_anti")
    return labels.select(F.lit("label").alias("kind"), F.col("label").alias("name")).unionAll(types.select(F.lit("relation"), "type"))


def merge_whole(document: tuple[DataFrame, DataFrame] | None, model: tuple[DataFrame, DataFrame] | None, relations: DataFrame, graph: dict[str, DataFrame]) -> Vocabulary:
    """The vocabulary of a document, a model with its relations (type) and a graph's labels, types, signatures and keys (Engine.vocabulary).

    Entities and properties as in `merge`; the graph's relations are added to the model's, and signatures are the graph's.
    """
    entities, properties = merge(document, model, (graph["labels"], graph["keys"]))
    return Vocabulary(entities, properties, with_relations(relations, graph["types"]), graph["signatures"].select("src_label", "type", "dst_label"))


def named(properties: DataFrame, name: str) -> DataFrame:
    """The property of a name: exactly, else in any case."""
    exact = properties.where(F.col("property") == name).withColumn("_r", F.lit(0))
    other = properties.where(F.lower("property") == name.lower()).withColumn("_r", F.lit(1))
    return exact.unionByName(other).orderBy("_r", "property").limit(1).drop("_r")


def relation_between(signatures: DataFrame, src: str, dst: str) -> str | None:
    """The first type, in order, that joins two labels."""
    row = signatures.where((F.col("src_label") == src) & (F.col("dst_label") == dst)).agg(F.min("type")).first()
    return row[0]


def schema_text(entities: DataFrame, properties: DataFrame, signatures: DataFrame, most_open: int = 15) -> str:
    """The vocabulary as text for a prompt.  A vocabulary is a few hundred names: it is read by the driver."""
    names = [r["entity"] for r in entities.where("n > 0 OR from_document").orderBy("entity").select("entity").collect()]
    props = properties.orderBy("property").select("property", "kind", "choices").collect()
    lines = ["Node labels: " + ", ".join(names)]
    strict = [p for p in props if p["kind"] == "STRICT"]
    rest = [p["property"] for p in props if p["kind"] != "STRICT"]
    lines += [f"{p['property']}: one of {', '.join(p['choices'])}" for p in strict]
    shown = rest[:most_open]
    lines.append("Properties: " + ", ".join(shown) + (f" and {len(rest) - most_open} more" if len(rest) > most_open else ""))
    for r in signatures.groupBy("type").agg(F.sort_array(F.collect_set(F.concat_ws("->", "src_label", "dst_label"))).alias("ends")).orderBy("type").collect():
        lines.append(f"{r['type']}: " + ", ".join(r["ends"]))
    return "\n".join(lines)


def few_shot_examples(graph_counts: dict[str, int], signatures: list[tuple[str, str, str]], choices: dict[tuple[str, str], list[str]], numeric: dict[str, list[str]], most: int = 6) -> list[dict[str, str]]:
    """Question and query pairs whose preconditions the graph meets, without repeats, the first `most`."""
    out: list[dict[str, str]] = []
    words = lambda label: " ".join(re.findall("[A-Z][a-z]*|[0-9]+", label.removeprefix("Ifc"))).lower() or label
    present = sorted((label for label, n in graph_counts.items() if n > 0), key=lambda x: (-graph_counts[x], x))
    if present:
        out.append({"question": f"How many {words(present[0])} nodes are there?", "query": f"MATCH (n:{present[0]}) RETURN count(n)"})
    for (label, key), own in sorted(choices.items()):
        if graph_counts.get(label, 0) > 0 and own:
            out.append({"question": f"How many {words(label)} nodes have {key} {own[0]}?", "query": f"MATCH (n:{label}) WHERE n.{key} = '{own[0]}' RETURN count(n)"})
            break
    for src, kind, dst in sorted(signatures):
        out.append({"question": f"How many {words(dst)} nodes does each {words(src)} reach by {kind}?", "query": f"MATCH (a:{src})-[:{kind}]->(b:{dst}) RETURN a.Name, count(b)"})
    for label, keys in sorted(numeric.items()):
        if keys and graph_counts.get(label, 0) > 0:
            key = sorted(keys)[0]
            out.append({"question": f"What is the total {key} of {words(label)} nodes?", "query": f"MATCH (n:{label}) RETURN sum(n.{key})"})
            out.append({"question": f"Which {words(label)} has the largest {key}?", "query": f"MATCH (n:{label}) RETURN n.Name ORDER BY n.{key} DESC LIMIT 1"})
            break
    seen: set[str] = set()
    return [e for e in out if not (e["query"] in seen or seen.add(e["query"]))][:most]
