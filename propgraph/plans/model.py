"""Names, loading, profiling and vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propgraph.functions import names
from propgraph.operators import etl, load, profile, store, vocabulary
from propgraph.operators.graph import PropertyGraph
from propgraph.operators.match import match
from propgraph.plans.aggregation import EDGES, LABELLED
from propgraph.sources.tables import LABELS
from propgraph.sources.tables import trading_graph as graph


def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with blanks, dashes, brackets and reserved words, made from part names and types."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit("Type")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("__"), "p_name", F.lit(" (1/x)--")), ).otherwise(F.concat_ws("..", "p_type", "p_name"))
    return p.select("p_partkey", names.canonical(raw).alias("name"))


def _property_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines seen as property sets: an order is an element, a line a set, and names collide on purpose."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    raw = F.concat_ws(" - ", F.lit("Flag"), "l_returnflag")
    position = F.concat_ws(":", *(F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_linenumber", "l_partkey", "l_suppkey")), F.lpad(F.col("l_quantity").cast("int").cast("string"), 6, "0"))
    return line.select(F.col("l_orderkey").alias("element"), F.col("l_linenumber").alias("pset"), raw.alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value"), position.alias("position"))


def flatten_props(spark: SparkSession, sf: str) -> DataFrame:
    return etl.flatten_properties(_property_rows(spark, sf))


def clashing_names(spark: SparkSession, sf: str) -> DataFrame:
    """The second property of every order is called Flag_1 by itself: the next Flag is Flag_2, where an order has three."""
    rows = _property_rows(spark, sf)
    second = F.row_number().over(Window.partitionBy("element").orderBy("position")) == 2
    return etl.flatten_properties(rows.withColumn("name", F.when(second, "Flag 1").otherwise(F.lit("Flag"))))


def property_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The flattened properties as maps, counted by how many an element has."""
    return etl.property_map(etl.flatten_properties(_property_rows(spark, sf))).groupBy(F.size("props").alias("keys")).agg(F.count("*").alias("n"))


def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """The exact fold where a numbered name is taken already: Flag, Flag_1 as a name of its own, Flag."""
    made = F.array(F.lit("Flag"), F.lit("Flag_1"), F.lit("Flag"), F.col("n_name"), F.lit("Flag"))
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.array_join(names.unique_names(made), ",").alias("names"))


def humanised_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit("IfcBuilding"), F.initcap(F.lower(F.regexp_replace("r_name", "[^A-Za-z]", ""))), F.lit("Storey2"))
    return spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey", names.humanised(label).alias("words"))


def label_closure(spark: SparkSession, sf: str) -> DataFrame:
    """The supertype chain of each class that parts and orders are given."""
    chain = "VALUES ('Root', NULL), ('Element', 'Root'), ('Party', 'Element'), ('Customer', 'Party'), ('Supplier', 'Party'), ('Order', 'Element')"
    hierarchy = spark.sql(f"SELECT * FROM ({chain}) AS t(class, parent)")
    closure = etl.label_closure(hierarchy)
    classes = spark.read.parquet(f"{sf}/customer.parquet").select(F.when(F.col("c_custkey") % 2 == 0, "Customer").otherwise(F.lit("Stranger")).alias("class"))
    return etl.labels_of(classes, closure).groupBy("class", F.array_join("labels", ">").alias("labels")).agg(F.count("*").alias("n"))


def material_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Materials by name: one node each, and one edge per element and material."""
    uses = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("element"), etl.material_name(F.nullif(F.col("p_type"), F.lit("x")), F.array("p_brand"), F.array(), F.array()).alias("material"))
    nodes, edges = etl.materials(uses.unionAll(uses))
    return edges.join(nodes, F.col("dst") == F.col("material_id")).groupBy("Name", "material_id").agg(F.count("*").alias("n"))


def created_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as edges whose part must be of the small sizes: the others vanish, and both counts are reported."""
    g = graph(spark, sf)
    asked = g.edges["IS_OF_TYPE"].df
    nodes = g.nodes("Order").select("node_id").unionAll(g.nodes("Part").where("p_size < 20").select("node_id"))
    made = etl.created_edges(asked, nodes)
    kind = F.lit("IS_OF_TYPE").alias("type")
    return etl.load_statistics(asked.select(kind), made.select(kind))


def observed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts, observed by the pass that makes the edges."""
    g = graph(spark, sf)
    asked = g.edges["IS_OF_TYPE"].df.withColumn("type", F.lit("IS_OF_TYPE"))
    nodes = g.nodes("Order").select("node_id").unionAll(g.nodes("Part").where("p_size < 20").select("node_id"))
    made, submitted, created = load.observed(asked, nodes, ["IS_OF_TYPE"])
    made.write.format("noop").mode("overwrite").save()
    return load.statistics(spark, submitted, created)


def _stored(spark: SparkSession, sf: str, leaves: list[str], kinds: list[str]) -> PropertyGraph:
    """Some tables of the graph, written to a folder of the session and read from there."""
    g = graph(spark, sf)
    path = store.scratch(spark)
    PropertyGraph({k: g.tables[k] for k in leaves}, {k: g.edges[k] for k in kinds}).write(path, both_ways=False)
    return PropertyGraph.read(spark, path)


def id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a stored graph by id, whatever their label; an id that no node has gives no row."""
    g = _stored(spark, sf, ["Nation", "Customer", "Order", "Part"], [])
    return store.lookup(g, "C:7", "O:1", "N:3", "P:12", "X:1", "O:-5").select("node_id", "leaf", F.array_join("labels", ">").alias("labels"), "Name", "o_totalprice", "p_size")


def stored_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with how many parts they open, over a stored graph: buckets of nodes and edges meet without an exchange."""
    m = match(_stored(spark, sf, ["Order", "Part"], ["HAS_OPENING"]), "o", "Order").hop("HAS_OPENING", None, "Part", how="left")
    return m.groupBy(F.col("o.node_id").alias("o")).agg(F.count("_1").alias("parts")).groupBy("parts").agg(F.count("*").alias("n"))


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.label_counts(graph(spark, sf))


def rel_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.type_counts(graph(spark, sf))


def graph_totals(spark: SparkSession, sf: str) -> DataFrame:
    return profile.totals(graph(spark, sf))


def rel_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return profile.signatures(graph(spark, sf))


def endpoint_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return profile.endpoint_labels(graph(spark, sf))


def known_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every label with every key that its nodes have."""
    return profile.known_keys(graph(spark, sf))


def value_enumerations(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.enumerations(graph(spark, sf))
    return found.select("label", "key", F.size("choices").cast("long").alias("n"), F.array_join("choices", "|").alias("choices"))


def class_profiles(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.class_profile(graph(spark, sf))
    return found.select("leaf", "n", F.array_join("keys", ",").alias("keys"))


def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Node ids are keys: none is there twice."""
    return graph(spark, sf).duplicate_ids().agg(F.count("*").alias("n"))


def property_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of the graph's property keys, with a document that lists values for one of them."""
    keys = profile.known_keys(graph(spark, sf)).select(F.col("key").alias("property"))
    document = spark.sql(
        "SELECT * FROM VALUES ('c_mktsegment', 'IFCLABEL', array('BUILDING', 'MACHINERY')), ('c_mktsegment', 'IFCLABEL', array('AUTOMOBILE')), ('p_size', 'IfcInteger', NULL), ('ISEXTERNAL', NULL, NULL), ('NetVolume', NULL, NULL), ('p_brand', 'IfcLabel', NULL), ('p_name', 'xs:TextType', NULL), ('o_totalprice', 'IfcPositiveLengthMeasure', NULL), ('Closed', 'IfcBoolean', NULL) AS t(property, data_type, choices)"
    )
    merged = vocabulary.merge_properties(keys, document.withColumn("choices", F.coalesce("choices", F.array().cast("array<string>"))))
    return merged.select("property", "source", "kind", F.array_join("choices", "|").alias("choices"))


def vocab_union(spark: SparkSession, sf: str) -> DataFrame:
    """Model and document entities, one row per name."""
    counts = profile.label_counts(graph(spark, sf)).select(F.col("label").alias("entity"), "n")
    document = spark.read.parquet(f"{sf}/nation.parquet").select(F.when(F.col("n_nationkey") % 2 == 0, "Nation").otherwise(F.col("n_name")).alias("entity"))
    return vocabulary.merge_entities(counts, document)


def vocab_additions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and relations that the graph adds to a vocabulary of some, and all relations with their edges."""
    g = graph(spark, sf)
    entities = spark.read.parquet(f"{sf}/nation.parquet").select(F.when(F.col("n_nationkey") % 2 == 0, "Nation").otherwise(F.lit("Order")).alias("entity"))
    relations = spark.read.parquet(f"{sf}/region.parquet").select(F.when(F.col("r_regionkey") % 2 == 0, "CONTAINS").otherwise(F.lit("OWNS")).alias("type"))
    types = profile.type_counts(g)
    added = vocabulary.additions(entities, relations, profile.label_counts(g), types).withColumn("n", F.lit(None).cast("long"))
    whole = vocabulary.with_relations(relations, types).select(F.when(F.col("in_vocabulary"), "known").otherwise(F.lit("graph")).alias("kind"), F.col("type").alias("name"), "n")
    return added.unionAll(whole)


def vocab_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Document properties that the graph never has."""
    keys = profile.known_keys(graph(spark, sf)).select("key").distinct()
    wanted = spark.sql("SELECT * FROM VALUES ('Name'), ('Width'), ('p_size'), ('FireRating') AS t(key)")
    return wanted.join(keys, "key", "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        canonical_names, flatten_props, property_maps, unique_names, humanised_labels, label_closure, material_dedup, created_edges, observed_edges, id_lookup, stored_hops, clashing_names, label_counts, rel_type_counts, graph_totals, rel_signatures,
        endpoint_label_pairs, known_keys, value_enumerations, class_profiles, duplicate_ids, property_classes, vocab_union, vocab_difference, vocab_additions,
    )
}

_KEYS = {
    "Region": ("region", ("r_regionkey", "r_name")),
    "Nation": ("nation", ("n_nationkey", "n_name", "n_regionkey")),
    "Customer": ("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "Supplier": ("supplier", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")),
    "Order": ("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "Part": ("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "Material": ("part", ()),
}
_ALL_KEYS = "(" + " UNION ALL ".join(f"SELECT '{leaf}' AS leaf, '{key}' AS key" for leaf, (_, keys) in _KEYS.items() for key in (*keys, *(("Name",) if leaf != "Order" else ()))) + ")"
#: Text properties: (label, place among the label's keys, key, value).
_TEXT = {
    "Region": [("Name", "r_name"), ("r_name", "r_name")],
    "Nation": [("Name", "n_name"), ("n_name", "n_name")],
    "Customer": [("Name", "c_name"), ("c_mktsegment", "c_mktsegment"), ("c_name", "c_name")],
    "Supplier": [("Name", "s_name"), ("s_name", "s_name")],
    "Order": [("o_orderdate", "o_orderdate::VARCHAR"), ("o_orderpriority", "o_orderpriority"), ("o_orderstatus", "o_orderstatus")],
    "Part": [("Name", "p_name"), ("p_brand", "p_brand"), ("p_name", "p_name"), ("p_type", "p_type")],
    "Material": [("Name", "p_type")],
}


def _texts() -> str:
    """(label, key, s): every text property under every label, for keys among the label's first twelve."""
    parts = []
    for leaf, pairs in _TEXT.items():
        for label in LABELS[leaf]:
            under = sorted({k for other, labels in LABELS.items() if label in labels for k in (*_KEYS[other][1], *(("Name",) if other != "Order" else ()))}, key=lambda k: (k != "Name", k))[:12]
            parts += [f"SELECT '{label}' AS label, '{key}' AS key, {col} AS s FROM {_KEYS[leaf][0]}" for key, col in pairs if key in under]
    return "(" + " UNION ALL ".join(parts) + ")"


_CLEAN = "regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '_', 'g')"

ORACLES = {
    "canonical_names": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'ifc_Type' ELSE trim("
    + _CLEAN.format("CASE WHEN p_partkey % 5 = 1 THEN '__' || p_name || ' (1/x)--' ELSE p_type || '..' || p_name END")
    + ", '_') END AS name FROM part",
    "flatten_props": """SELECT l_orderkey AS element, 'Flag_' || l_returnflag || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS key, l_quantity::INT::VARCHAR AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS k FROM lineitem)""",
    "property_maps": "SELECT keys, count(*) AS n FROM (SELECT count(*)::INT AS keys FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
    "unique_names": "SELECT n_nationkey, 'Flag,Flag_1,Flag_2,' || n_name || ',Flag_3' AS names FROM nation",
    "humanised_labels": "SELECT r_regionkey, 'building ' || lower(regexp_replace(r_name, '[^A-Za-z]', '', 'g')) || ' storey 2' AS words FROM region",
    "label_closure": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Customer' ELSE 'Stranger' END AS class, CASE WHEN c_custkey % 2 = 0 THEN 'Customer>Party>Element>Root' ELSE 'Stranger>Root' END AS labels, count(*) AS n FROM customer GROUP BY 1, 2",
    "material_dedup": 'SELECT p_type AS "Name", sha256(p_type) AS material_id, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1',
    "created_edges": "SELECT 'IS_OF_TYPE' AS type, count(*) AS submitted, count(*) FILTER (p_size < 20) AS created FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "label_counts": f"SELECT label, count(*) AS n FROM {LABELLED} GROUP BY 1",
    "rel_type_counts": f"SELECT type, count(*) AS n FROM {EDGES} GROUP BY 1",
    "graph_totals": f"SELECT (SELECT count(*) FROM {LABELLED} WHERE place = 0) AS nodes, (SELECT count(*) FROM {EDGES}) AS edges",
    "rel_signatures": f"""WITH c AS (SELECT label, count(*) AS n FROM {LABELLED} GROUP BY 1),
        r AS (SELECT leaf, arg_min(label, n * 10 + place) AS label FROM (SELECT DISTINCT leaf, label, place FROM {LABELLED}) JOIN c USING (label) GROUP BY 1)
        SELECT DISTINCT a.label AS src_label, type, b.label AS dst_label FROM {EDGES} JOIN r a ON a.leaf = sl JOIN r b ON b.leaf = dl""",
    "endpoint_label_pairs": f"""WITH l AS (SELECT leaf, string_agg(label, ':' ORDER BY place) AS own FROM (SELECT DISTINCT leaf, label, place FROM {LABELLED}) GROUP BY 1)
        SELECT DISTINCT type, a.own AS src_labels, b.own AS dst_labels FROM {EDGES} JOIN l a ON a.leaf = sl JOIN l b ON b.leaf = dl""",
    "known_keys": f"SELECT DISTINCT label, key FROM {_ALL_KEYS} k JOIN (SELECT DISTINCT leaf, label FROM {LABELLED}) l USING (leaf)",
    "value_enumerations": f"SELECT label, key, count(*) AS n, string_agg(s, '|' ORDER BY s) AS choices FROM (SELECT DISTINCT label, key, s FROM {_texts()}) GROUP BY 1, 2 HAVING count(*) BETWEEN 1 AND 50 AND bool_and(trim(s) <> '') AND avg(length(s)) <= 80",
    "class_profiles": f"SELECT leaf, n, string_agg(key, ',' ORDER BY key) AS keys FROM {_ALL_KEYS} JOIN (SELECT leaf, count(*) AS n FROM {LABELLED} WHERE place = 0 GROUP BY 1) USING (leaf) GROUP BY 1, 2",
    "duplicate_ids": """SELECT count(*) AS n FROM (
        SELECT id FROM (SELECT 'R:' || r_regionkey AS id FROM region UNION ALL SELECT 'N:' || n_nationkey FROM nation UNION ALL SELECT 'C:' || c_custkey FROM customer UNION ALL SELECT 'S:' || s_suppkey FROM supplier
          UNION ALL SELECT 'O:' || o_orderkey FROM orders UNION ALL SELECT 'P:' || p_partkey FROM part UNION ALL SELECT DISTINCT 'M:' || p_type FROM part) GROUP BY id HAVING count(*) > 1)""",
    "id_lookup": """SELECT 'C:' || c_custkey AS node_id, 'Customer' AS leaf, 'Customer>Party>Element>Root' AS labels, c_name AS "Name", NULL::DOUBLE AS o_totalprice, NULL::INT AS p_size FROM customer WHERE c_custkey = 7
        UNION ALL SELECT 'O:' || o_orderkey, 'Order', 'Order>Element>Root', NULL, o_totalprice, NULL FROM orders WHERE o_orderkey IN (1, -5)
        UNION ALL SELECT 'N:' || n_nationkey, 'Nation', 'Nation>Spatial>Root', n_name, NULL, NULL FROM nation WHERE n_nationkey = 3
        UNION ALL SELECT 'P:' || p_partkey, 'Part', 'Part>TypeProduct>Root', p_name, NULL, p_size FROM part WHERE p_partkey = 12""",
    "stored_hops": "SELECT parts, count(*) AS n FROM (SELECT o_orderkey, count(DISTINCT l_partkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1",
    "observed_edges": "SELECT 'IS_OF_TYPE' AS type, count(*) AS submitted, count(*) FILTER (p_size < 20) AS created FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "clashing_names": """WITH k AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS n FROM lineitem)
        SELECT l_orderkey AS element, CASE n WHEN 1 THEN 'Flag' WHEN 2 THEN 'Flag_1' ELSE 'Flag_' || (n - 1) END AS key, l_quantity::INT::VARCHAR AS value FROM k""",
    "property_classes": f"""WITH m AS (SELECT DISTINCT key AS property FROM {_ALL_KEYS}), d(property, choices) AS (VALUES ('c_mktsegment', 'AUTOMOBILE|BUILDING|MACHINERY'), ('p_size', ''), ('ISEXTERNAL', ''), ('NetVolume', ''), ('p_brand', ''), ('p_name', ''), ('o_totalprice', ''), ('Closed', ''))
        SELECT property, CASE WHEN m.property IS NULL THEN 'document' WHEN d.property IS NULL THEN 'model' ELSE 'both' END AS source,
          CASE property WHEN 'c_mktsegment' THEN 'STRICT' WHEN 'p_size' THEN 'NUMERIC' WHEN 'o_totalprice' THEN 'NUMERIC' WHEN 'NetVolume' THEN 'NUMERIC' WHEN 'ISEXTERNAL' THEN 'BOOLEAN' WHEN 'Closed' THEN 'BOOLEAN' WHEN 'p_brand' THEN 'STRING' WHEN 'p_name' THEN 'STRING' ELSE 'OPEN' END AS kind, choices
        FROM m FULL JOIN d USING (property)""",
    "vocab_union": f"""WITH m AS (SELECT label AS entity, count(*) AS n FROM {LABELLED} GROUP BY 1), d AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'Nation' ELSE n_name END AS entity FROM nation)
        SELECT entity, coalesce(n, 0)::BIGINT AS n, m.entity IS NOT NULL AS from_model, d.entity IS NOT NULL AS from_document FROM m FULL JOIN d USING (entity)""",
    "vocab_difference": "SELECT unnest(['Width', 'FireRating']) AS key",
    "vocab_additions": f"""WITH t AS (SELECT type, count(*) AS n FROM {EDGES} GROUP BY 1)
        SELECT DISTINCT 'label' AS kind, label AS name, NULL::BIGINT AS n FROM {LABELLED} WHERE label NOT IN ('Nation', 'Order') UNION ALL SELECT 'relation', type, NULL FROM t WHERE type <> 'CONTAINS'
        UNION ALL SELECT CASE WHEN type = 'CONTAINS' THEN 'known' ELSE 'graph' END, type, n FROM t UNION ALL SELECT 'known', 'OWNS', 0""",
}
