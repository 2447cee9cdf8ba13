"""From building-model rows to nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propgraph.functions import names, values
from propgraph.operators import store
from propgraph.sources import step

#: Fixed value: raw names that never become properties.
SKIPPED = ("id", "type", "GlobalId", "OwnerHistory")


def flatten_properties(rows: DataFrame, element: str = "element", group: str = "pset", name: str = "name", value: str = "value", position: str = "position") -> DataFrame:
    """(element, key, value): canonical property names, made unique within an element in order of position.

    Skipped and null values go.  Names that canonicalise alike within an element become name, name_1, name_2: the
    first that is free.  Where no property is called like a number's name by itself that is the rank among equal
    names, so an element's properties are not gathered; the others' elements take their names in order, as one array.
    The rows are computed once and written to the shared folder when this is called.
    """
    found = rows.where(F.col(value).isNotNull() & ~F.col(name).isin(*SKIPPED)).withColumn("_key", names.canonical(F.col(name))).where("_key <> ''")
    kept = store.kept(found.select(*dict.fromkeys((element, group, value, position, "_key"))))
    numbered = r"^(.+)_([1-9][0-9]{0,8})$"
    likely = kept.where(F.col("_key").rlike(numbered)).select(F.col(element).alias("_e"), F.regexp_extract("_key", numbered, 1).alias("_of"), F.regexp_extract("_key", numbered, 2).cast("long").alias("_m")).distinct()
    counts = kept.groupBy(element, "_key").agg(F.count("*").alias("_n")).where("_n > 1")
    taken = counts.join(likely, (F.col(element) == F.col("_e")) & (F.col("_key") == F.col("_of")) & (F.col("_n") > F.col("_m"))).select("_e").distinct()
    rank = F.row_number().over(Window.partitionBy(element, "_key").orderBy(position, group, value)) - 1
    easy = kept.join(taken, F.col(element) == F.col("_e"), "left_anti").withColumn("_n", rank)
    ranked = easy.select(element, F.when(F.col("_n") == 0, F.col("_key")).otherwise(F.concat_ws("_", "_key", F.col("_n").cast("string"))).alias("key"), F.col(value).alias("value"))
    hard = kept.join(taken, F.col(element) == F.col("_e"), "left_semi")
    own = hard.groupBy(element).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(group).alias("g"), F.col("_key").alias("k"), F.col(value).alias("v")))).alias("all"))
    paired = own.select(element, F.arrays_zip(names.unique_names(F.col("all.k")).alias("key"), F.col("all.v").alias("value")).alias("pairs"))
    return ranked.unionAll(paired.select(element, F.inline("pairs")))


def property_map(flat: DataFrame, element: str = "element") -> DataFrame:
    """(element, props): the flattened properties as a map."""
    return flat.groupBy(element).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))


def merged(base: Column, flat: Column) -> Column:
    """A node's own attributes with its property sets over them: on equal names the sets win, null attributes go."""
    own = F.map_filter(base, lambda k, v: v.isNotNull())
    sets = F.coalesce(flat, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(sets, k)), sets)


def label_closure(supertypes: DataFrame) -> DataFrame:
    """(leaf, labels): a class and all its supertypes, leaf first, root last, from (class, parent) rows (root: null parent).

    A class hierarchy is a small dimension, so the walk is a recursive query over it.
    """
    rows = supertypes.select("class", "parent").sparkSession.sql(
        """
        WITH RECURSIVE up(leaf, label, depth) AS (
          SELECT class, class, 0 FROM {supertypes}
          UNION ALL
          SELECT up.leaf, s.parent, up.depth + 1 FROM up JOIN {supertypes} s ON up.label = s.class WHERE s.parent IS NOT NULL
        )
        SELECT leaf, label, depth FROM up""",
        supertypes=supertypes,
    )
    return rows.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "label"))).alias("own")).select("leaf", F.col("own.label").alias("labels"))


def labels_of(classes: DataFrame, closure: DataFrame, root: str = "Root") -> DataFrame:
    """classes (class, ...) with labels: the closure's, or class and root where the class is unknown.  The closure is a class hierarchy, small enough to broadcast."""
    return classes.join(F.broadcast(closure), classes["class"] == closure["leaf"], "left").drop("leaf").withColumn("labels", F.coalesce("labels", F.array("class", F.lit(root))))


def related_pairs(relations: DataFrame, one: str, many: str) -> DataFrame:
    """(src, dst) of relation rows that relate one id to an array of ids; missing ends vanish."""
    return relations.select(F.col(one).alias("src"), F.explode(many).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def created_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs both of whose ends are nodes; repeated pairs stay, as edges are a multigraph."""
    ids = nodes.select(F.col("node_id"))
    return pairs.join(ids, F.col("src") == F.col("node_id"), "left_semi").join(ids, F.col("dst") == F.col("node_id"), "left_semi")


def material_name(name: Column, layers: Column, layer_sets: Column, constituents: Column) -> Column:
    """The representative of an association: its own name, or the first layer's or constituent's."""
    return F.coalesce(name, F.get(layers, F.lit(0)), F.get(layer_sets, F.lit(0)), F.get(constituents, F.lit(0)))


def materials(uses: DataFrame, element: str = "element", name: str = "material") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (element, material) rows: one node per material name, one edge per pair; the id is a digest of the name."""
    named = uses.where(F.col(name).isNotNull()).select(F.col(element).alias("src"), F.col(name).alias("Name"), F.sha2(name, 256).alias("material_id"))
    nodes = named.select("material_id", "Name").dropDuplicates(["material_id"])
    return nodes, named.select("src", F.col("material_id").alias("dst")).distinct()


def load_statistics(submitted: DataFrame, created: DataFrame) -> DataFrame:
    """(type, submitted, created): how many edges were asked for and how many there are."""
    asked = submitted.groupBy("type").agg(F.count("*").alias("submitted"))
    made = created.groupBy("type").agg(F.count("*").alias("created"))
    return asked.join(made, "type", "full").select("type", F.coalesce("submitted", F.lit(0)).alias("submitted"), F.coalesce("created", F.lit(0)).alias("created"))


def first_per_type(rows: DataFrame, kind: str, order: list[str], limit: int) -> DataFrame:
    """At most `limit` rows of each type, in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def dump_properties(rows: DataFrame, element: str = "element") -> DataFrame:
    """(element, props) as model dumps have them: (element, position, name, value) rows, where the last of equal names wins."""
    named = rows.where("value IS NOT NULL").withColumn("key", names.dump_name(F.col("name")))
    last = named.groupBy(element, "key").agg(F.max_by("value", "position").alias("value"))
    return property_map(last, element)


def quantity(*parts: Column) -> Column:
    """A quantity's value: the first of length, area, volume, count, weight and time that is there, as a float."""
    return F.coalesce(*(p.cast("double") for p in parts))


def objects(base: DataFrame, props: DataFrame, element: str = "element") -> DataFrame:
    """(element, json): a JSON object for each row of base, its columns first, then (element, position, name, json) properties by name.

    Null columns and values are left out.  Names take the looser form of dumps; of equal ones the last by position
    wins, also over a column of base, whose place it takes.
    """
    fields = [c for c in base.columns if c != element]
    named = props.where("json IS NOT NULL").withColumn("key", names.dump_name(F.col("name")))
    last = named.groupBy(element, "key").agg(F.max_by("json", "position").alias("json"))
    own = last.groupBy(element).agg(F.map_from_entries(F.collect_list(F.struct("key", "json"))).alias("_props"))
    kept = base.join(own, element, "left").withColumn("_props", F.coalesce("_props", F.create_map().cast("map<string,string>")))
    kinds = dict(base.dtypes)
    plain = lambda c: F.col(f"`{c}`").cast("string") if kinds[c] in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") else values.json_text(F.col(f"`{c}`"))
    entry = lambda key, json: F.concat(values.json_text(key), F.lit(": "), json)  # noqa: E731  null of a null value
    first = F.array(*(entry(F.lit(c), F.coalesce(F.col("_props")[c], plain(c))) for c in fields))
    rest = F.array_sort(F.filter(F.map_keys("_props"), lambda k: ~k.isin(*fields)))
    body = F.array_compact(F.concat(first, F.transform(rest, lambda k: entry(k, F.col("_props")[k]))))
    return kept.select(element, F.concat(F.lit("{"), F.array_join(body, ", "), F.lit("}")).alias("json"))


def products(records: DataFrame, limit: int | None = None) -> DataFrame:
    """(file, id, type, json): a JSON object for each product of STEP records: id, type, name, description, object type and its own sets' values.

    limit: at most so many of each file and type, the first by number.  Types' sets are no part of a dump.
    """
    own = step.nodes(records).where(step.is_a(F.col("class"), "IfcProduct"))
    if limit is not None:
        own = own.withColumn("_kind", F.struct("file", "class"))
        own = first_per_type(own, "_kind", ["id"], limit).drop("_kind")
    base = own.select("node_id", F.col("node_id").alias("GlobalId"), F.col("class").alias("type"), "Name", "Description", "ObjectType")
    wanted = own.select("node_id").distinct() if limit is not None else None
    props = step.property_rows(records, inherit=False, wanted=wanted).withColumnRenamed("element", "node_id")
    made = objects(base.dropDuplicates(["node_id"]), props, "node_id")
    return own.select("file", "id", F.col("class").alias("type"), "node_id").join(made, "node_id").select("file", "id", "type", "json")
