"""Where results go: CSV rows, JSON summaries and bundles, all written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.operators import store
from propgraph.operators.vocabulary import Vocabulary

#: Fixed value: the columns of a results file.
RESULT_COLUMNS = (
    "question", "experiment_setting", "output_type", "generated_cypher", "gold_cypher", "raw_output", "svr", "scr", "ea", "is_valid_syntax",
    "invalid_labels", "invalid_properties", "num_generated_results", "num_gold_results", "precision", "recall", "f1", "error",
)
#: Fixed value: what a client's file has besides.
CLIENT_COLUMNS = ("index", *RESULT_COLUMNS, "category", "difficulty", "model")
RAW_CHARACTERS = 500


def listed(names: Column) -> Column:
    return F.array_join(F.array_sort(names), ",")


def result_rows(results: DataFrame, columns: tuple[str, ...] = RESULT_COLUMNS) -> DataFrame:
    """The rows of a results file: arrays as sorted lists, raw output cut, absent columns empty."""
    kinds = dict(results.dtypes)

    def cell(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        col = F.col(f"`{name}`")
        if kinds[name].startswith("array"):
            return listed(col).alias(name)
        return F.substring(col, 1, RAW_CHARACTERS).alias(name) if name == "raw_output" else col

    return results.select(*map(cell, columns))


def write_results(results: DataFrame, path: str, columns: tuple[str, ...] = RESULT_COLUMNS) -> None:
    """Blanks and line breaks at the ends of texts are kept."""
    result_rows(results, columns).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


def write_summary(summary: DataFrame, config: dict[str, str], path: str) -> None:
    """One JSON object: timestamp, config and metrics (a summary is one row)."""
    own = F.struct(*(F.lit(v).alias(k) for k, v in sorted(config.items())))
    summary.select(F.current_timestamp().alias("timestamp"), own.alias("config"), F.struct(*summary.columns).alias("metrics")).coalesce(1).write.mode("overwrite").json(path)


def bundle(entities: DataFrame, properties: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row of JSON: the vocabulary, names sorted (a vocabulary is some hundred names)."""
    parts = [df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)) for df, name in ((entities, "entities"), (properties, "properties"), (signatures, "signatures"))]
    one = parts[0].join(F.broadcast(parts[1]), how="cross").join(F.broadcast(parts[2]), how="cross")
    return one.select(F.to_json(F.struct(F.lit(2).alias("schema_version"), "entities", "properties", "signatures")).alias("value"))


def whole_bundle(vocabulary: Vocabulary, stats: dict[str, DataFrame], choices: DataFrame, examples: list[dict[str, str]], source: dict[str, str | None], dump: str | None = None) -> DataFrame:
    """One row of JSON: vocabulary, graph statistics, listed values (label, key, choices) by Label.key, examples and where all is from.

    These are some hundred names, gathered in one row.  A model's dump is not: it is written beside (write_dump), and the
    bundle has its path.  stats: frames by name, such as Engine.vocabulary.
    """
    listed_rows = lambda df: df.agg(F.sort_array(F.collect_list(F.struct(*sorted(df.columns)))).alias("rows"))
    parts = {"entities": vocabulary.entities, "properties": vocabulary.properties, "relations": vocabulary.relations, "signatures": vocabulary.signatures}
    spark = vocabulary.entities.sparkSession
    one = spark.range(1).select()
    for name, df in parts.items():
        one = one.join(listed_rows(df).withColumnRenamed("rows", f"v_{name}"), how="cross")
    for name, df in stats.items():
        one = one.join(listed_rows(df).withColumnRenamed("rows", f"s_{name}"), how="cross")
    pairs = choices.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws(".", "label", "key").alias("k"), F.sort_array("choices").alias("v"))))).alias("value_enumerations"))
    own = F.from_json(F.lit(json.dumps(examples)), "array<map<string,string>>")
    place = F.from_json(F.lit(json.dumps(source)), "map<string,string>")
    return one.join(pairs, how="cross").select(F.to_json(F.struct(
        F.lit(2).alias("schema_version"), place.alias("source"), F.struct(*(F.col(f"v_{n}").alias(n) for n in parts)).alias("combined_vocabulary"), F.struct(*(F.col(f"s_{n}").alias(n) for n in stats)).alias("graph_stats"),
        "value_enumerations", own.alias("few_shot_examples"), F.lit(dump).cast("string").alias("model_dump"),
    )).alias("value"))


def read_whole_bundle(text: DataFrame, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, list[str]], list[dict[str, str]], dict[str, str]]:
    """(frames of the vocabulary by name, listed values, examples, source) of a bundle's row; schemas: DDL fields of each frame."""
    own = ", ".join(f"{n}: array<struct<{ddl}>>" for n, ddl in schemas.items())
    kind = f"schema_version int, source map<string,string>, combined_vocabulary struct<{own}>, value_enumerations map<string,array<string>>, few_shot_examples array<map<string,string>>"
    row = text.select(F.from_json("value", kind).alias("b"))
    told = row.select("b.value_enumerations", "b.few_shot_examples", "b.source").first()
    frames = {n: row.select(F.inline(f"b.combined_vocabulary.{n}")) for n in schemas}
    return frames, dict(told[0] or {}), [dict(e) for e in told[1] or []], dict(told[2] or {})


def read_bundle(text: DataFrame, entities: str, properties: str, signatures: str) -> dict[str, DataFrame]:
    """The frames of a bundle; the schemas are DDL of each list's rows.  A bundle without one of the lists is an error when it is read."""
    schema = f"schema_version int, entities array<struct<{entities}>>, properties array<struct<{properties}>>, signatures array<struct<{signatures}>>"
    row = text.select(F.from_json("value", schema).alias("b"))
    missing = F.raise_error(F.lit("the bundle lacks a list")).cast("boolean")
    kept = row.where(F.when(F.col("b.entities").isNull() | F.col("b.properties").isNull() | F.col("b.signatures").isNull(), missing).otherwise(F.lit(True)))
    return {name: kept.select(F.inline(f"b.{name}")) for name in ("entities", "properties", "signatures")}


def write_dump(nodes: DataFrame, path: str) -> None:
    """Nodes as JSON lines, absent properties left out."""
    nodes.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_array(rows: DataFrame, order: list[str], path: str, json: str = "json", files: int | None = None) -> None:
    """Rows' JSON objects as one JSON array: the part files, joined in the order of their names, are its text, an object a line.

    Rows are sorted by range, so no task sees all of them.  `order` must tell rows apart.  No rows: an empty array.
    files: 1 for a small array that is to be one file (documents.dump reads it).
    """
    keyed = store.kept(rows.select(F.struct(*order).alias("k"), F.col(json).alias("v")))  # read for its ends, its ranges and itself
    ends = keyed.agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"))
    lines = keyed.join(F.broadcast(ends), how="cross").select("k", F.concat(F.when(F.col("k") == F.col("first"), "[").otherwise(F.lit("")), "v", F.when(F.col("k") == F.col("last"), "]").otherwise(F.lit(","))).alias("value"))
    none = ends.where("n = 0").select(F.col("first").alias("k"), F.lit("[]").alias("value"))
    text = lines.unionAll(none).orderBy("k").select("value")
    (text if files is None else text.coalesce(files)).write.mode("overwrite").text(path)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(json) of what write_array wrote: each file is read by as many tasks as its size asks for."""
    inner = F.regexp_replace("value", r"^\[|[,\]]$", "")
    return spark.read.text(path).select(inner.alias("json")).where("json <> ''")
