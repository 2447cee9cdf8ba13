"""Reports over scored outputs: means by output type and setting, the client's summary, the comparison of settings.

Results are rows of scoring.evaluate (svr, scr, ea, precision, recall, f1, gold) with the columns that each report
names.  Every report is one grouping; what the driver reads are rows per setting, level and category.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propgraph.operators import grammar, scoring, wellformed
from propgraph.operators.closure import keep
from propgraph.operators.prompts import SETTINGS

#: The output types, and the metrics that settings are ranked by.
QUERY, DIRECT = "cypher", "direct_qa"
RANKED = ("ea_mean", "svr_mean", "scr_mean", "f1_mean")
#: Fixed value: the place of a setting that is not known.
LAST = 99
MEANS = ("svr", "scr", "ea", "precision", "recall", "f1")


def syntax_validity(output: Column, output_type: Column, regex: str | None) -> Column:
    """1.0 or 0.0: a query text is held against the grammar (None: must hang together, whatever it names), any other output must be a JSON list."""
    query = wellformed.well_formed(output) if regex is None else grammar.accepted(output, regex)
    valid = F.when(output_type == QUERY, query).otherwise(scoring.valid_answer(output))
    return F.coalesce(valid, F.lit(False)).cast("double")


def compliance(output: Column, output_type: Column, labels: Column, properties: Column) -> Column:
    """The share of valid names in a query text; 1.0 for a direct answer, which names none."""
    return F.when(output_type == QUERY, scoring.schema_compliance(output, labels, properties)["scr"]).otherwise(F.lit(1.0))


def by_output_type(results: DataFrame) -> DataFrame:
    """One row: valid and perfect outputs, and means per output_type; null where a type has no output."""
    perfect = (F.col("svr") == 1) & (F.col("scr") == 1) & (F.col("ea") == 1)
    parts = [(QUERY, "svr"), (QUERY, "scr"), (QUERY, "ea"), (DIRECT, "svr"), (DIRECT, "ea")]
    means = [F.avg(F.when(F.col("output_type") == kind, F.col(m))).alias(f"{kind}_{m}_mean") for kind, m in parts]
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("svr") > 0).alias("valid"), F.count_if(perfect).alias("perfect"), *means)


def gold_statistics(gold: DataFrame) -> DataFrame:
    """One row of (index, gold): cases, tokens of all, and cases whose gold is not empty.  Null gold is empty."""
    size = F.coalesce(F.size(F.array_compact("gold")), F.lit(0))
    return gold.agg(F.count("*").alias("cases"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("tokens"), F.count_if(size > 0).alias("non_empty"))


def client_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of a client's rows, absent scores counting as 0, over all and over rows with gold; no rows: counts of 0."""
    filled = F.coalesce(F.col("num_gold_results"), F.lit(0)) > 0
    score = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in MEANS}
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("count"),
        *(F.avg(score[m]).alias(f"{m}_mean") for m in MEANS),
        F.count_if("is_valid_syntax").alias("syntax_valid_count"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("error_count"),
        F.count_if(filled).alias("non_trivial_count"),
        *(F.coalesce(F.avg(F.when(filled, score[m])), F.lit(0.0)).alias(f"{m}_mean_non_trivial") for m in MEANS[2:]),
    )


def client_difficulties(rows: DataFrame) -> DataFrame:
    """The client's means by difficulty as written (letters keep their case); none is unknown."""
    named = rows.withColumn("difficulty", F.when(F.coalesce("difficulty", F.lit("")) == "", "unknown").otherwise(F.col("difficulty")))
    return client_summary(named, ["difficulty"]).select("difficulty", "count", "ea_mean", "f1_mean")


def setting_place(setting: Column, settings: tuple[str, ...] = SETTINGS) -> Column:
    """The place of a setting in the fixed order, unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, settings)), setting)
    return F.when(at > 0, at - 1).otherwise(F.lit(LAST)).cast("int")


def in_group_order(groups: DataFrame, model: str = "model", setting: str = "setting") -> DataFrame:
    """Groups by model, then by the fixed order of settings; unknown settings by name."""
    return groups.orderBy(model, setting_place(F.col(setting)), setting)


def comparison(results: DataFrame, settings: tuple[str, ...] = SETTINGS) -> dict[str, DataFrame]:
    """The parts of a comparison of results (also setting, difficulty, category): a frame per part.

    setting_results: means by setting; complexity_results: by setting and difficulty; category_results: by setting
    and category; ranking: settings by each metric, best first, ties in the order of the settings.
    """
    rows = keep(grouped(results))  # a row per setting, level and category
    part = lambda name, *level: rows.where(F.col("part") == name).select("setting", *level, *(c for c in rows.columns if c not in ("part", "setting", "level")))
    means = part("all")
    return {
        "setting_results": means,
        "complexity_results": part("difficulty", F.col("level").alias("difficulty")),
        "category_results": part("category", F.col("level").alias("category")),
        "ranking": scoring.ranking(means, "setting", list(RANKED), settings),
    }


def grouped(results: DataFrame) -> DataFrame:
    """(part, setting, level, metrics): means by setting, by setting and difficulty, by setting and category, in one pass over the results."""
    named = results.withColumn("difficulty", scoring.difficulty(F.col("difficulty"))).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")))
    keys = [F.col(c) for c in ("setting", "difficulty", "category")]
    rows = named.groupingSets([keys[:1], keys[:2], [keys[0], keys[2]]], *keys).agg(F.grouping("difficulty").alias("_d"), F.grouping("category").alias("_c"), *scoring.metrics())
    part = F.when(F.col("_d") == 0, "difficulty").when(F.col("_c") == 0, "category").otherwise(F.lit("all"))
    level = F.when(F.col("_d") == 0, F.col("difficulty")).when(F.col("_c") == 0, F.col("category")).otherwise(F.lit(""))
    return rows.select(part.alias("part"), "setting", level.alias("level"), *(c for c in rows.columns if c not in ("setting", "difficulty", "category", "_d", "_c")))


def best(parts: dict[str, DataFrame], metric: str = "ea_mean") -> DataFrame:
    """(setting, score): the best setting by a metric; no rows if there are no results."""
    first = parts["ranking"].where((F.col("metric") == metric) & (F.col("place") == 1)).select("setting")
    return parts["setting_results"].join(first, "setting", "left_semi").select("setting", F.col(metric).alias("score"))


def comparison_json(parts: dict[str, DataFrame], config: dict[str, str], at: str) -> str:
    """The comparison as one JSON object.  Parts have a row per setting and level, so the driver reads them."""
    read = {name: [json.loads(x) for x in df.toJSON().collect()] for name, df in parts.items()}
    own = {r["setting"]: {k: v for k, v in r.items() if k != "setting"} for r in read["setting_results"]}
    nested: dict[str, dict[str, dict[str, object]]] = {"complexity_results": {}, "category_results": {}}
    for name, level in (("complexity_results", "difficulty"), ("category_results", "category")):
        for r in read[name]:
            nested[name].setdefault(r["setting"], {})[r[level]] = {k: v for k, v in r.items() if k not in ("setting", level)}
    matrix = {DIRECT: {"baseline": own.get(SETTINGS[0], {}), "grounded": own.get(SETTINGS[1], {})}, QUERY: {"soft": own.get(SETTINGS[2], {}), "strict": own.get(SETTINGS[3], {})}}
    places = sorted(read["ranking"], key=lambda r: r["place"])
    ranking = {m: [r["setting"] for r in places if r["metric"] == m] for m in RANKED}
    return json.dumps({"timestamp": at, "model_name": config.get("model", "unknown"), "config": config, "setting_results": own, "setting_matrix": matrix, **nested, "ranking": ranking}, indent=2)


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object with every key; dates, times and decimals are text, null stays null."""
    plain = [F.col(f"`{name}`").cast("string").alias(name) if kind in ("date", "timestamp", "timestamp_ntz", "binary") or kind.startswith("decimal") else F.col(f"`{name}`") for name, kind in rows.dtypes]
    return rows.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))
