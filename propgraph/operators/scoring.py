"""Scores of query outputs: syntax, schema compliance and execution accuracy, as columns and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propgraph.functions import values
from propgraph.functions.tokens import BOOLEAN, NUMBER, answer_tokens

#: Labels in node patterns, and properties after a dot (these also fire inside literals and decimals, as the reference score does).
LABELS = r"\(\s*\w*\s*:\s*([A-Za-z_][A-Za-z0-9_:]*)\s*\)"
PROPERTIES = r"(?U)\b\w+\.(\w+)\b"
#: Names after a dot that are no properties.
NO_PROPERTIES = ("id", "labels", "type")


def used_labels(query: Column) -> Column:
    found = F.regexp_extract_all(query, F.lit(LABELS), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(found, lambda g: F.split(g, ":"))))


def used_properties(query: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(query, F.lit(PROPERTIES), F.lit(1)))
    return F.filter(found, lambda x: ~x.isin(*NO_PROPERTIES))


#: Texts, with escapes, and decimal numbers.
LITERALS = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|(?<![\w.])[0-9]+\.[0-9]+"""


def masked(query: Column) -> Column:
    """A query with a blank in place of each text and decimal number, so that names in them are not taken for used ones."""
    return F.regexp_replace(query, f"(?s){LITERALS}", " ")


def schema_compliance(query: Column, labels: Column, properties: Column, mask: bool = False) -> Column:
    """struct<scr, invalid_labels, invalid_properties>: the share of used names that are valid, in any case of letters.

    Blank query: 0; nothing used: 1.  labels, properties: arrays of valid names in lower case.  mask: leave out what
    only looks like a name, within texts and decimal numbers.
    """

    def used(q: Column) -> Column:
        return F.struct(used_labels(q).alias("labels"), used_properties(q).alias("properties"), (q.isNull() | (F.trim(q) == "")).alias("blank"))

    def judged(u: Column) -> Column:
        bad = lambda names, valid: F.array_sort(F.filter(names, lambda x: ~F.array_contains(valid, F.lower(x))))
        return F.struct(u["blank"].alias("blank"), (F.size(u["labels"]) + F.size(u["properties"])).alias("total"), bad(u["labels"], labels).alias("labels"), bad(u["properties"], properties).alias("properties"))

    def scored(j: Column) -> Column:
        scr = F.when(j["blank"], F.lit(0.0)).when(j["total"] == 0, F.lit(1.0)).otherwise((j["total"] - F.size(j["labels"]) - F.size(j["properties"])) / j["total"])
        return F.struct(scr.alias("scr"), j["labels"].alias("invalid_labels"), j["properties"].alias("invalid_properties"))

    return values.once(values.once(values.once(masked(query) if mask else query, used), judged), scored)


def valid_answer(output: Column) -> Column:
    """Whether a direct answer is a JSON list."""
    return answer_tokens(output).isNotNull()


def execution_accuracy(generated: Column, gold: Column) -> Column:
    """Jaccard similarity of two token arrays: 1 if both are empty, 0 if one is."""
    a, b = F.array_distinct(generated), F.array_distinct(gold)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(F.array_union(a, b)))


def precision_recall(generated: Column, gold: Column) -> Column:
    """struct<precision, recall, f1>; 0 where there is nothing to divide by."""
    a, b = F.array_distinct(generated), F.array_distinct(gold)
    both = F.size(F.array_intersect(a, b)).cast("double")
    part = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    p, r = part(both, F.size(a)), part(both, F.size(b))
    return F.struct(p.alias("precision"), r.alias("recall"), part(2 * p * r, p + r).alias("f1"))


def scalar_gold(gold: Column) -> Column:
    """Whether a gold result is numbers and booleans alone (and not empty)."""
    return (F.size(gold) > 0) & F.forall(gold, lambda t: t.startswith(NUMBER) | t.startswith(BOOLEAN))


def evaluate(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases (index, gold: array<string>) with their outputs (index, svr, scr, tokens): a case without gold counts as empty gold, accuracy is 0 where syntax is invalid."""
    rows = outputs.join(cases.select("index", "gold"), "index", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    ea = F.when(F.col("svr") > 0, execution_accuracy(F.coalesce("tokens", F.array().cast("array<string>")), F.col("gold"))).otherwise(F.lit(0.0))
    return rows.withColumn("ea", ea).withColumn("pr", precision_recall(F.coalesce("tokens", F.array().cast("array<string>")), F.col("gold"))).select("*", "pr.*").drop("pr")


def difficulty(level: Column) -> Column:
    """Levels by name: level 1, l1 and 1 are easy, and so on; blank is unknown."""
    name = F.lower(F.trim(F.coalesce(level, F.lit(""))))
    return F.when(name.isin("level 1", "l1", "1"), "easy").when(name.isin("level 2", "l2", "2"), "medium").when(name.isin("level 3", "l3", "3"), "hard").when(name == "", "unknown").otherwise(name)


def _mean(col: str, when: Column | None = None) -> Column:
    return F.coalesce(F.avg(F.when(when, F.col(col)) if when is not None else F.col(col)), F.lit(0.0))


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Means of the metrics by group ([]: over all): scalar and set gold apart, and over non-empty gold alone."""
    return results.groupBy(*by).agg(*metrics())


def metrics() -> list[Column]:
    """The aggregates of a summary."""
    scalar, filled = scalar_gold(F.col("gold")), F.size("gold") > 0
    return [
        F.count("*").alias("n"),
        *(_mean(m).alias(f"{m}_mean") for m in ("svr", "scr", "ea", "f1")),
        F.count_if(F.col("svr") > 0).alias("valid"),
        F.count_if((F.col("svr") == 1) & (F.col("scr") == 1) & (F.col("ea") == 1)).alias("perfect"),
        _mean("ea", scalar).alias("ea_mean_scalar"),
        _mean("ea", filled & ~scalar).alias("ea_mean_set"),
        _mean("ea", filled).alias("ea_mean_non_trivial"),
        _mean("f1", filled).alias("f1_mean_non_trivial"),
        *(c for m in ("svr", "scr", "ea", "f1") for c in (F.coalesce(F.sum(m), F.lit(0.0)).alias(f"{m}_sum"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))),
    ]


def ranking(summaries: DataFrame, setting: str, metrics: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """(metric, place, setting): settings by each metric, best first; ties go in the given order, then by name."""
    rows = summaries.select(setting, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics))))
    given = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col(setting)), F.lit(0)), F.lit(len(order) + 1))
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("score").desc(), given, setting))
    return rows.select("metric", place.alias("place"), setting)


def across_runs(summaries: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample standard deviation of each metric over runs; a single run deviates by 0."""
    parts = [c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))]
    return summaries.groupBy(*by).agg(F.count("*").alias("runs"), *parts)


def mean_and_deviation(mean: Column, std: Column, latex: bool = False, digits: int = 2) -> Column:
    """A mean with its deviation, or alone where that is 0; ties are rounded to even."""
    one = lambda c: F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits))
    both = F.concat(F.lit("$"), one(mean), F.lit(" \\pm "), one(std), F.lit("$")) if latex else F.concat(one(mean), F.lit(" ± "), one(std))
    return F.when(std == 0, one(mean)).otherwise(both)


#: What settings and metrics are called in tables.
SETTING_NAMES = {"direct_qa_baseline": "S1 (Naive QA)", "direct_qa_grounded": "S2 (Grounded QA)", "cypher_soft": "S3 (Soft Cypher)", "cypher_strict": "S4 (Strict Cypher)"}
METRIC_NAMES = {"svr_mean": "SVR", "scr_mean": "SCR", "ea_mean": "EA"}


def setting_name(setting: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SETTING_NAMES.items() for x in pair))[setting], setting)


def run_table(runs: DataFrame, by: tuple[str, ...] = ("model", "setting", "difficulty"), run: str = "run") -> DataFrame:
    """(by, metric, runs, values, shown) of (by, run, svr_mean, scr_mean, ea_mean): each metric's values in the order of runs, and mean ± deviation.

    The groups' runs are a handful each.  Groups whose metric is null throughout have no row of it.
    """
    each = runs.select(*by, run, F.inline(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("metric"), F.col(m).cast("double").alias("v")) for k, (m, name) in enumerate(METRIC_NAMES.items()))))).where("v IS NOT NULL")
    found = each.groupBy(*by, "place", "metric").agg(F.count("*").alias("runs"), F.array_sort(F.collect_list(F.struct(run, "v"))).alias("all"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))
    values = F.array_join(F.transform("all", lambda x: F.format_string("%.4f", F.bround(x["v"], 4))), ", ")
    return found.select(*by, "metric", "runs", values.alias("values"), mean_and_deviation(F.col("mean"), F.col("std")).alias("shown"))


def latex_rows(runs: DataFrame, order: tuple[str, ...] = tuple(SETTING_NAMES)) -> DataFrame:
    """(model, place, setting, line) of (model, setting, run, metrics): each model's name, its settings' rows in the given order, and a rule.

    Ordered by model, place and setting the lines are the table's rows.
    """
    own = across_runs(runs, ["model", "setting"], list(METRIC_NAMES))
    cells = [mean_and_deviation(F.col(f"{m}_mean"), F.col(f"{m}_std"), latex=True) for m in METRIC_NAMES]
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("setting")), F.lit(0)), F.lit(len(order) + 1)).cast("int")
    rows = own.select("model", at.alias("place"), "setting", F.concat(F.concat_ws(" & ", F.lit(" "), setting_name(F.col("setting")), *cells), F.lit(" \\\\")).alias("line"))
    ends = F.inline(F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("\\textit{"), "model", F.lit("}")).alias("line")), F.struct(F.lit(len(order) + 2).alias("place"), F.lit("\\hline").alias("line"))))
    return rows.unionByName(runs.select("model").distinct().select("model", F.lit("").alias("setting"), ends))
