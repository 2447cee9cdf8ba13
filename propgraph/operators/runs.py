"""Runs of settings: questions to outputs to scores to files.

Questions are asked in tasks, each by a generator that the task makes, a bounded number of times.  Every
answer is a file of its own in the run's folder, named by setting and index and put there at once, so a run
that was killed goes on where it ended: a question whose answer is there is not asked again, by a repeated
task neither.  A question that fails each time has a row with its error and is asked again by the next run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.functions import names, tokens
from propgraph.operators import grammar, prompts, reports, scoring, sinks
from propgraph.operators.closure import keep
from propgraph.sources.shipping import ship
from propgraph.sources.step_scan import opened

ATTEMPTS, WAIT = 3, 0.0
OUTPUTS = "index int, setting string, output string, error string, attempts int"


class Generator(Protocol):
    """What writes an output for a question."""

    def generate(self, question: str, setting: str, context: str) -> str: ...


@dataclass(frozen=True)
class Run:
    """What a run needs besides its cases.

    make: makes a generator in a task (picklable); folder: where answers and files go, shared by all executors;
    labels, properties, regex: what outputs are held against; texts: for query outputs, (output, tokens) of those that can be run.
    """

    make: Callable[[], Generator]
    folder: str
    labels: tuple[str, ...] = ()
    properties: tuple[str, ...] = ()
    regex: str | None = None
    texts: DataFrame | None = None
    model: str = "unknown"
    name: str = "run"
    context: str = ""
    config: dict[str, str] = field(default_factory=dict)


def output_type(setting: str) -> str:
    return reports.DIRECT if prompts.answers_directly(setting) else reports.QUERY


def answers(cases: DataFrame, run: Run, setting: str, attempts: int = ATTEMPTS, wait: float = WAIT, tasks: int | None = None) -> DataFrame:
    """(index, setting, output, error, attempts) of each case (index, question), asked where no answer is there yet.

    One of output and error is null.  wait: seconds before the second attempt, doubled for each further one.
    """
    spark = cases.sparkSession
    ship(spark)
    make, context, folder = run.make, run.context, f"{run.folder}/answers/setting={names_safe(setting)}"

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        generator = None
        for frame in frames:
            rows = []
            for index, question in zip(frame["index"], frame["question"], strict=True):
                path = f"{at}/{index}.json"
                if system.get_file_info(path).type == fs.FileType.File:
                    with system.open_input_file(path) as f:
                        rows.append((index, setting, json.loads(f.read())["output"], None, 0))
                    continue
                output, error = None, None
                for k in range(1, attempts + 1):
                    if k > 1 and wait:
                        time.sleep(wait * 2 ** (k - 2))
                    try:
                        generator = generator or make()
                        output, error = str(generator.generate(question, setting, context)), None
                        break
                    except Exception as e:  # the generator is the user's
                        error = f"Generation failed: {e}"
                if error is None:
                    with system.open_output_stream(f"{path}.new") as f:
                        f.write(json.dumps({"index": int(index), "question": question, "output": output}).encode())
                    system.move(f"{path}.new", path)
                rows.append((index, setting, output, error, k))
            yield pd.DataFrame(rows, columns=["index", "setting", "output", "error", "attempts"])

    todo = cases.select(F.col("index").cast("int").alias("index"), F.col("question").cast("string").alias("question"))
    return todo.repartition(tasks or spark.sparkContext.defaultParallelism, "index").mapInPandas(ask, OUTPUTS)


def names_safe(setting: str) -> str:
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in setting)


def output_tokens(outputs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """outputs (output, output_type) with tokens: a direct answer's elements, or what a query text gives.

    texts: (output, tokens) of query texts that can be run, compared after clean-up.  What gives nothing has no tokens (null).
    """
    direct = outputs.withColumn("_direct", F.when(F.col("output_type") == reports.DIRECT, tokens.answer_tokens(F.col("output"))))
    if texts is None:
        return direct.withColumn("tokens", F.col("_direct")).drop("_direct")
    known = texts.select(grammar.cleaned_column(F.col("output")).alias("_text"), F.col("tokens").alias("_given")).dropDuplicates(["_text"])
    keyed = direct.withColumn("_key", F.when(F.col("output_type") == reports.QUERY, grammar.cleaned_column(F.col("output"))))
    return keyed.join(known, F.col("_key") == F.col("_text"), "left").withColumn("tokens", F.coalesce("_direct", "_given")).drop("_direct", "_given", "_key", "_text")


def gold_answers(cases: DataFrame, setting: str) -> DataFrame:
    """(index, setting, output, error, attempts): the gold itself as output, its query text or its tokens as a JSON list."""
    own = F.to_json(F.array_sort(F.coalesce("gold", F.array().cast("array<string>")))) if prompts.answers_directly(setting) else F.coalesce("gold_cypher", F.lit(""))
    return cases.select(F.col("index").cast("int").alias("index"), F.lit(setting).alias("setting"), own.alias("output"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))


def scored(cases: DataFrame, outputs: DataFrame, run: Run) -> DataFrame:
    """Result rows of outputs: syntax, compliance, tokens by type, accuracy; a failed generation scores 0 throughout.

    Of what is said for a query the query text counts, without what stands around it.
    """
    valid = [F.array(*(F.lit(x.lower()) for x in own)).cast("array<string>") for own in (run.labels, run.properties)]
    kind = F.when(F.col("setting").isin(*prompts.SETTINGS[:2]), reports.DIRECT).otherwise(F.lit(reports.QUERY))
    typed = outputs.withColumn("output_type", kind).withColumn("_said", F.col("output"))
    typed = typed.withColumn("output", F.when(F.col("output_type") == reports.QUERY, grammar.cleaned_column(F.col("output"))).otherwise(F.col("output")))
    failed = F.col("output").isNull()
    svr = F.when(failed, 0.0).otherwise(reports.syntax_validity(F.col("output"), F.col("output_type"), run.regex))
    names_ = F.when(F.col("output_type") == reports.QUERY, scoring.schema_compliance(F.col("output"), *valid))
    told = output_tokens(typed, run.texts).withColumn("svr", svr).withColumn("_names", names_)
    scr = F.when(failed, 0.0).otherwise(reports.compliance(F.col("output"), F.col("output_type"), *valid))
    told = told.withColumn("scr", scr).select("*", F.col("_names.invalid_labels").alias("invalid_labels"), F.col("_names.invalid_properties").alias("invalid_properties")).drop("_names")
    rows = scoring.evaluate(cases.select(F.col("index").cast("int").alias("index"), "gold"), told)
    facts = cases.select(F.col("index").cast("int").alias("index"), *(F.col(c) if c in cases.columns else F.lit(None).cast("string").alias(c) for c in ("question", "gold_cypher", "category", "difficulty")))
    count = lambda c: F.coalesce(F.size(F.array_distinct(c)), F.lit(0))
    return rows.join(facts, "index", "left").select(
        "index", "question", "setting", F.col("setting").alias("experiment_setting"), "output_type", F.when(F.col("output_type") == reports.QUERY, F.col("output")).alias("generated_cypher"), "gold_cypher",
        F.col("_said").alias("raw_output"), "svr", "scr", "ea", (F.col("svr") > 0).alias("is_valid_syntax"), "invalid_labels", "invalid_properties", count(F.col("tokens")).alias("num_generated_results"),
        count(F.col("gold")).alias("num_gold_results"), "precision", "recall", "f1", "error", "category", "difficulty", F.lit(run.model).alias("model"), "gold", "tokens",
    )


def run_setting(cases: DataFrame, run: Run, setting: str, gold_as_output: bool = False) -> DataFrame:
    """Ask, score and write one setting: <name>_<setting>_results.csv and _summary.json in the run's folder; the result rows.

    cases: index, question, gold (array of tokens) and, where known, gold_cypher, category, difficulty.
    """
    outputs = gold_answers(cases, setting) if gold_as_output else answers(cases, run, setting)
    results = keep(scored(cases, keep(outputs), run))
    at = f"{run.folder}/{names.safe_text(run.name)}_{names_safe(setting)}"
    sinks.write_results(results.drop("setting", "gold", "tokens"), f"{at}_results.csv")
    config = {"setting": setting, "model": run.model, "test_cases": str(cases.count())} | run.config
    sinks.write_summary(scoring.summary(results, []), config, f"{at}_summary.json")
    return results


def run_comparison(cases: DataFrame, run: Run, settings: tuple[str, ...] = prompts.SETTINGS, at: str = "", gold_as_output: bool = False) -> dict[str, DataFrame]:
    """Every setting in turn, its files, and <name>_comparison.json over all; the parts of the comparison, with results."""
    parts = [run_setting(cases, run, s, gold_as_output) for s in settings]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    found = reports.comparison(rows, settings)
    text = reports.comparison_json(found, {"model": run.model} | run.config, at)
    spark: SparkSession = cases.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{run.folder}/{names.safe_text(run.name)}_comparison.json")
    return found | {"results": rows}
