"""The engine: one object with what a service over a graph offers, as plain methods."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.functions import tokens, values
from propgraph.operators import grammar, profile, reports, runs, scoring
from propgraph.operators.closure import keep
from propgraph.operators.graph import PropertyGraph


class Generator(Protocol):
    """What writes an output for a question."""

    def generate(self, question: str, setting: str, context: str) -> str: ...


@dataclass
class Gold:
    """Feeds the gold output back: a check of the whole chain."""

    by_question: dict[str, str]

    def generate(self, question: str, setting: str, context: str) -> str:
        return self.by_question[question]


@dataclass
class Scripted:
    """Answers in the order given."""

    outputs: Iterable[str]

    def __post_init__(self) -> None:
        self._next = iter(self.outputs)

    def generate(self, question: str, setting: str, context: str) -> str:
        return next(self._next)


#: A named query: a function of the graph.  Query texts are not parsed; what runs is PySpark.
Query = Callable[[PropertyGraph], DataFrame]


@dataclass
class Engine:
    graph: PropertyGraph
    queries: dict[str, Query]
    choices: dict[str, list[str]] | None = None

    def health(self) -> bool:
        """Whether the graph can be read."""
        return self.graph.labelled().limit(1).count() <= 1

    @functools.cached_property
    def labels(self) -> list[str]:
        return sorted({label for t in self.graph.tables.values() for label in t.labels})

    @functools.cached_property
    def properties(self) -> list[str]:
        return sorted({c for t in self.graph.tables.values() for c in t.df.columns if c != "node_id"})

    def vocabulary(self) -> dict[str, DataFrame]:
        return {"labels": profile.label_counts(self.graph), "types": profile.type_counts(self.graph), "signatures": profile.signatures(self.graph), "keys": profile.known_keys(self.graph)}

    @functools.cached_property
    def regex(self) -> str:
        return grammar.query_regex(self.labels, self.properties, sorted(self.graph.edges), self.choices, grammar.Limits(conditions=1, items=3))

    def validate(self, outputs: DataFrame, query: str = "query") -> DataFrame:
        """outputs with valid: whether each query text is in the bounded language."""
        return outputs.withColumn("valid", grammar.accepted(F.col(query), self.regex))

    def compliance(self, outputs: DataFrame, query: str = "query") -> DataFrame:
        valid = [F.array(*(F.lit(x.lower()) for x in names)) for names in (self.labels, self.properties)]
        return outputs.select("*", scoring.schema_compliance(F.col(query), *valid).alias("_s")).select("*", "_s.*").drop("_s")

    def execute(self, name: str) -> DataFrame:
        """The distinct tokens of a named query's rows: a node column stands for its id."""
        rows = self.queries[name](self.graph)
        cells = []
        for f in rows.schema.fields:
            col = F.col(f"`{f.name}`")
            if f.dataType.typeName() == "struct" and "node_id" in f.dataType.fieldNames():
                cells.append(col["node_id"])
            else:
                cells.append(tokens.value_token(values.value(col, f.dataType)))
        return rows.select(tokens.record(*cells).alias("token")).where("token IS NOT NULL AND token <> ''").distinct()

    def attempt(self, name: str) -> tuple[DataFrame, str | None]:
        """The tokens of a named query and no message, or, where it fails, no tokens and a message."""
        try:
            return keep(self.execute(name)), None
        except KeyError:
            return self._nothing("token string"), f"no query: {name}"
        except Exception as e:  # the query is the user's
            return self._nothing("token string"), f"execution_failed: {e}"

    def _nothing(self, schema: str) -> DataFrame:
        return self.graph_session().createDataFrame([], schema)

    def gold(self, names: list[str]) -> DataFrame:
        """(index, gold, error): the tokens of each named query, in the order of the names; one that fails or is missing has none and a message."""
        if not names:
            return self._nothing("index int, gold array<string>, error string")
        parts = [(k, *self.attempt(name)) for k, name in enumerate(names)]
        rows = functools.reduce(DataFrame.unionAll, (df.select(F.lit(k).alias("index"), "token") for k, df, _ in parts))
        errors = self.graph_session().createDataFrame([(k, e) for k, _, e in parts], "index int, error string")
        found = rows.groupBy("index").agg(F.collect_set("token").alias("gold"))
        return errors.join(found, "index", "left").select("index", F.coalesce("gold", F.array().cast("array<string>")).alias("gold"), "error")

    def gold_at(self, names: list[str], index: int) -> DataFrame:
        """(index, gold, error) of one of the named queries, which alone is run.  An index outside of the names is an error."""
        if not 0 <= index < len(names):
            raise IndexError(f"no gold query {index}: there are {len(names)}")
        return self.gold([names[index]]).withColumn("index", F.lit(index))

    def evaluate_one(self, output: str, output_type: str, gold_ids: list[str] | None = None, names: list[str] | None = None, index: int | None = None) -> DataFrame:
        """The scores of one output against given gold ids, or those of a named query by its index: one or the other."""
        if (gold_ids is None) == (index is None):
            raise ValueError("give gold ids or the index of a gold query")
        spark = self.graph_session()
        cases = self.gold_at(names or [], index) if index is not None else spark.createDataFrame([(0, gold_ids)], "index int, gold array<string>")
        made = spark.createDataFrame([(0 if index is None else index, output, output_type)], "index int, output string, output_type string")
        return self.evaluate(cases, runs.output_tokens(self.score(made)))

    def graph_session(self) -> SparkSession:
        return next(iter(self.graph.tables.values())).df.sparkSession

    def evaluate(self, cases: DataFrame, outputs: DataFrame) -> DataFrame:
        """Scores of outputs (index, svr, scr, tokens) against cases (index, gold)."""
        return scoring.evaluate(cases, outputs)

    def score(self, outputs: DataFrame, bounded: bool = True) -> DataFrame:
        """outputs (output, output_type) with svr and scr, each by its type.  bounded: queries must be in the bounded language, else hang together."""
        valid = [F.array(*(F.lit(x.lower()) for x in names)) for names in (self.labels, self.properties)]
        svr = reports.syntax_validity(F.col("output"), F.col("output_type"), self.regex if bounded else None)
        return outputs.select("*", svr.alias("svr"), reports.compliance(F.col("output"), F.col("output_type"), *valid).alias("scr"))

    def compare(self, cases: DataFrame, outputs: DataFrame) -> dict[str, DataFrame]:
        """The comparison of outputs of several settings (see reports.comparison)."""
        return reports.comparison(self.evaluate(cases, outputs))

    def run(self, questions: list[str], generator: Generator, setting: str, context: str = "") -> list[dict[str, str | int | None]]:
        """(index, question, output, error) of each question; a failing generation is a row with its error, not the end of the run."""
        out: list[dict[str, str | int | None]] = []
        for k, q in enumerate(questions):
            try:
                out.append({"index": k, "question": q, "output": generator.generate(q, setting, context), "error": None})
            except Exception as e:  # the generator is the user's
                out.append({"index": k, "question": q, "output": None, "error": f"generation_failed: {e}"})
        return out
