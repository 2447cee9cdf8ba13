"""Runs of settings: nothing is asked twice, failures are rows, files are written."""

import json
import os
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from propgraph.functions import tokens
from propgraph.operators import grammar, runs
from propgraph.sources import documents

CASES = "index int, question string, gold array<string>, gold_cypher string, category string, difficulty string"


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


class Logged:
    """Answers with the question's length, notes each question it is asked, and fails or dies where it is told to."""

    def __init__(self, log, fails=(), dies=()):
        self.log, self.fails, self.dies = log, fails, dies

    def generate(self, question, setting, context):
        with open(self.log, "a") as f:
            f.write(f"{setting} {question}\n")
        if question in self.dies:
            os._exit(1)
        if question in self.fails:
            raise ValueError(f"cannot say {question}")
        return f"[{len(question)}]"


def asked(log):
    return Path(log).read_text().split("\n")[:-1] if Path(log).exists() else []


def cases(spark, n=8):
    return spark.createDataFrame([(k, "q" * (k + 1), [f"num:{k + 1}"], "MATCH (n:Wall) RETURN n.Name", "c", None) for k in range(n)], CASES)


def test_a_killed_run_goes_on(spark, tmp_path):
    log, setting = str(tmp_path / "log"), "direct_qa_baseline"
    run = lambda **how: runs.Run(lambda: Logged(log, **how), str(tmp_path / "run"))
    with pytest.raises(Exception, match="(?s)."):
        runs.answers(cases(spark), run(dies=("q" * 6,)), setting, tasks=1).collect()
    before = asked(log)
    assert 0 < len(before) == len(set(before)) <= 8
    rows = {r["index"]: r for r in runs.answers(cases(spark), run(fails=("qq",)), setting, attempts=3).collect()}
    after = asked(log)[len(before) :]
    done = {x for x in before if x != f"{setting} qqqqqq"}
    assert not done & set(after) or done & set(after) == {f"{setting} qq"}
    assert rows[5]["output"] == "[6]" and all(rows[k]["output"] == f"[{k + 1}]" for k in range(8) if k != 1)
    if "direct_qa_baseline qq" not in done:
        assert rows[1]["error"] == "Generation failed: cannot say qq" and rows[1]["attempts"] == 3 and after.count(f"{setting} qq") == 3
    n = len(asked(log))
    again = runs.answers(cases(spark), run(), setting).collect()
    assert all(r["error"] is None for r in again) and len(asked(log)) - n <= 1
    assert sum(len(x) == 0 for x in asked(log)) == 0 and runs.answers(cases(spark).limit(0), run(), setting).count() == 0


def test_comparison_and_its_files(spark, tmp_path):
    log = str(tmp_path / "log")
    texts = spark.createDataFrame([("MATCH (n:Wall)  RETURN n.Name;", ["num:1"])], "output string, tokens array<string>")
    run = runs.Run(lambda: Logged(log, fails=("q",)), str(tmp_path / "run"), ("Wall",), ("Name",), grammar.query_regex(["Wall"], ["Name"], []), texts, "a/b:c", "exp 1")
    found = runs.run_comparison(cases(spark, 3), run, ("direct_qa_baseline", "cypher_soft"), "2020-01-01")
    rows = {(r["setting"], r["index"]): r for r in found["results"].collect()}
    assert rows["direct_qa_baseline", 1]["ea"] == 1.0 and rows["direct_qa_baseline", 0]["error"].startswith("Generation failed") and rows["direct_qa_baseline", 0]["svr"] == 0
    assert rows["cypher_soft", 1]["svr"] == 0 and rows["cypher_soft", 1]["num_generated_results"] == 0
    folder = tmp_path / "run"
    summary = {(r["model"], r["setting"]): r["metrics"] for s in ("direct_qa_baseline", "cypher_soft") for r in documents.summaries(spark, f"{folder}/exp_1_{s}_summary.json").collect()}
    assert summary["a/b:c", "direct_qa_baseline"]["ea_mean"] == pytest.approx(2 / 3) and summary["a/b:c", "cypher_soft"]["svr_max"] == 0
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/exp_1_cypher_soft_results.csv")
    assert csv.count() == 3 and csv.columns[:4] == ["question", "experiment_setting", "output_type", "generated_cypher"] and {r["output_type"] for r in csv.collect()} == {"cypher"}
    report = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/exp_1_comparison.json", wholetext=True).collect()))
    assert report["ranking"]["ea_mean"] == ["direct_qa_baseline", "cypher_soft"] and report["setting_matrix"]["direct_qa"]["baseline"]["n"] == 3


def test_gold_as_output_is_perfect(spark, tmp_path):
    texts = spark.createDataFrame([("MATCH (n:Wall) RETURN n.Name", [f"num:{k}"]) for k in (1,)], "output string, tokens array<string>")
    run = runs.Run(lambda: None, str(tmp_path / "run"), ("Wall",), ("Name",), grammar.query_regex(["Wall"], ["Name"], []), texts)
    rows = runs.run_setting(cases(spark, 1), run, "cypher_strict", gold_as_output=True).collect()
    assert [(r["svr"], r["scr"], r["ea"], r["f1"]) for r in rows] == [(1.0, 1.0, 1.0, 1.0)]
    direct = runs.scored(cases(spark, 4), runs.gold_answers(cases(spark, 4), "direct_qa_baseline"), run).collect()
    assert all(r["svr"] == 1.0 for r in direct)


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('[null, {"a": [1, true], "b": "x, y: z"}, [1, "q"]]', ["None", "{'a': [1, True], 'b': 'x, y: z'}", "[1, 'q']"]), ('[" pad ", " 5 ", "+07", ""]', [" pad ", "num:5", "num:7", ""]),
        ("[0.00005, 1e20, 0.0000004, -0.0, 123456.1234567, 1e16, 1e15]", ["num:5e-05", "num:1e+20", "num:0.0", "num:123456.123457", "num:1e+16", "num:1000000000000000.0"]),
        ('["0123456789012345678901", 12345678901234567890123]', ["num:123456789012345678901", "num:12345678901234567890123"]), ('["1e400"]', ["num:inf"]), ("[]", []), ('{"a": 1}', None), ("[1, 2", None),
    ],
)
def test_direct_tokens(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "a string").select(tokens.answer_tokens(F.col("a")).alias("t")).first()["t"]
    assert got == want


def test_cleaned_columns_are_cleaned_texts(spark):
    texts = ["```cypher\nMATCH (n)\n RETURN n;\n```", "Here: `match (n) return n.Name` ok\nmore", " ; nothing ; ", "", None, "MATCH (n) RETURN n; MATCH (m) RETURN m"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", grammar.cleaned_column(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [None if r["t"] is None else grammar.cleaned(r["t"]) for r in rows]
