"""Chat conversations as training examples of budgeted windows, by DataFrame code only.

A turn is written as <|turn|>role<|text|>text<|end|> and a line break.  Inside roles and texts a
backslash follows every backslash, < and [, so neither these marks nor control strings such as </s>
or [INST] can occur there, and dropping it gives the text back.

Prefix sums of turn tokens choose spans of whole turns: a window takes new turns up to the budget (one
turn at least), after the system turn and up to HISTORY turns of the turns before it that fit their
own budget and leave room for the first new turn: over the budget are only windows of one new turn that
with the system turn is over it by itself.  The loss covers the new turns' assistant texts alone, so each is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propgraph.llm.common import whole_text

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
BUDGET, HISTORY, HISTORY_BUDGET = 1024, 2, 256
TARGET, SYSTEM = "assistant", "system"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def estimated_tokens(text: Column) -> Column:
    """A token count where none is given: a quarter of the bytes, and four for the marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


def conversations(df: DataFrame, key: str = "conv_id", tokens: str | None = None) -> DataFrame:
    """(key, turns): a conversation's turns in order of turn, role and text, each with the prefix sum `upto` of their tokens.

    Null role or text counts as empty, a null turn comes first; repeated rows are turns of their own.  A
    conversation is one output of the operator, so its turns meet in one row.
    """
    size = F.col(tokens) if tokens else estimated_tokens(whole_text())
    rows = df.select(key, "turn", whole_text("role").alias("role"), whole_text("text").alias("text"), F.coalesce(size.cast("long"), F.lit(0)).alias("tokens"))
    so_far = Window.partitionBy(key).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("tokens").over(so_far))
    return summed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "tokens", "upto"))).alias("turns"))


def _before(turns: Column, j: Column) -> Column:
    """The tokens of all turns before turn j."""
    return F.get(turns, j)["upto"] - F.get(turns, j)["tokens"]


def _history(turns: Column, start: Column, first: Column, most: int, own: int, budget: int) -> Column:
    """How many turns before `start` are repeated: the most, up to `most`, that fit their own budget and, with the system turn and the turn at start, the window's; no system turn."""
    rest = budget - F.get(turns, start)["tokens"] - F.when(first == 1, F.get(turns, F.lit(0))["tokens"]).otherwise(0)
    fits = F.lit(0)
    for m in range(1, most + 1):
        past = _before(turns, start) - _before(turns, start - m)
        fits = F.when((start - m >= first) & (past <= own) & (past <= rest), F.lit(m)).otherwise(fits)
    return fits


def windows(df: DataFrame, key: str = "conv_id", tokens: str | None = None, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """One row per training example: key, window (from 0), formatted, context_turns, n_turns, targets.

    context_turns of the example's turns are repeated (the system turn and history), the other n_turns
    are new; targets holds the start (from 0) and length of each new assistant text within formatted, in
    characters.  A turn over the budget is a window of its own.  tokens: a column of the turns' token counts, marks
    included (null: 0); without it counts are estimates, and windows can have more real tokens than the budget.
    An empty table gives no rows.
    """
    turns, led = F.col("turns"), F.col("led")
    convs = conversations(df, key, tokens).withColumn("led", F.when(F.get("turns", F.lit(0))["role"] == SYSTEM, F.lit(1)).otherwise(F.lit(0)))

    def step(acc: Column, j: Column) -> Column:
        """acc: starts of the windows so far, and the tokens before the new turns of the last one less its context's."""
        used = F.get(turns, j)["upto"] - acc["base"]
        past = _history(turns, j, led, history, history_budget, budget)
        context = _before(turns, j) - _before(turns, j - past) + F.when(led == 1, F.get(turns, F.lit(0))["tokens"]).otherwise(0)
        opened = F.struct(F.concat(acc["starts"], F.array(j)).alias("starts"), (_before(turns, j) - F.when(j > led, context).otherwise(0)).alias("base"))
        return F.when((used > budget) & (j > F.element_at(acc["starts"], -1)), opened).otherwise(acc)

    none = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("base"))
    convs = convs.withColumn("starts", F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), none, step)["starts"])

    def example(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        past = _history(turns, start, led, history, history_budget, budget)
        system = F.slice(turns, 1, F.when((start > led) & (led == 1), F.lit(1)).otherwise(F.lit(0)))
        return F.struct(
            k.alias("window"),
            F.concat(system, F.slice(turns, F.greatest(start - past + 1, F.lit(1)), F.when(start > led, past).otherwise(F.lit(0)))).alias("context"),
            F.slice(turns, start + 1, end - start).alias("new"),
        )

    # each example takes its own turns along, so a long conversation is not repeated for every one of its windows
    cut = convs.select(key, F.explode(F.transform("starts", example)).alias("e")).select(key, "e.window", "e.context", "e.new")

    def shown(those: Column) -> Column:
        return F.transform(those, lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END)))

    cut = cut.withColumns({"old": F.array_join(shown(F.col("context")), ""), "shown": shown(F.col("new"))})
    begin = F.struct(F.char_length("old").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("targets"))

    def place(acc: Column, j: Column) -> Column:
        turn = F.get("new", j)
        head = len(TURN) + len(TEXT) + F.char_length(escaped(turn["role"]))
        whole = F.char_length(F.get("shown", j))
        target = F.struct((acc["at"] + head).alias("start"), (whole - head - len(END)).alias("length"))
        return F.struct((acc["at"] + whole).alias("at"), F.when(turn["role"] == TARGET, F.concat(acc["targets"], F.array(target))).otherwise(acc["targets"]).alias("targets"))

    targets = F.aggregate(F.sequence(F.lit(0), F.size("new") - 1), begin, place)["targets"]
    return cut.select(
        key, "window", F.concat("old", F.array_join("shown", "")).alias("formatted"), F.size("context").alias("context_turns"), F.size("new").alias("n_turns"), targets.alias("targets")
    )


def new_turns(formatted: Column, context_turns: Column) -> Column:
    """Read back: array<struct<role, text>> of an example's new turns."""
    parts = F.split(formatted, r"<\|turn\|>")
    own = F.slice(parts, context_turns + 2, F.greatest(F.size(parts) - 1 - context_turns, F.lit(0)))
    body = lambda p: F.substring_index(F.substring_index(p, TEXT, -1), END, 1)
    return F.transform(own, lambda p: F.struct(unescaped(F.substring_index(p, TEXT, 1)).alias("role"), unescaped(body(p)).alias("text")))


def target_text(formatted: Column, targets: Column) -> Column:
    """Read back: the text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(targets, lambda t: unescaped(F.substring(formatted, t["start"] + 1, t["length"]))), "")


def digests(examples: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation, what can be read back from its examples."""
    turns = F.array_join(F.transform(new_turns(F.col("formatted"), F.col("context_turns")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = examples.select(key, F.struct("window", turns.alias("turns"), target_text(F.col("formatted"), F.col("targets")).alias("loss"), "n_turns", F.char_length("formatted").alias("chars")).alias("part"))
    rows = parts.groupBy(key).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    joined = lambda name: F.array_join(F.col(f"parts.{name}"), "")
    total = lambda name: F.aggregate(F.col(f"parts.{name}"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        key,
        total("n_turns").alias("n_turns"),
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
        F.size("parts").alias("n_windows"),
    )
