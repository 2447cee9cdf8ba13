"""The bounded query language as one regular expression built from a vocabulary, and its check of whole columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of the language.
COMPARISONS = (r"=", r"<>", r"!=", r"<=", r">=", r"<", r">")
TEXT_TESTS = ("CONTAINS", "STARTS WITH", "ENDS WITH", "contains", "starts with", "ends with")
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect", "COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT")
CONSTANTS = ("true", "false", "TRUE", "FALSE", "null", "NULL")
#: Fixed value: the relations of a vocabulary that has none.
RELATIONS = ("CONTAINS", "DECOMPOSES", "HAS_MATERIAL")
CONVERSIONS = ("toInteger", "toFloat", "toBoolean", "toString", "toLower", "toUpper")


@dataclass(frozen=True)
class Limits:
    """How much a query may hold: conditions, returned items, and lengths of blanks, texts and names."""

    conditions: int = 4
    items: int = 8
    blanks: int = 2
    text: int = 60
    alias: int = 20
    predicates: bool = True


def one_of(names: list[str]) -> str:
    """An alternation, longer names first so that none hides behind its own prefix; of no names, what matches nothing."""
    return "(?!)" if not names else "(?:" + "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n))) + ")"


def query_regex(labels: list[str], properties: list[str], relations: list[str], choices: dict[str, list[str]] | None = None, limits: Limits = Limits()) -> str:
    """The language's regular expression: one pattern of at most one hop, conditions, returned items, order and limit.

    A property with listed choices compares by = and <> with one of them alone.  Blanks are blanks and tabs, no line
    breaks.  Without relations the usual ones count.
    """
    choices = choices or {}
    ws, opt = rf"[ \t]{{1,{limits.blanks}}}", rf"[ \t]{{0,{limits.blanks}}}"
    var = r"[a-z][a-z0-9]{0,2}"
    label, prop, rel = one_of(labels), one_of(properties), one_of(relations or list(RELATIONS))
    node = rf"\((?:{var}(?::{label})?|:{label})\)"
    hop = rf"(?:-\[:{rel}\]->{node})?"
    text = rf"'[^'\\]{{0,{limits.text}}}'"
    number = r"-?[0-9]{1,9}(?:\.[0-9]{1,4})?"
    literal = f"(?:{text}|{number}|{'|'.join(CONSTANTS)})"
    free = sorted(set(properties) - {p for p, own in choices.items() if own})  # a property of listed values takes no other text
    access = rf"{var}\.{one_of(free)}"
    tests = [
        *(rf"{var}\.{re.escape(p)}{opt}(?:=|<>|!=){opt}'{one_of(own)}'" for p, own in sorted(choices.items()) if own),
        *([rf"(?:{access}|(?:{'|'.join(CONVERSIONS)})\({opt}{access}{opt}\)){opt}(?:{'|'.join(COMPARISONS)}){opt}{literal}", rf"(?:NOT{ws})?{access}{ws}(?:{'|'.join(t.replace(' ', ws) for t in TEXT_TESTS)}){ws}{text}"] if free else []),
        rf"{var}\.{prop}{ws}IS{ws}(?:NOT{ws})?NULL",
    ]
    condition = "(?:" + "|".join(tests) + ")"
    predicate = rf"(?:NOT{ws})?\({var}\)-\[:{rel}\]->\((?::{label})?\)"
    joined = rf"{condition}(?:{ws}(?:AND|OR|and|or){ws}{condition}){{0,{limits.conditions - 1}}}"
    body = rf"(?:{joined}(?:{ws}(?:AND|OR|and|or){ws}{predicate})?|{predicate})" if limits.predicates else joined
    where = rf"(?:{ws}WHERE{ws}{body})?"
    item = rf"(?:{var}(?:\.{prop})?|(?:{'|'.join(AGGREGATES)})\((?:DISTINCT{ws})?(?:\*|{var}(?:\.{prop})?)\))(?:{ws}AS{ws}[A-Za-z_][A-Za-z0-9_]{{0,{limits.alias - 1}}})?"
    items = rf"{item}(?:{opt},{opt}{item}){{0,{limits.items - 1}}}"
    order = rf"(?:{ws}ORDER{ws}BY{ws}[A-Za-z_][A-Za-z0-9_]{{0,{limits.alias - 1}}}(?:\.{prop})?(?:{ws}(?:ASC|DESC))?)?"
    limit = rf"(?:{ws}LIMIT{ws}[1-9][0-9]{{0,3}})?"
    return rf"MATCH{ws}{node}{hop}{where}{ws}RETURN{ws}(?:DISTINCT{ws})?{items}{order}{limit}"


def accepted(query: Column, regex: str | None) -> Column:
    """Whether queries are in the language, wholly and in its case of letters; without a vocabulary all are."""
    return F.lit(True) if regex is None else F.coalesce(F.trim(query).rlike(rf"^(?:{regex})$"), F.lit(False))


def cleaned_column(output: Column) -> Column:
    """`cleaned` of a column: null stays null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(output, "```[a-zA-Z]*", ""), "`", " "))
    found = F.regexp_extract(text, r"(?is)\bMATCH\b.*?\bRETURN\b[^;\n]*", 0)
    flat = F.regexp_replace(F.when(found != "", found).otherwise(text), r"\s+", " ")
    return F.regexp_replace(flat, "^[ ;]+|[ ;]+$", "")


def cleaned(output: str) -> str:
    """A query out of generated text: without fences and back quotes, from MATCH to the end of the line (or ;) of its RETURN."""
    text = re.sub(r"```[a-zA-Z]*", "", output).replace("`", " ").strip()
    found = re.search(r"\bMATCH\b.*?\bRETURN\b[^;\n]*", text, re.DOTALL | re.IGNORECASE)
    return re.sub(r"\s+", " ", found.group() if found else text).strip(" ;")
