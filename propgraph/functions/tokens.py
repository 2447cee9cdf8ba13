"""Tokens: result cells as comparable text.

Numbers and booleans are marked, so 5 is never the string "5"; a node stands for its id; a list is the
sorted bag of its elements; a record joins its cells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators and marks.
CELL, ELEMENT = "\x1e", "\x1f"
NUMBER, BOOLEAN = "num:", "bool:"
#: A number as text.
NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def integer(col: Column) -> Column:
    return F.concat(F.lit(NUMBER), col.cast("long").cast("string"))


def whole_number(digits: Column) -> Column:
    """A whole number given as text of any length: its sign and digits, without a plus and leading zeros."""
    plain = F.regexp_replace(digits, r"^\+?(-?)0*(?=[0-9])", "$1")
    return F.concat(F.lit(NUMBER), F.when(plain == "-0", F.lit("0")).otherwise(plain))


def decimal(col: Column) -> Column:
    """Rounded to six digits (ties to even), shortest form: positional from 1e-4 to below 1e16, else as 5e-05 and 1e+20; -0.0 is 0.0."""
    number = F.bround(col.cast("double"), 6) + F.lit(0.0)
    positional = F.regexp_replace(number.try_cast("decimal(38,6)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    positional = F.when(positional.endswith("."), F.concat(positional, F.lit("0"))).otherwise(positional)
    power = F.regexp_replace(F.regexp_replace(F.replace(number.cast("string"), F.lit(".0E"), F.lit("E")), r"E-([0-9])$", "e-0$1"), r"E([0-9])", "e+$1")
    power = F.replace(power, F.lit("E-"), F.lit("e-"))
    odd = F.when(F.isnan(number), "nan").when(number == float("inf"), "inf").when(number == float("-inf"), "-inf")
    plain = (number == 0) | (F.abs(number) >= 1e-4) & (F.abs(number) < 1e16)
    return F.concat(F.lit(NUMBER), F.coalesce(odd, F.when(plain, positional).otherwise(power)))


def boolean(col: Column) -> Column:
    """1 or 0."""
    return F.concat(F.lit(BOOLEAN), col.cast("int").cast("string"))


def text(col: Column) -> Column:
    """A string cell: numeric text counts as a number, a 22-character id as it stands, blank text as nothing."""
    trimmed = F.trim(col)
    as_number = F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), whole_number(trimmed)).otherwise(decimal(trimmed.try_cast("double")))
    return F.when(trimmed == "", F.lit(None)).when(F.length(trimmed) == 22, trimmed).when(trimmed.rlike(NUMERIC), as_number).otherwise(trimmed)


def bag(tokens: Column) -> Column:
    """A list cell: its tokens sorted, null ones dropped; none left is null."""
    kept = F.array_sort(F.filter(tokens, lambda t: t.isNotNull()))
    return F.when(F.size(kept) > 0, F.array_join(kept, ELEMENT))


def record(*cells: Column) -> Column:
    """A result row: one cell is its token; of several, null ones count as empty text; all null is null."""
    if len(cells) == 1:
        return cells[0]
    return F.when(F.coalesce(*cells).isNotNull(), F.concat_ws(CELL, *(F.coalesce(c, F.lit("")) for c in cells)))


def value_token(v: Column) -> Column:
    """The token of a dynamic value (see functions.values)."""
    return (
        F.when(v["t"] == "boolean", boolean(v["b"]))
        .when(v["t"] == "integer", integer(v["i"]))
        .when(v["t"] == "float", decimal(v["d"]))
        .when(v["t"] == "list", bag(F.transform(v["l"], text)))
        .when(v["t"] == "string", text(v["s"]))
    )


def answer_text(col: Column) -> Column:
    """A text in a direct answer: a number if it is one but for blanks around it, else itself."""
    bare = F.trim(col)
    number = F.when(bare.rlike(r"^[+-]?[0-9]+$"), whole_number(bare)).otherwise(decimal(bare.try_cast("double")))
    return F.when(bare.rlike(NUMERIC), number).otherwise(col)


def nested(json: Column) -> Column:
    """A list or object in a direct answer, given as JSON, as the text that tokens have."""
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    spaced = F.regexp_replace(json, f"([,:]){outside}", "$1 ")
    for word, name in (("null", "None"), ("true", "True"), ("false", "False")):
        spaced = F.regexp_replace(spaced, rf"\b{word}\b{outside}", name)
    return F.replace(spaced, F.lit('"'), F.lit("'"))


def answer_tokens(answer: Column) -> Column:
    """array<string> of a JSON list given as text (perhaps fenced or within prose); null if there is no such list.

    Elements: true and false are booleans, numbers and numeric text are numbers, other text is itself with its blanks.
    Null is None, and a list or object within the list is its text, with single quotes and blanks after commas and colons.
    """
    bare = F.regexp_replace(F.trim(answer), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    first, last = F.instr(bare, "["), F.char_length(bare) - F.instr(F.reverse(bare), "]") + 1
    inner = F.when((first > 0) & (F.instr(bare, "]") > 0) & (last >= first), F.substring(bare, first, last - first + 1))
    parsed = F.try_variant_get(F.try_parse_json(inner), "$", "array<variant>")

    def token(v: Column) -> Column:
        kind, as_text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        long_number = kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
        return (
            F.when(kind == "BOOLEAN", boolean(F.try_variant_get(v, "$", "boolean")))
            .when(kind == "VOID", F.lit("None"))
            .when(kind == "BIGINT", integer(F.try_variant_get(v, "$", "bigint")))
            .when(long_number, whole_number(as_text))
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), decimal(F.try_variant_get(v, "$", "double")))
            .when(kind == "STRING", answer_text(as_text))
            .otherwise(nested(as_text))
        )

    return F.array_distinct(F.transform(parsed, token))
