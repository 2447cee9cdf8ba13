"""Dynamic property values, and the places where graph queries and Spark SQL differ.

A property may hold different types on different nodes.  Where such values meet in one column they are
a tagged struct (a *value*): t is one of string, integer, float, boolean, list, and the field of that
type holds the content.  A missing property is a null value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType(
    [
        T.StructField("t", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("l", T.ArrayType(T.StringType())),
    ]
)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value(col: Column, kind: T.DataType) -> Column:
    """A typed column as values; null stays null.  Dates and other types become strings."""

    def made(tag: str, **fields: Column) -> Column:
        parts = [F.lit(tag).alias("t")]
        for f in VALUE.fields[1:]:
            parts.append(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
        return F.when(col.isNotNull(), F.struct(*parts))

    if isinstance(kind, T.BooleanType):
        return made("boolean", b=col)
    if isinstance(kind, _INTEGERS):
        return made("integer", i=col)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return made("float", d=col)
    if isinstance(kind, T.ArrayType):
        return made("list", l=col)
    return made("string", s=col.cast("string"))


def number(v: Column) -> Column:
    """The number of a value, null if it is none."""
    return F.coalesce(v["d"], v["i"].cast("double"))


def shown(v: Column) -> Column:
    """A value as text."""
    return F.coalesce(v["s"], v["i"].cast("string"), v["d"].cast("string"), v["b"].cast("string"), F.array_join(v["l"], ","))


def equal(a: Column, b: Column) -> Column:
    """a = b: numbers compare as numbers, other types only with their own; unlike types are unequal, null gives null."""
    numeric = lambda v: v["t"].isin("integer", "float")
    same = F.when(numeric(a) & numeric(b), number(a) == number(b)).when(a["t"] == b["t"], F.coalesce(a["s"] == b["s"], a["b"] == b["b"], a["l"] == b["l"])).otherwise(F.lit(False))
    return F.when(a.isNotNull() & b.isNotNull(), same)


def less(a: Column, b: Column) -> Column:
    """a < b: null unless both are numbers, or both strings, or both booleans."""
    numeric = lambda v: v["t"].isin("integer", "float")
    return F.when(numeric(a) & numeric(b), number(a) < number(b)).when(a["t"] == b["t"], F.coalesce(a["s"] < b["s"], a["b"] < b["b"]))


def divide(a: Column, b: Column) -> Column:
    """a / b of numbers that are not both whole: infinity or NaN where b is zero.  (Whole numbers: see whole_division.)"""
    sign = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, sign).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def descending(col: Column) -> Column:
    """Largest first, null counting as largest."""
    return col.desc_nulls_first()


def ascending(col: Column) -> Column:
    """Smallest first, null counting as largest."""
    return col.asc_nulls_last()


def total(col: Column) -> Column:
    """The sum, 0 of nothing."""
    return F.coalesce(F.sum(col), F.lit(0))


def to_integer(col: Column) -> Column:
    """toInteger: cuts the fraction off, null if the text is no number."""
    return col.try_cast("double").try_cast("bigint")


def to_float(col: Column) -> Column:
    return col.try_cast("double")


def to_boolean(col: Column) -> Column:
    """toBoolean: only true and false, in any case."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def whole_division(a: str, b: str) -> Column:
    """a div b of two integer columns, cut towards zero."""
    return F.expr(f"{a} div {b}")


def once(col: Column, made: Callable[[Column], Column]) -> Column:
    """made(col), in which col is computed once however often it is named."""
    return F.get(F.transform(F.array(col), made), F.lit(0))


def json_text(col: Column) -> Column:
    """A text as a JSON string; null stays null."""
    whole = F.to_json(F.struct(col.cast("string").alias("v")))
    return F.when(col.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def item(json: Column) -> Column:
    """An element of a list, given as JSON, with the text that it has among elements of other types; null of null.

    true and false are True and False, numbers as they stand, texts themselves.
    """

    def made(j: Column) -> Column:
        text = F.when(j == "true", "True").when(j == "false", "False").when(j.startswith('"'), F.try_variant_get(F.try_parse_json(j), "$", "string")).otherwise(j)
        return F.when(j.isNotNull(), F.struct(j.alias("json"), text.alias("text")))

    return once(json, made)


def coerced_list(items: Column) -> Column:
    """The JSON of a list of `item`s, all of one type: elements of mixed types become texts, null ones go, of none the list is null.

    Booleans count as whole numbers where the first element is one (and not the other way round), whole and
    decimal numbers are of different types.
    """
    kind = lambda j: F.when(j.isin("true", "false"), "boolean").when(j.startswith('"'), "text").when(j.rlike("[.eE]"), "decimal").otherwise(F.lit("whole"))

    def joined(kept: Column) -> Column:
        first = kind(F.get(kept, F.lit(0))["json"])
        alike = F.forall(kept, lambda x: (kind(x["json"]) == first) | (first == "whole") & (kind(x["json"]) == "boolean"))
        shown = F.when(alike, F.transform(kept, lambda x: x["json"])).otherwise(F.transform(kept, lambda x: json_text(x["text"])))
        return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")))

    return once(F.filter(items, lambda x: x.isNotNull()), joined)
