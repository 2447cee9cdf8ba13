"""Property and class names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: names that a property may not have; they get the prefix.
RESERVED = ("id", "labels", "type", "start", "end")
PREFIX = "ifc_"


def canonical(name: Column) -> Column:
    """Letters and digits (of any script) joined by single underscores; a reserved name is prefixed.  Idempotent."""
    plain = F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.when(F.lower(plain).isin(*RESERVED), F.concat(F.lit(PREFIX), plain)).otherwise(plain)


def dump_name(name: Column) -> Column:
    """The looser form of model dumps: blanks, dots and dashes become underscores, anything else odd is dropped, nothing collapses."""
    return F.regexp_replace(F.regexp_replace(name, r"[ .\-]", "_"), r"[^\p{L}\p{N}_]", "")


def unique_names(names: Column) -> Column:
    """An array of names made unique in order: a taken name becomes the first free of name_1, name_2 and so on."""

    def place(acc: Column, name: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(0), F.size(acc)), lambda k: F.when(k == 0, name).otherwise(F.concat_ws("_", name, k.cast("string"))))
        free = F.get(F.filter(numbered, lambda n: ~F.array_contains(acc, n)), F.lit(0))
        return F.concat(acc, F.array(F.when(~F.array_contains(acc, name), name).otherwise(free)))

    return F.aggregate(names, F.array().cast("array<string>"), place)


def humanised(label: Column) -> Column:
    """IfcBuildingStorey -> building storey: the words of a class name without its prefix, in lower case."""
    bare = F.regexp_replace(label, "^Ifc", "")
    words = F.regexp_extract_all(bare, F.lit(r"([A-Z][a-z]*|[0-9]+)"), F.lit(1))
    return F.lower(F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(bare))


def class_case(name: Column, known: Column | None = None) -> Column:
    """IFCWALL -> IfcWall: by a map from upper-case to proper names, else the prefix and a capital."""
    rest = F.substring(name, 4, 1 << 20)
    guess = F.when(F.upper(name).startswith("IFC"), F.concat(F.lit("Ifc"), F.initcap(F.lower(rest)))).otherwise(name)
    return F.coalesce(known[F.upper(name)], guess) if known is not None else guess


def safe_text(name: str) -> str:
    """The same of a text that the driver has."""
    return name.translate(str.maketrans("/: \\", "____"))[:50]


def file_safe(model: Column) -> Column:
    """A model name for file names: slashes, colons and blanks as underscores, at most 50 characters."""
    return F.substring(F.translate(model, "/: \\", "____"), 1, 50)
