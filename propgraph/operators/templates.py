"""Few-shot examples: patterns with a question, a query text and a DataFrame form, kept if the graph meets and runs them.

A template looks for the first labels, in its own order, that fit what is known of a graph.  Its example is tried
on the graph with a limit of one row; what fails is left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.operators.graph import PropertyGraph
from propgraph.operators.match import match


@dataclass(frozen=True)
class Known:
    """What is known of a graph: nodes by label, listed values by label and key, (source, type, target) labels, numeric keys by label."""

    counts: dict[str, int]
    choices: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    signatures: list[tuple[str, str, str]] = field(default_factory=list)
    numbers: dict[str, list[str]] = field(default_factory=dict)

    def there(self, labels: tuple[str, ...]) -> Iterator[str]:
        return (x for x in labels if self.counts.get(x, 0) > 0)

    def choice(self, label: str, key: str) -> str | None:
        return next(iter(self.choices.get((label, key), [])), None)

    def relation(self, src: str, dst: str) -> str | None:
        return min((kind for a, kind, b in self.signatures if (a, b) == (src, dst)), default=None)

    def number(self, label: str) -> str | None:
        return min(self.numbers.get(label, []), default=None)


@dataclass(frozen=True)
class Domain:
    """The labels that templates look for, in this order.  place: what contains others and is told by its name."""

    # Labels of building models.
    counted: tuple[str, ...] = ("IfcWall", "IfcDoor", "IfcWindow", "IfcSpace", "IfcColumn", "IfcSlab", "IfcBeam")
    filtered: tuple[str, ...] = ("IfcWall", "IfcDoor", "IfcWindow", "IfcSpace", "IfcColumn", "IfcSlab", "IfcBeam", "IfcStair", "IfcRamp")
    contained: tuple[str, ...] = ("IfcDoor", "IfcWindow", "IfcWall")
    summed: tuple[str, ...] = ("IfcWindow", "IfcDoor", "IfcWall", "IfcSpace", "IfcColumn")
    largest: tuple[str, ...] = ("IfcColumn", "IfcWall", "IfcWindow", "IfcDoor", "IfcSpace")
    place: str = "IfcBuildingStorey"
    room: str = "IfcSpace"
    rooms: str = "rooms"


@dataclass(frozen=True)
class Example:
    question: str
    text: str
    run: Callable[[PropertyGraph], DataFrame]


def words(label: str) -> str:
    return " ".join(re.findall("[A-Z][a-z]*|[0-9]+", label.removeprefix("Ifc"))).lower() or label


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def counting(known: Known, domain: Domain) -> Example | None:
    for label in known.there(domain.counted):
        return Example(f"How many {words(label)} elements are in the model?", f"MATCH (n:{label}) RETURN count(n)", lambda g: match(g, "n", label).agg(F.count("n").alias("count(n)")))
    return None


def filtering(known: Known, domain: Domain) -> Example | None:
    """By a listed value: of the labels looked for first, else of any but the place's."""
    listed = sorted(k for k, own in known.choices.items() if own and known.counts.get(k[0], 0) > 0)
    for label, key in [*(k for x in domain.filtered for k in listed if k[0] == x), *(k for k in listed if k[0] != domain.place)]:
        value = known.choices[label, key][0]
        return Example(f"Find {words(label)} elements where {key} is '{value}'", f"MATCH (n:{label}) WHERE n.{key} = {quoted(value)} RETURN n", lambda g: match(g, "n", label).where(F.col(f"n.`{key}`") == value).select("n"))
    return None


def _within(known: Known, domain: Domain, label: str, var: str, what: str) -> Example | None:
    place, kind = known.choice(domain.place, "Name"), known.relation(domain.place, label)
    if place is None or kind is None:
        return None
    return Example(
        f"How many {what} are on '{place}'?",
        f"MATCH (s:{domain.place})-[:{kind}]->({var}:{label}) WHERE s.Name = {quoted(place)} RETURN count({var})",
        lambda g: match(g, "s", domain.place).where(F.col("s.Name") == place).hop(kind, var, label).agg(F.count(var).alias(f"count({var})")),
    )


def containing(known: Known, domain: Domain) -> Example | None:
    return next((e for x in known.there(domain.contained) if (e := _within(known, domain, x, "d", f"{words(x)} elements"))), None)


def rooms(known: Known, domain: Domain) -> Example | None:
    """Apart from elements, as rooms can be below a place by another relation."""
    return next((_within(known, domain, x, "sp", domain.rooms) for x in known.there((domain.room,))), None)


def summing(known: Known, domain: Domain) -> Example | None:
    for label in known.there(domain.summed):
        if key := known.number(label):
            return Example(f"What is the total {key} of all {words(label)} elements?", f"MATCH (n:{label}) RETURN sum(n.{key})", lambda g: match(g, "n", label).agg(F.coalesce(F.sum(f"n.`{key}`"), F.lit(0)).alias(f"sum(n.{key})")))
    return None


def topping(known: Known, domain: Domain) -> Example | None:
    for label in known.there(domain.largest):
        if key := known.number(label):
            return Example(f"Which {words(label)} element has the largest {key}?", f"MATCH (n:{label}) RETURN n.Name ORDER BY n.{key} DESC LIMIT 1", lambda g: match(g, "n", label).df.orderBy(F.col(f"n.`{key}`").desc_nulls_first()).limit(1).select(F.col("n.Name").alias("n.Name")))
    return None


TEMPLATES = (counting, filtering, containing, rooms, summing, topping)


def runs(graph: PropertyGraph, example: Example) -> bool:
    """Whether the example's DataFrame form gives a first row, or none, without an error of Spark's."""
    try:
        example.run(graph).limit(1).collect()
    except PySparkException:
        return False
    return True


def examples(graph: PropertyGraph, known: Known, domain: Domain = Domain(), most: int = 6) -> list[Example]:
    """The templates' examples that the graph meets and runs, each text once."""
    out: dict[str, Example] = {}
    for template in TEMPLATES:
        example = template(known, domain)
        if example and example.text not in out and len(out) < most and runs(graph, example):
            out[example.text] = example
    return list(out.values())
