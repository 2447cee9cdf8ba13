"""Patterns: chains of hops over a property graph, written with the DataFrame API.

    match(g, "s", "Nation").hop("CONTAINS", "c", "Customer").where(F.col("s.Name") == "NATION_3")

Every named variable is a struct column of node_id and properties, so ``s.Name`` is a plain column for
filters and projections; Catalyst prunes what is not used.  A hop reads only the parts of its edge type
that the labels at both ends allow, and to an unnamed end it joins those edges alone: parts between
known leaves need no look at the nodes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propgraph.operators.graph import PropertyGraph, with_ids


@dataclass(frozen=True)
class Hop:
    """A hop as it was asked for: from one variable to another, along its direction."""

    kind: str | None
    start: str
    var: str
    labels: tuple[str, ...]
    direction: str
    how: str
    once: bool
    anonymous: bool


#: A condition, or what a semi or anti join leaves, of frames with given variables.
Step = tuple[frozenset[str], Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class Pattern:
    graph: PropertyGraph
    df: DataFrame
    at: str  # the variable that the next hop leaves from
    hops: int = 0
    used: tuple[tuple[str, str], ...] = ()  # (edge type, edge id column) of this pattern
    leaves: tuple[tuple[str, frozenset[str]], ...] = ()  # leaf labels that a variable may have
    asked: tuple[Hop, ...] = ()
    steps: tuple[Step, ...] = ()  # conditions and semi joins, in order
    plain: bool = True  # whether hops and steps say all that df does
    first: DataFrame | None = None  # the nodes that the pattern begins at

    @property
    def variables(self) -> list[str]:
        return [v for v, _ in self.leaves] or [self.at]

    def _named(self, *columns: Column | str) -> frozenset[str]:
        """The variables that columns name; more than they do where a text looks like one."""
        text = " ".join(str(c) for c in columns)
        return frozenset(v for v in self.variables if re.search(rf"(?<![\w.]){re.escape(v)}(?!\w)", text))

    def where(self, *conditions: Column) -> Pattern:
        df, steps = self.df, self.steps
        for c in conditions:
            df = df.where(c)
            steps = (*steps, (self._named(c), lambda rows, c=c: rows.where(c)))
        return replace(self, df=df, steps=steps)

    def from_(self, var: str) -> Pattern:
        """The next hop leaves from this variable."""
        return replace(self, at=var)

    def _may_be(self, var: str) -> set[str] | None:
        return dict(self.leaves).get(var)

    def _edges(self, kind: str | None, direction: str, var: str, labels: tuple[str, ...], identified: bool = False, raw: bool = False) -> tuple[DataFrame, bool] | None:
        """(edges as _from, _to and edge_id if identified; whether the far end's labels are settled by the parts taken)."""
        near, far = self._may_be(var), set(self.graph.leaves(*labels)) if labels else None
        if kind is None:
            df, settled = self.graph.all_edges().select("src", "dst"), not labels
        elif kind not in self.graph.edges:
            return None
        else:
            table = self.graph.edges[kind]
            ends = {"out": (near, far), "in": (far, near)}.get(direction, (None, None))
            df = table.between(*ends, raw, direction == "in").select("src", "dst")
            settled = not labels or direction != "both" and table.known("dst" if direction == "out" else "src")
        if identified:
            df = with_ids(df, bool(kind) and self.graph.edges[kind].unique)
        names = ["src", "dst"] if direction != "in" else ["dst", "src"]
        more = ["edge_id"] if identified else []
        out = df.select(F.col(names[0]).alias("_from"), F.col(names[1]).alias("_to"), *more)
        if direction == "both":
            loops = df.where("src <> dst").select(F.col("dst").alias("_from"), F.col("src").alias("_to"), *more)
            out = out.unionAll(loops)
        return out, settled

    def hop(self, kind: str | None, var: str | None = None, *labels: str, direction: str = "out", how: str = "inner", same_type_again: bool = False) -> Pattern:
        """Follow edges of a type (None: any) to nodes with any of the labels (none: any node).

        direction: out, in or both.  An unknown type or label matches nothing.  how="left" keeps what has
        no match.  Within a pattern an edge is used once: give same_type_again on every hop of a type
        that the pattern follows more than once.
        """
        k = self.hops + 1
        found = self._edges(kind, direction, self.at, labels, same_type_again)
        anonymous = var is None
        var = var or f"_{k}"
        may_be = frozenset(self.graph.leaves(*labels))
        if found is None or not may_be:
            far = F.lit(None).cast("struct<node_id:string>").alias(var)
            df = self.df.withColumn(var, far) if how == "left" else self.df.withColumn(var, far).where(F.lit(False))
            return replace(self, df=df, at=var, hops=k, plain=False)
        edges, settled = found
        start = F.col(f"{self.at}.node_id")
        used = self.used
        if same_type_again:
            edges = edges.withColumnRenamed("edge_id", f"_edge{k}")
        edges = edges.withColumnsRenamed({"_from": f"_from{k}", "_to": f"_to{k}"})
        to = F.col(f"_to{k}")
        if anonymous and settled:
            reach = edges.select("*", F.struct(to.alias("node_id")).alias(var))
        elif anonymous:
            ends = self.graph.nodes(*labels).select(F.col("node_id").alias("_end"))
            reach = edges.join(ends, to == F.col("_end"), "left_semi").select("*", F.struct(to.alias("node_id")).alias(var))
        else:
            ends = self.graph.nodes(*labels)
            nodes = ends.select(F.struct(*ends.columns).alias(var))
            reach = edges.join(nodes, to == F.col(f"{var}.node_id"))
        df = self.df.join(reach, start == F.col(f"_from{k}"), how)
        if same_type_again:
            for other, column in used:
                if other == kind:
                    df = df.where(F.col(column) != F.col(f"_edge{k}"))
            used = (*used, (kind or "", f"_edge{k}"))
        asked = (*self.asked, Hop(kind, self.at, var, labels, direction, how, same_type_again, anonymous))
        return replace(self, df=df.drop(f"_from{k}", f"_to{k}"), at=var, hops=k, used=used, leaves=(*self.leaves, (var, may_be)), asked=asked)

    def _ends(self, hop: Hop, toward: str) -> tuple[DataFrame, bool]:
        """(_from, _to) of a hop's edges seen toward one of its ends; whether both ends' labels are settled by the parts taken."""
        start, far = self._may_be(hop.start), self._may_be(hop.var)
        if hop.kind is None or hop.direction == "both":
            edges, settled = self._edges(hop.kind, hop.direction, hop.start, hop.labels, raw=True)
            edges, settled = (edges if toward == hop.var else edges.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))), False
        else:
            table = self.graph.edges[hop.kind]
            out = (hop.direction == "out") == (toward == hop.var)
            pair = (start, far) if hop.direction == "out" else (far, start)
            rows = table.between(set(pair[0]), set(pair[1]), True, not out)
            edges, settled = rows.select(F.col("src" if out else "dst").alias("_from"), F.col("dst" if out else "src").alias("_to")), table.known("src") and table.known("dst")
        return edges, settled

    def distinct(self, *columns: Column | str) -> DataFrame:
        """The distinct rows of some columns.

        Variables that neither the columns nor a condition shared with another variable names are not multiplied: the
        pattern is reduced from its leaves by semi joins, each leaf into the variable before it, and joined only
        between the variables that are needed.  Optional hops to variables that nothing needs are left out.
        """
        plain = self.plain and self.first is not None and not any(h.once for h in self.asked)
        steps = [s for s in self.steps if s[0]]
        names = [v for v, _ in self.leaves]
        if not plain or len(steps) < len(self.steps) or any(h.how != "inner" and h.how != "left" for h in self.asked) or any(h.how == "left" and any(h.var in s[0] for s in steps) for h in self.asked):
            return self.df.select(*columns).distinct()
        live = set(self._named(*columns)).union(*(s[0] for s in steps if len(s[0]) > 1))
        hops = list(self.asked)
        while loose := [h for h in hops if h.how == "left" and h.var not in live and all(o.start != h.var for o in hops)]:
            hops = [h for h in hops if h not in loose]  # an optional hop takes no row away
        if any(h.how == "left" for h in hops) or not live:
            return self.df.select(*columns).distinct()
        about = {v: [s for s in steps if s[0] == {v}] for v in names}
        beside = {v: [h for h in hops if v in (h.start, h.var)] for v in names}
        labels = {h.var: h.labels for h in self.asked}

        def other(h: Hop, v: str) -> str:
            return h.var if v == h.start else h.start

        def needed(v: str, past: Hop | None) -> bool:
            return v in live or any(needed(other(h, v), h) for h in beside[v] if h is not past)

        def nodes(v: str) -> DataFrame:
            if v == names[0]:
                return self.first
            own = self.graph.nodes(*labels[v])
            return own.select(F.struct(*own.columns).alias(v))

        def kept(v: str, past: Hop | None) -> DataFrame:
            """The rows of v and of needed variables beyond it that fit what lies there."""
            rows = nodes(v)
            for _, step in about[v]:
                rows = step(rows)
            ahead = sorted((h for h in beside[v] if h is not past), key=lambda h: needed(other(h, v), h))
            for h in ahead:  # semi joins first
                to, mine = other(h, v), F.col(f"{v}.node_id")
                if needed(to, h):
                    edges, _ = self._ends(h, to)
                    far = kept(to, h)
                    rows = rows.join(edges, mine == F.col("_from")).join(far, F.col("_to") == F.col(f"{to}.node_id")).drop("_from", "_to")
                else:
                    rows = rows.join(reached(v, h), mine == F.col("_from"), "left_semi")
            return rows

        def reached(v: str, h: Hop) -> DataFrame:
            """(_from): ids of v's side of a hop beyond which something fits."""
            to = other(h, v)
            edges, settled = self._ends(h, to)
            bare = settled and h.anonymous and to == h.var and not about[to]
            beyond = [o for o in beside[to] if o is not h]
            if bare and not beyond:
                return edges.select("_from")
            if bare:
                for o in beyond:
                    edges = edges.join(reached(to, o).withColumnRenamed("_from", "_next"), F.col("_to") == F.col("_next"), "left_semi")
                return edges.select("_from")
            return edges.join(kept(to, h), F.col("_to") == F.col(f"{to}.node_id"), "left_semi").select("_from")

        start = next(v for v in names if v in live)
        rows = kept(start, None)
        for used, step in steps:
            if len(used) > 1:
                rows = step(rows)
        return rows.select(*columns).distinct()

    def _reaching(self, kind: str | None, labels: tuple[str, ...], direction: str, var: str) -> DataFrame | None:
        found = self._edges(kind, direction, var, labels, raw=True)
        if found is None or not self.graph.leaves(*labels):
            return None
        edges, settled = found
        if not settled:
            ends = self.graph.nodes(*labels).select(F.col("node_id").alias("_end"))
            edges = edges.join(ends, F.col("_to") == F.col("_end"), "left_semi")
        return edges.select("_from")

    def having(self, kind: str | None, *labels: str, var: str | None = None, direction: str = "out") -> Pattern:
        """Keep what has such a hop (a semi join)."""
        reach = self._reaching(kind, labels, direction, var or self.at)
        if reach is None:
            return replace(self, df=self.df.where(F.lit(False)), plain=False)
        return self._beside(reach, var or self.at, "left_semi")

    def _beside(self, reach: DataFrame, var: str, how: str) -> Pattern:
        step = lambda rows: rows.join(reach, F.col(f"{var}.node_id") == F.col("_from"), how)
        return replace(self, df=step(self.df), steps=(*self.steps, (frozenset({var}), step)))

    def lacking(self, kind: str | None, *labels: str, var: str | None = None, direction: str = "out") -> Pattern:
        """Keep what has no such hop (an anti join)."""
        reach = self._reaching(kind, labels, direction, var or self.at)
        if reach is None:
            return self
        return self._beside(reach, var or self.at, "left_anti")

    def flagged(self, name: str, kind: str | None, *labels: str, var: str | None = None, direction: str = "out") -> Pattern:
        """Add a boolean column: whether such a hop exists, for conditions under OR."""
        reach = self._reaching(kind, labels, direction, var or self.at)
        if reach is None:
            return replace(self, df=self.df.withColumn(name, F.lit(False)), plain=False)
        known = reach.distinct()
        df = self.df.join(known, F.col(f"{var or self.at}.node_id") == F.col("_from"), "left").withColumn(name, F.col("_from").isNotNull()).drop("_from")
        return replace(self, df=df, plain=False)

    def select(self, *columns: Column | str) -> DataFrame:
        return self.df.select(*columns)

    def agg(self, *columns: Column) -> DataFrame:
        """One row, whatever matches."""
        return self.df.agg(*columns)

    def groupBy(self, *columns: Column | str):  # noqa: N802 (as in PySpark)
        return self.df.groupBy(*columns)


def match(graph: PropertyGraph, var: str, *labels: str) -> Pattern:
    """Begin a pattern at nodes with any of the labels; an unknown label matches nothing."""
    nodes = graph.nodes(*labels)
    if nodes is None:
        some = next(iter(graph.tables.values())).df
        return Pattern(graph, some.where(F.lit(False)).select(F.struct("node_id").alias(var)), var)
    first = nodes.select(F.struct(*nodes.columns).alias(var))
    return Pattern(graph, first, var, leaves=((var, frozenset(graph.leaves(*labels))),), first=first)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df beside the columns of a frame of one row (a global aggregate): the row is broadcast."""
    return df.join(F.broadcast(one_row), how="cross")
