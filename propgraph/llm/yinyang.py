"""Centroid clustering of integer vectors by Yinyang grouping, exact to the last tie.

Centroids are clustered into groups once.  A vector carries an upper bound of the distance to its own
centroid and one lower bound per group of the distance to the group's other centroids; when centroids
move, bounds move by as much.  A vector whose least lower bound is above its upper bound keeps its
centroid without a look at any other (global filter); else its own distance is computed and the groups
whose bound is still not above it (group filter) are scanned, in exact integers.  Filters only skip
what is farther for sure, so every assignment is that of a full scan.

A round is one narrow pass over the vectors, written to the shared folder; the round before it is then
deleted.  Centroids are updated by the vectors that moved: sums over them are pre-aggregated per task,
and the driver holds k vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import discard, prepare, rebatched, stored_at

#: Centroids of one group.
GROUP = 10
#: Components up to this size have distances that are exact in 64 bits (64 of (2 * 2 ** 27) ** 2), in floating point below EXACT.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Rows worked on at a time.
ROWS = 8192


@dataclass
class Centroids:
    """k vectors, their groups, and how far each has moved since bounds were last made (at most, by group)."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.group.max()) + 1

    def drift(self) -> np.ndarray:
        return np.array([self.moved[self.group == g].max() for g in range(self.groups)])

    def to(self, at: np.ndarray) -> Centroids:
        return Centroids(at, self.group, np.sqrt(((at - self.at) ** 2).sum(1).astype("f8")))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, exact: products of small components are whole numbers in floating point too."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype("f8"), c.astype("f8")
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype("i8")
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def grouped(at: np.ndarray, size: int = GROUP, rounds: int = 5) -> Centroids:
    """Centroids in len / size groups, by a few rounds of clustering among themselves (groups decide speed, not results)."""
    heads = at[:: max(size, 1)][: max(1, len(at) // size)]
    for _ in range(rounds):
        _, group = np.unique(squared(at, heads).argmin(1), return_inverse=True)
        heads = np.stack([np.floor(at[group == g].mean(0)).astype("i8") for g in range(group.max() + 1)])
    return Centroids(at, group.astype("i8"), np.zeros(len(at)))


def _clear(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Whether a lower bound is above an upper one by more than rounding can amount to."""
    return lower > upper * (1 + 1e-9) + 1e-6


def scan(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, upper, lower) by a look at every centroid."""
    d = squared(x, c.at)
    own = d.argmin(1)
    least = d[np.arange(len(x)), own]
    others = d.astype("f8")
    others[np.arange(len(x)), own] = np.inf
    lower = np.sqrt(np.stack([others[:, c.group == g].min(1) for g in range(c.groups)], 1))
    return own, least, np.sqrt(least.astype("f8")), lower


def filtered(x: np.ndarray, c: Centroids, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after centroids moved, by filters: the squared distance is exact for rows that were looked at, else -1."""
    own, upper, lower = own.copy(), upper + c.moved[own], np.maximum(lower - c.drift(), 0)
    exact = np.full(len(x), -1, "i8")
    rows = np.flatnonzero(~_clear(lower.min(1), upper))
    exact[rows] = own_distance(x[rows], c, own[rows])
    upper[rows] = np.sqrt(exact[rows].astype("f8"))
    rows = rows[~_clear(lower[rows].min(1), upper[rows])]
    was, best, to = own[rows], exact[rows].copy(), own[rows].copy()
    looks = []
    for g in range(c.groups):
        members = np.flatnonzero(c.group == g)
        at = np.flatnonzero(~_clear(lower[rows, g], upper[rows]))
        if not len(at):
            continue
        d = squared(x[rows[at]], c.at[members]).astype("f8")
        d[members == was[at][:, None]] = np.inf  # its own distance is known
        pick = d.argmin(1)
        first = d[np.arange(len(at)), pick]
        d[np.arange(len(at)), pick] = np.inf
        looks.append((g, at, members[pick], first, d.min(1)))
        better = (first < best[at]) | ((first == best[at]) & (members[pick] < to[at]))
        best[at[better]], to[at[better]] = first[better].astype("i8"), members[pick][better]
    for g, at, pick, first, second in looks:
        lower[rows[at], g] = np.sqrt(np.where(pick == to[at], second, first))
    left = np.flatnonzero(to != was)
    home = c.group[was[left]]
    lower[rows[left], home] = np.minimum(lower[rows[left], home], upper[rows[left]])
    own[rows], exact[rows], upper[rows] = to, best, np.sqrt(best.astype("f8"))
    return own, exact, upper, lower


def own_distance(x: np.ndarray, c: Centroids, own: np.ndarray) -> np.ndarray:
    return ((x - c.at[own]) ** 2).sum(1)


def integers(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * component) of vectors with exactly dims components, none of them null or not finite.

    Others are left out: they have no place in the space.  A component over LARGEST, whose distances no long can
    hold, is an error.
    """
    x = F.col(embedding)
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    large = F.exists(v, lambda e: F.abs(e) > LARGEST)
    rows = df.where((F.size(x) == dims) & ~odd).select(F.col(vec_id).alias("vec_id"), v.alias("v"), large.alias("large"))
    return rows.select("vec_id", F.when(F.col("large"), F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.col("v")).cast("array<int>").alias("v"))


def _listed(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pass(rows: DataFrame, c: Centroids, last: bool) -> DataFrame:
    """One assignment of every vector.  rows: vec_id, v and, after the first pass, cluster, upper, lower."""
    shared = rows.sparkSession.sparkContext.broadcast(c)
    begun, width = "cluster" in rows.columns, c.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in rebatched(batches, ROWS):
            if not batch.num_rows:
                continue
            x = _listed(batch.column("v"), width).astype("i8")
            if begun:
                before = batch.column("cluster").to_numpy().astype("i8")
                own, exact, upper, lower = filtered(x, now, before, batch.column("upper").to_numpy(), _listed(batch.column("lower"), now.groups))
            else:
                before = np.full(len(x), -1, "i8")
                own, exact, upper, lower = scan(x, now)
            cluster = pa.array(own.astype("i4"))
            if last:
                unseen = np.flatnonzero(exact < 0)
                exact[unseen] = own_distance(x[unseen], now, own[unseen])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cluster, pa.array(exact)], names=["vec_id", "cluster", "distance"])
            else:
                at = pa.array(np.arange(0, lower.size + 1, now.groups, dtype="i4"))
                bounds = pa.ListArray.from_arrays(at, pa.array(lower.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), cluster, pa.array(before.astype("i4")), pa.array(upper), bounds], names=["vec_id", "v", "cluster", "before", "upper", "lower"])

    kind = dict(rows.dtypes)["vec_id"]
    state = f"vec_id {kind}, v array<int>, cluster int, before int, upper double, lower array<double>"
    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long" if last else state)


def _gained(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What clusters gained in vectors and in componentwise sums by the rows that moved (as Python integers)."""
    moved = rows.where("cluster <> before")
    signed = moved.select("v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("s")))).alias("m"))
    sums = [F.sum(F.get("v", F.lit(i)).cast("long") * F.col("s")).alias(f"s{i}") for i in range(dims)]
    count, total = np.zeros(k, object), np.zeros((k, dims), object)
    for r in signed.select("v", "m.c", "m.s").where("c >= 0").groupBy("c").agg(F.sum("s").alias("n"), *sums).collect():  # k rows
        count[r["c"]], total[r["c"]] = r["n"], list(r[2:])
    return count, total


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, order: Column, k: int = 40, rounds: int = 5) -> DataFrame:
    """vectors (vec_id, v: array<int> of one length) plus cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k vectors that come first by `order` (fewer vectors: all of them), equal ones by
    their components; numbers are by that order.  Each round assigns every vector to the nearest centroid (ties:
    the smaller number) and replaces every centroid that has vectors by their floored mean; vectors are assigned
    once more at the end.  Null and repeated ids are vectors of their own; no vectors, no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows, path = stored_at(vectors, "vectors")
    first = [r["v"] for r in rows.select(order.alias("o"), "v").orderBy("o", "v").limit(k).collect()]
    if not first:
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    c = grouped(np.array(first, "i8"))
    k, dims = c.at.shape
    count, total = np.zeros(k, object), np.zeros((k, dims), object)
    for _ in range(rounds):
        rows, path, old = *stored_at(_pass(rows, c, False), "assigned"), path
        gained = _gained(rows, k, dims)
        discard(spark, old)
        count, total = count + gained[0], total + gained[1]
        c = c.to(np.array([total[j] // count[j] if count[j] else c.at[j] for j in range(k)], "i8"))
    found, _ = stored_at(_pass(rows, c, True), "clusters")
    discard(spark, path)
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows
    each = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        each([inertia.get(j, 0) for j in range(k)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        each([digest(x) for x in c.at]).alias("centroid_sha256"),
    )
