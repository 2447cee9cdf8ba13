"""Shards along a Hilbert curve over several metadata dimensions.

Dimensions are quantised to BITS bits each; their bit planes drive a table of curve states (built from
the rule of Hamilton's compact Hilbert indices) to an index of at most 2 ** 16 values.  Groups of rows
that belong together (equal texts) are ordered by that index and cut into runs of about equal bytes, so a
shard is a compact region and no group is torn.  Coordinates are quantiles, so rows are
spread over all planes, as few shards are cut by the top planes alone: a filter on any dimension prunes
shards, but for rows that lie with a copy of theirs.  Places are
found without a global sort: sums over curve cells give offsets, and a place within its cell is a window
over that cell; a large cell is dealt into sub-cells of bounded size first.  All is DataFrame code; only
ids, sizes, hashes and curve indices are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propgraph.llm.common import stored

BITS = 4
#: Values of a dimension that have places of their own.
VALUES = 64
#: Rows that a cell holds before it is dealt into sub-cells; a thousandth of the input where that is more.
CELL_ROWS = 8192


def by_value(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """The quantile at which a value's rows have their middle, values in order; beyond the VALUES most frequent ones, and null: 0."""
    ranked = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).count().orderBy(F.desc("count"), "value")
    values = sorted(tuple(r) for r in ranked.limit(VALUES).collect())
    total, before, places = sum(n for _, n in values), 0, []
    for value, n in values:
        places.append(F.when(F.col(f"`{column}`") == value, F.lit((2 * before + n << bits) // (2 * total))))
        before += n
    return F.coalesce(*places, F.lit(0)).cast("int")


def by_quantile(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """How many of the (approximate) quantiles that cut the numbers into 2 ** bits parts lie below a number; null: 0."""
    parts = 1 << bits
    cuts = df.agg(F.percentile_approx(F.col(f"`{column}`"), [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    return F.coalesce(sum(((F.col(f"`{column}`") > cut).cast("int") for cut in cuts), F.lit(0)), F.lit(0))


def by_range(col: Column, low: int, high: int, bits: int = BITS) -> Column:
    """An equal cut of low to high; null or lower: 0."""
    width = max(1, -(-(high - low + 1) // (1 << bits)))
    return F.least(F.greatest(F.coalesce(F.floor((col - low) / width), F.lit(0)), F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def state_table(n: int) -> list[int]:
    """For state s = entry * n + direction and n-bit digit d, at [s * 2^n + d]: the curve's digit, plus the next state times 2^n."""
    size = 1 << n
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n) % n if k % n else 0)) & (size - 1)
    gray = lambda i: i ^ i >> 1
    ones = lambda i: (~i & (i + 1)).bit_length() - 1
    out = []
    for s in range(size * n):
        entry, direction = divmod(s, n)
        for digit in range(size):
            g = turn(digit ^ entry, n - (direction + 1) % n)
            w = 0
            while g:
                w, g = w ^ g, g >> 1
            into = gray(2 * ((w - 1) // 2)) if w else 0
            axis = 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
            following = (entry ^ turn(into, direction + 1)) * n + (direction + axis + 1) % n
            out.append(w + following * size)
    return out


def curve_index(dims: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of coordinates of `bits` bits each."""
    n = len(dims)
    table = F.array(*(F.lit(x) for x in state_table(n)))
    planes = F.array(*(sum((F.shiftright(d, k).bitwiseAND(1) * (1 << j) for j, d in enumerate(dims)), F.lit(0)).cast("long") for k in reversed(range(bits))))

    def step(acc: Column, plane: Column) -> Column:  # acc: index so far and, in the low 16 bits, the state
        found = F.get(table, (acc.bitwiseAND(0xFFFF) * (1 << n) + plane).cast("int"))
        index = F.shiftleft(F.shiftrightunsigned(acc, 16), n).bitwiseOR(found.bitwiseAND((1 << n) - 1).cast("long"))
        return F.shiftleft(index, 16).bitwiseOR(F.shiftright(found, n).cast("long"))

    return F.shiftrightunsigned(F.aggregate(planes, F.lit(0).cast("long"), step), 16).cast("int")


def _dealt(df: DataFrame, weight: int, *name: str) -> DataFrame:
    """df plus _fan: into how many sub-cells the rows of a cell (of equal `name` columns) are dealt; `weight`: all rows."""
    cells = df.groupBy(*name).count()
    return df.join(F.broadcast(cells.select(*name, F.ceil(F.col("count") / max(CELL_ROWS, weight >> 10)).alias("_fan"))), list(name))


def shard(df: DataFrame, dims: list[Column], shards: int, key: str, size: Column, group: Column, keep: dict[str, Column]) -> DataFrame:
    """One row per row of df: the `keep` columns, curve (that of the row's group: the least of its rows), shard (0 to shards - 1) and slot (gapless from 0 in its shard).

    Rows of equal `group` (a hash) are in one shard.  Groups are ordered by curve index, sub-cell and group;
    shards are runs of that order of about equal sums of `size`: a group lies where its middle does, so a shard
    differs from its share by one group's size at each end at most.  Slots go by curve index, sub-cell, group and
    key, with nulls first; rows equal in these are alike.  An empty table gives no rows.  What is broadcast is a
    row per occupied cell, sub-cell and shard: at most 2 ** 16 and some thousands more.
    """
    made = {"_key": F.col(key), "_group": group, "_size": size.cast("long"), "_curve": curve_index(dims)} | {f"_keep{k}": c for k, c in enumerate(keep.values())}
    rows = stored(df.select(*(c.alias(k) for k, c in made.items())), "hilbert-rows")
    groups = rows.groupBy("_group").agg(F.min("_curve").alias("_curve"), F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    total, many, different = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.sum("_rows"), F.lit(0)), F.count("*")).first()
    dealt = _dealt(groups, different, "_curve").withColumn("_sub", F.pmod(F.xxhash64(F.lit("sub"), "_group"), F.col("_fan")).cast("int")).drop("_fan")
    order = Window.orderBy("_curve", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_curve", "_sub").agg(F.sum("_bytes").alias("_b")).select("_curve", "_sub", F.coalesce(F.sum("_b").over(order), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_curve", "_sub").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    spots = dealt.withColumn("_within", F.coalesce(F.sum("_bytes").over(own), F.lit(0))).join(F.broadcast(offsets), ["_curve", "_sub"])
    middle = (F.col("_before") + F.col("_within")) * 2 + F.col("_bytes")
    spots = spots.withColumn("_middle", middle).withColumn("shard", F.least(F.expr(f"cast(_middle * {shards} div {max(2, 2 * total)} AS int)"), F.lit(shards - 1)))
    placed = rows.drop("_curve").join(spots.select("_group", "_curve", "_sub", "shard"), "_group")
    placed = _dealt(placed, many, "shard", "_curve", "_sub").withColumn("_deal", F.pmod(F.xxhash64(F.lit("deal"), "_key", "_group"), F.col("_fan")).cast("int"))
    cell = ["shard", "_curve", "_sub", "_deal"]
    ahead = Window.partitionBy("shard").orderBy(*cell[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*cell).count().select(*cell, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_group", "_key"))
    numbered = placed.withColumn("_rank", rank).join(F.broadcast(starts), cell)
    return numbered.select(*(F.col(f"_keep{k}").alias(name) for k, name in enumerate(keep)), F.col("_curve").alias("curve"), "shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"))
