"""The prefix trie of conversations, from mergeable partial tries.

A node is a distinct sequence of first turns.  Its key is the exclusive or of two 64-bit hashes of every
turn with its depth: a running sum, so it needs no conversation in one place, and a node's parent has the
node's key without its last turn's hashes.

* Turns are put in order by a range shuffle; a conversation that spans partitions is counted and keyed by
  offsets from partition to partition, so none is ever gathered.
* Each partition combines its turns into a partial trie (a table of nodes); tables are merged by key, FAN
  partitions at a time, sums and least members with sums and least members, lists of ended conversations
  end to end as sorted stretches of text.
* The rollup goes bottom-up by doubling: after round k a node has the totals of the 2 ** k levels from it
  downwards, and adds those of the nodes 2 ** k below.  Its rounds are the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propgraph.llm.common import discard, prepare, rebatched, stored, stored_at, whole_text

#: Partial tries of so many partitions become one, in each round of merges.
FAN = 16
#: Conversations in one stretch of a list of ends.
STRETCH = 4096
#: Rows of equal order that may stand in different partitions.
SALTS = 64


def ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, t1, t2, chars): turns of each conversation numbered from 0 by turn (null first), role, text.

    Null role or text counts as empty; a null conversation id is an id of its own.  Equal rows are turns of their
    own, in any order.
    """
    spark = df.sparkSession
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), whole_text(F.col(role).cast("string")).alias("role"), whole_text(F.col(text).cast("string")).alias("text"))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    keys = ["conv", "turn", "role", "text", "salt"]
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    placed = dealt.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *hashes, F.char_length("text").cast("long").alias("chars"))
    placed, path = stored_at(placed, "turns")  # parts and places are those of one run
    own = Window.partitionBy("part", "conv").orderBy("at")
    counted = placed.withColumn("pos", F.row_number().over(own).cast("long") - 1)
    # only a part's first and last conversation can go on in another: at most two rows a part
    ends = placed.groupBy("part").agg(F.min_by("conv", "at").alias("a"), F.max_by("conv", "at").alias("b")).select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv"))
    sizes = placed.join(F.broadcast(ends.withColumnsRenamed({"part": "p", "conv": "c"})), F.expr("part = p AND conv <=> c")).groupBy("part", "conv").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.where("base > 0").select(F.col("part").alias("p"), F.col("conv").alias("c"), "base")
    whole = counted.join(F.broadcast(before), F.expr("part = p AND conv <=> c"), "left").select("conv", (F.col("pos") + F.coalesce("base", F.lit(0))).alias("pos"), "t1", "t2", "chars")
    kept = stored(whole, "ordered")
    discard(spark, path)
    return kept


def keyed(turns: DataFrame) -> DataFrame:
    """turns (conv, n, depth from 1, t1, t2, chars) with k1, k2 (the node's key) and p1, p2 (its parent's).

    A running exclusive or by conversation.  Conversations of more than STRETCH turns are run over in stretches, which
    begin with the key of the stretches before them, so one conversation is many tasks' work.
    """
    mixed = turns.select("conv", "n", "depth", "chars", F.floor((F.col("depth") - 1) / STRETCH).alias("stretch"), *(F.xxhash64("depth", f"t{k}").alias(f"m{k}") for k in (1, 2)))
    within = Window.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = mixed.select("*", *(F.bit_xor(f"m{k}").over(within).alias(f"x{k}") for k in (1, 2)))
    whole = mixed.where(F.col("n") > STRETCH).groupBy("conv", "stretch").agg(*(F.bit_xor(f"m{k}").alias(f"x{k}") for k in (1, 2)))
    past = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select("conv", "stretch", *(F.bit_xor(f"x{k}").over(past).alias(f"b{k}") for k in (1, 2))).where("stretch > 0")
    base = base.select(F.col("conv").alias("c"), F.col("stretch").alias("s"), "b1", "b2")
    zero = F.lit(0).cast("long")
    later = run.where("stretch > 0").join(base, F.expr("conv = c AND stretch = s")).drop("c", "s")
    both = run.where("stretch = 0").withColumns({"b1": zero, "b2": zero}).unionByName(later)
    keys = both.select("conv", "n", "depth", "chars", "m1", "m2", *(F.col(f"x{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"k{k}") for k in (1, 2)))
    return keys.select("conv", "n", "depth", "chars", "k1", "k2", *(F.col(f"k{k}").bitwiseXOR(F.col(f"m{k}")).alias(f"p{k}") for k in (1, 2)))


def merged(turns: DataFrame) -> DataFrame:
    """(k1, k2, depth, p1, p2, chars, n_convs, conv): nodes, of partial tries merged FAN at a time.

    Spark's partial aggregation is the first step: what leaves a partition is one row per node of its own trie.
    """
    key = ["k1", "k2", "depth"]
    keep = [F.first(c).alias(c) for c in ("p1", "p2", "chars")]
    partial = turns.withColumn("from", F.floor(F.spark_partition_id() / FAN)).groupBy(*key, "from").agg(*keep, F.count("*").alias("n_convs"), F.min("conv").alias("conv"))
    return partial.groupBy(*key).agg(*keep, F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv): the digest of each node's ended conversations, ascending, comma-joined.

    A range shuffle over node and conversation makes sorted stretches of text in many tasks, whatever a node's share;
    a digest's own task reads a node's stretches one after another and keeps none.
    """
    keys = ["k1", "k2", "conv"]
    dealt = ends.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, STRETCH):
            k1, k2, conv = (batch.column(c).to_pylist() for c in keys)
            out, begin = [], 0
            for i in range(1, len(conv) + 1):
                if i == len(conv) or i - begin == STRETCH or (k1[i], k2[i]) != (k1[begin], k2[begin]):
                    out.append((k1[begin], k2[begin], conv[begin], ",".join(map(str, conv[begin:i]))))
                    begin = i
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "conv", "ids"), x, strict=True)) for x in out], schema=schema)

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("conv", pa.int64()), ("ids", pa.string())])
    texts = dealt.mapInArrow(stretches, "k1 long, k2 long, conv long, ids string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("ids"), strict=True):
                if (k1, k2) != now:
                    if now is not None:
                        out.append((*now, running.hexdigest()))
                    now, running = (k1, k2), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.as_py().encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "d"), x, strict=True)) for x in out], schema=done)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"k1": now[0], "k2": now[1], "d": running.hexdigest()}], schema=done)

    done = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("d", pa.string())])
    return texts.repartition("k1", "k2").sortWithinPartitions(*keys).mapInArrow(digests, "k1 long, k2 long, d string").withColumnRenamed("d", "ends_sha256")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """nodes (k1, k2, p1, p2, depth, leaves, saved) with leaves and saved summed over subtrees.

    Round k adds to each node what the nodes 2 ** k below it hold, and doubles how far up each node points.
    """
    state = nodes.select("k1", "k2", "depth", "leaves", "saved", F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    reach = 1
    while reach <= deepest:
        given = state.where(F.col("depth") >= reach).groupBy("a1", "a2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        given = given.withColumnsRenamed({"a1": "g1", "a2": "g2"})
        summed = state.join(given, F.expr("k1 = g1 AND k2 = g2"), "left")
        added = summed.select("k1", "k2", "depth", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")), "a1", "a2")
        if 2 * reach <= deepest:  # else nothing is so far below another
            up = state.where(F.col("depth") >= reach).select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
            far = added.where(F.col("depth") >= 2 * reach).join(up, F.expr("a1 = u1 AND a2 = u2"), "left").select("k1", "k2", "depth", "leaves", "saved", F.col("b1").alias("a1"), F.col("b2").alias("a2"))
            near = added.where(F.col("depth") < 2 * reach).select("k1", "k2", "depth", "leaves", "saved", F.lit(None).cast("long").alias("a1"), F.lit(None).cast("long").alias("a2"))
            added = stored(far.unionByName(near), "rollup")
        state, reach = added, 2 * reach
    return state.select("k1", "k2", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv, n, depth from 1 to n, t1, t2, chars) of the conversations convs (conv, n: how many turns); those without turns end at the root.  No conversations, no rows: there is no root either.
    """
    prepare(turns.sparkSession)
    paths = stored(keyed(turns), "paths")
    nodes = merged(paths)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"), "n_convs", "conv")
    nodes = stored(nodes.select(*root.columns).unionByName(root), "nodes")
    total = nodes.agg(F.max("depth"), F.min(F.when(F.col("depth") == 0, F.col("conv")))).first()
    deepest, least = total[0] or 0, total[1]
    last = paths.where("depth = n").select("k1", "k2", "conv")
    ends = end_digests(last.unionByName(convs.where("n = 0").select(zero.alias("k1"), zero.alias("k2"), "conv")))
    ends = ends.withColumnsRenamed({"k1": "e1", "k2": "e2"})
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, F.expr("k1 = c1 AND k2 = c2"), "left").withColumn("n_children", F.coalesce("n_children", zero)).drop("c1", "c2")
    known = known.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    known = stored(known, "nodes-known")
    sums = rolled_up(known, deepest).withColumnsRenamed({"k1": "r1", "k2": "r2"})
    whole = known.join(sums, F.expr("k1 = r1 AND k2 = r2")).join(ends, F.expr("k1 = e1 AND k2 = e2"), "left")
    parents = nodes.where("n_convs > 0").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv").alias("parent"))
    # every first turn's parent is the root, which is known; parents of others are looked up
    deeper = whole.where("depth > 1").join(parents, F.expr("p1 = q1 AND p2 = q2"), "left")
    rest = whole.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(least).cast("long")))
    shown = lambda rows: rows.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
    return shown(deeper).unionByName(shown(rest))


def rebuilt(df: DataFrame, block: int = 100, most: int = 6, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations that share their block's beginning, as `trie` takes them.

    Conversation c has the first h turns of conversation c - c % block (all if it has fewer, none if it is
    absent), then its own after the first h; h is the CRC-32 of c in decimal, modulo `most`.  Rows of null
    conversation id have no c: they are left out.
    """
    turns = ordered(df.where(F.col(conv).isNotNull()), conv, turn, role, text)
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    owns = own.select("conv", "own", (F.col("conv") - F.col("conv") % block).alias("base"), h.alias("h"))
    bases = own.select(F.col("conv").alias("b"), F.col("own").alias("base_own"))
    known = owns.join(bases.where(F.col("b") % block == 0), F.expr("base = b"), "left")
    known = known.withColumn("borrowed", F.least("h", F.coalesce("base_own", F.lit(0)))).drop("b", "base_own")
    known = stored(known.withColumn("n", F.col("borrowed") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where((F.col("pos") < most - 1) & (F.col("conv") % block == 0)).select(F.col("conv").alias("b"), "pos", "t1", "t2", "chars")
    first = known.join(heads, F.expr("base = b AND pos < h")).select("conv", "n", (F.col("pos") + 1).alias("depth"), "t1", "t2", "chars")
    shift = known.select(F.col("conv").alias("c"), "n", "h", "borrowed")
    rest = turns.join(shift, F.expr("conv = c AND pos >= h")).select("conv", "n", (F.col("pos") - F.col("h") + F.col("borrowed") + 1).alias("depth"), "t1", "t2", "chars")
    return first.unionByName(rest), known.select("conv", "n")
