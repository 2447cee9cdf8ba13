"""SimHash near duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes.  Two that differ in at most RADIUS bits share at least
8 - RADIUS of them: the count filter's guaranteed minimum.  Posting lists of single bytes would
grow with the square of the input, so the bytes are taken in four couples: as at most RADIUS couples
differ, qualifying pairs share two couples at least, and a posting's key is two couples (six keys of
four positional bytes).  A list of more than SHORT fingerprints is dealt into lists of two more shared
bytes.  The pairs that meet in a list are tallied, byte position by byte position; those that reach the
guaranteed minimum are verified bit by bit.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import among, stored, unused, whole_text, without
from propgraph.llm.components import components

RADIUS = 2
#: Fixed values of the fingerprint's definition.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15
#: Fingerprints of a posting list whose pairs are all tallied; a longer list is dealt into lists of more shared bytes.
SHORT = 64


def words_of(text: str) -> list[bytes]:
    """The words in UTF-8, A-Z as a-z: lower() of bytes changes no others."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The XXH64 of each shingle, repeats included: of fewer words the whole sequence, of none nothing."""
    import xxhash

    tokens = words_of(text)
    if not tokens:
        return np.zeros(0, "<u8")
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype="<u8")


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bytes of the bits that more than half of the hashes have."""
    ones = np.zeros(64, "i8")
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].view("u1").reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return np.packbits(2 * ones > len(hashes), bitorder="little")


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit fingerprint: a bit is one if more than half of the shingles' XXH64 have it."""
    return int(_majority(shingle_hashes(text, words)).view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp: long) of every row; null text counts as empty and has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype="u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return df.select(df[f"`{doc_id}`"].cast("long").alias("doc_id"), whole_text(df[f"`{text}`"]).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(radius: int) -> tuple[list[int], list[list[int]]]:
    """Bits of the positional bytes of each posting key of the first kind, and of the keys into which its long lists are dealt."""
    couple = [0xFFFF << (16 * k) for k in range(4)]
    first, second = [], []
    for shared in itertools.combinations(range(4), 4 - radius):
        mask = sum(couple[k] for k in shared)
        rest = [0xFF << (8 * b) for k in range(4) if k not in shared for b in (2 * k, 2 * k + 1)]
        first.append(_signed(mask))
        second.append([_signed(mask + sum(more)) for more in itertools.combinations(rest, len(rest) - radius)])
    return first, second


def _links(keys: np.ndarray, fps: np.ndarray, masks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among fingerprints of equal posting key whose tally of shared positional bytes reaches 8 - radius; keys are sorted, fps ascending within a key.

    Lists of up to SHORT are compared at growing distance in the list; a longer one (of six bytes, so of 65 536
    fingerprints at most) looks up each fingerprint's neighbours, and links it to the smaller ones found.
    """
    a, b = [], []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([starts, [len(keys)]]))
    longest = int(size[size <= SHORT].max(initial=0))
    left = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(starts, size))  # rows from here to the list's end
    short = np.repeat(size <= SHORT, size)
    for step in range(1, longest):
        i = np.flatnonzero(short & (left > step))
        tally = (np.ascontiguousarray(fps[i] ^ fps[i + step]).view("u1").reshape(-1, 8) == 0).sum(axis=1)
        kept = i[tally >= 8 - radius]
        a.append(fps[kept])
        b.append(fps[kept + step])
    for s, n in zip(starts[size > SHORT], size[size > SHORT], strict=True):
        own, free = fps[s : s + n], ~masks[s]
        bits = [np.uint64(1 << k) for k in range(64) if int(free) >> k & 1]
        for k in range(1, radius + 1):
            for flips in itertools.combinations(bits, k):
                other = own ^ np.bitwise_or.reduce(np.array(flips, "u8"))
                at = np.minimum(np.searchsorted(own, other), n - 1)
                hit = (own[at] == other) & (other < own)
                a.append(own[hit])
                b.append(other[hit])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, "u8"), np.zeros(0, "u8"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of fingerprints at most radius bits apart.  distinct: fp, each once.

    Output is bounded by the links that a posting list needs: a list of up to SHORT gives its pairs, a longer
    one is dealt into lists of more shared bytes, where each fingerprint has at most 136 neighbours.
    """
    first, second = _masks(radius)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = distinct.select("fp", F.posexplode(F.array(*map(F.lit, first))).alias("combo", "mask")).select("combo", "mask", F.expr("fp & mask").alias("bytes"), "fp")
    long = lists.groupBy("combo", "bytes").count().where(F.col("count") > SHORT).select("combo", "bytes", F.lit(True).alias("long"))
    finer = F.get(F.array(*(F.array(*map(F.lit, own)) for own in second)), F.col("combo"))
    split = lists.join(long, ["combo", "bytes"], "left").select("fp", F.explode(F.when(F.col("long"), finer).otherwise(F.array("mask"))).alias("mask"))
    postings = split.select("mask", F.expr("fp & mask").alias("bytes"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # rows of the last list, which may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [c.to_numpy().view("u8") for c in batch.columns]
                rows = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
                change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
                end = int(change[-1]) + 1 if len(change) else 0
                kept, rows = [r[end:] for r in rows], [r[:end] for r in rows]
            elif kept is None:
                return
            else:
                rows = kept
            if len(rows[0]) > 1:
                order = np.lexsort((rows[2], rows[1], rows[0]))
                mask, part, fp = (r[order] for r in rows)
                key = np.cumsum(np.concatenate([[False], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])]))
                a, b = _links(key, fp, mask, radius)
                good = np.bitwise_count(a ^ b) <= radius
                yield pa.RecordBatch.from_arrays([pa.array(a[good].view("i8")), pa.array(b[good].view("i8"))], names=["a", "b"])

    return postings.repartition(n, "mask", "bytes").sortWithinPartitions("mask", "bytes").mapInArrow(run, "a long, b long")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Texts without words have fingerprint zero and are linked like any other.  Repeated rows and equal
    fingerprints are one node; a null doc_id is kept, and is no component's name while another doc_id
    is there.  An empty table gives no rows.
    """
    prints = stored(fingerprints(df, doc_id, text), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    tied = components(links(nodes.select("fp"), radius))
    named = nodes.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    name = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(name, "component").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of word shingles -------------------------------------------------------------------

#: Words of a shingle and least Jaccard similarity of near duplicates.
NEAR_WORDS, NEAR = 5, 0.8
#: Words of the shingles that a wide fingerprint is made of: an edit changes fewer couples of words than runs of five.
WIDE_WORDS = 2
#: A wide fingerprint has 32 positional bytes, of which each posting key joins KEY_BYTES.
WIDE, KEYS, KEY_BYTES = 32, 96, 3
#: Beside its key a posting has 64 of the other bits; candidates differ in at most PART_RADIUS of them.
PART_RADIUS = 22
#: Fingerprints of a posting list that gives all its pairs; a longer one gives links that connect it.
SHORT_LIST = 16
#: Rows up to which a list's links join close pairs only; a longer list is one family as it is.
LIST_ROWS = 1 << 16
#: Posting keys whose links of long lists are verified as pairs; the links of the others only tell families.
TRIED_KEYS = 6
#: About so many rows of a family make a block; two blocks are compared at a time.
FAMILY_BLOCK = 1024
#: In place of a component's name: the small components of a family together.
SMALL = -(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """The XXH64 of each word of the lower-cased text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(t, SEED) for t in words_of(text)], "<u8")


def distinct_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct n-word shingles, made of the words' hashes, sorted: of fewer words the whole sequence, of none nothing."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, "<u8")
    end = len(words) - n + 1
    h = words[:end]
    for k in range(1, n):
        h = _mixed(h + np.uint64(k)) ^ words[k : k + end]
    h = np.sort(_mixed(h + np.uint64(n)))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def wide_fingerprint(words: np.ndarray) -> bytes:
    """256 bits over the distinct two-word shingles: 64 of their hashes, and 64 of each of three further mixes of them.

    Distinct, as the similarity is one of sets: a set of five-word shingles has one set of two-word ones,
    however often a line repeats.
    """
    h = distinct_shingles(words, WIDE_WORDS)
    parts = []
    for _ in range(WIDE // 8):
        parts.append(_majority(h).tobytes())
        h = _mixed(h)
    return b"".join(parts)


def _key_positions() -> np.ndarray:
    """The byte positions of each posting key: fixed draws, evenly spread over the fingerprint."""
    rng = np.random.default_rng(11)
    return np.concatenate([rng.permutation(WIDE)[: WIDE // KEY_BYTES * KEY_BYTES].reshape(-1, KEY_BYTES) for _ in range(-(-KEYS // (WIDE // KEY_BYTES)))])[:KEYS]


def _part_positions(own: np.ndarray) -> list[int]:
    """Eight positions that a key of positions `own` does not have."""
    rest = [p for p in range(WIDE) if p not in own.tolist()]
    return [rest[(int(own[0]) + 3 * k) % len(rest)] for k in range(8)]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, part) of each posting key of the fingerprints (node, fp)."""
    keys = _key_positions()
    parts = [_part_positions(own) for own in keys]
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u1").reshape(-1, WIDE)
        key = np.stack([(k << 24) + sum(prints[:, p].astype("i4") << (8 * j) for j, p in enumerate(own)) for k, own in enumerate(keys)], axis=1)
        part = np.stack([np.ascontiguousarray(prints[:, own]).view("<i8")[:, 0] for own in parts], axis=1)
        node = np.repeat(batch.column(0).to_numpy(), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype("i4")), pa.array(node), pa.array(part.ravel())], names=["key", "node", "part"])


def _chained(parts: np.ndarray, nodes: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what chains of close pairs connect among one list's rows: each found row looks at the rows not found yet."""
    a, b = [], []
    left = np.arange(len(nodes))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(parts[left] ^ parts[i]) <= PART_RADIUS
            hit = left[near]
            a += [int(nodes[i])] * len(hit)
            b += nodes[hit].tolist()
            queue += hit.tolist()
            left = left[~near]
    return a, b


#: What a row of candidates is: a pair of a short list, a link of a long list that is tried as a pair too, or one that only tells a family.
PAIR, TRIED, FAMILY = 0, 1, 2


def _candidates(batches: Iterator[pa.RecordBatch], short_list: int, list_rows: int) -> Iterator[pa.RecordBatch]:
    """(a, b, kind) of the task's posting lists, whose rows (key, node, part) come sorted by key and node."""

    def given(a: list[int], b: list[int], kind: list[int]) -> pa.RecordBatch:
        one, two = np.array(a, "i8"), np.array(b, "i8")
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(kind, pa.int32())], names=["a", "b", "kind"])

    kept: list | None = None
    first = None  # the first node of a list that has passed list_rows
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view("u8")]
            rows = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
            change = np.flatnonzero(rows[0][1:] != rows[0][:-1])
            end = int(change[-1]) + 1 if len(change) else 0
            kept, rows = [r[end:] for r in rows], [r[:end] for r in rows]
        elif kept is None:
            return
        else:
            rows, kept = kept, None
        key, node, part = rows
        a, b, kind = [], [], []
        if len(key):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([starts, [len(key)]]))
            long = size > short_list
            if first is not None:  # the rest of a list that was long before
                long[0] = True
            left = np.where(np.repeat(long, size), 0, np.repeat(starts + size, size) - np.arange(len(key)))
            for step in range(1, short_list):
                i = np.flatnonzero(left > step)
                near = i[np.bitwise_count(part[i] ^ part[i + step]) <= PART_RADIUS]
                a += node[near].tolist()
                b += node[near + step].tolist()
            kind += [PAIR] * len(a)
            for s, n in zip(starts[long].tolist(), size[long].tolist(), strict=True):
                if first is not None and s == 0:
                    more = ([first] * n, node[:n].tolist())
                    first = None
                else:
                    more = _chained(part[s : s + n], node[s : s + n])
                a += more[0]
                b += more[1]
                kind += [TRIED if key[s] >> 24 < TRIED_KEYS else FAMILY] * len(more[0])
        if kept is not None and len(kept[0]) > list_rows:
            first = int(kept[1][0]) if first is None else first
            a += [first] * len(kept[1])
            b += kept[1].tolist()
            kind += [FAMILY] * len(kept[1])
            kept = [r[-1:] for r in kept]  # a row to tell the list by
        yield given(a, b, kind)


def _shared(one: list[np.ndarray], two: list[np.ndarray], ids: int) -> Iterator[np.ndarray]:
    """For each set of `one`, how many of its members each set of `two` has; members are numbers below `ids`, no set is empty."""
    seen = np.zeros(ids, "i4")
    flat, starts = np.concatenate(two), np.cumsum([0, *map(len, two[:-1])])
    for own in one:
        seen[own] = 1
        yield np.add.reduceat(seen[flat], starts)
        seen[own] = 0


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components, of cells (cell, side, node, component, shingles): sets of side 0 against those of side 1, or of side 0 alone among themselves.

    Each is of similarity NEAR or more; of links that join the same components one is given.
    """

    def cell(rows: list) -> pa.RecordBatch:
        side, node, component, sets = np.array(rows[0]), np.array(rows[1]), np.array(rows[2]), rows[3]
        ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        sets = np.split(flat, np.cumsum(sizes)[:-1])
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if (side == 1).any() else one
        a, b = [], []
        for i, both in zip(one.tolist(), _shared([sets[k] for k in one], [sets[k] for k in two], len(ids)), strict=True):
            near = both >= NEAR * (sizes[i] + sizes[two] - both) - 1e-9
            for j in two[near].tolist():
                if component[j] != component[i]:
                    a.append(int(node[i]))
                    b.append(int(node[j]))
                    component[component == component[j]] = component[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    at, rows = None, [[], [], [], []]
    for batch in batches:
        for own, side, node, component, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != at and rows[0]:
                yield cell(rows)
                rows = [[], [], [], []]
            at = own
            for column, x in zip(rows, (side, node, component, np.frombuffer(packed, "<u4")), strict=True):
                column.append(x)
    if rows[0]:
        yield cell(rows)


def _between(families: DataFrame, tied: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links (a, b) within families (node, family) that join components which tied (node, component) has apart: with them no pair of a family is left out.

    Families of one component need none.  The others are dealt into blocks, a component of half a block or more
    into blocks of its own, and every two blocks that can hold different components are compared, in a cell of
    their own: a family of any length is spread over tasks, and what is one component already is not compared again.
    """
    n = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = families.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = now.groupBy("family", "component").agg(F.count("*").alias("rows"))
    held = held.withColumn("lump", F.when(F.col("rows") >= block // 2, F.col("component")).otherwise(F.lit(SMALL)))
    lumps = held.groupBy("family", "lump").agg(F.sum("rows").alias("rows"), F.count("*").alias("components"))
    open_ = lumps.groupBy("family").agg(F.sum("components").alias("components")).where("components > 1").select("family")
    lumps = stored(lumps.join(open_, "family", "left_semi").select("family", "lump", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "near-lumps")
    blocks = lumps.select("family", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("lump").alias("lump"), k.alias("part")))).alias("block"))
    one, two = F.col("block"), F.col("other")
    apart = (one < two) & ((one["lump"] != two["lump"]) | (one["lump"] == SMALL))
    alone = (one == two) & (one["lump"] == SMALL)
    cells = blocks.join(blocks.withColumnRenamed("block", "other"), "family").where(apart | alone)
    side = lambda k, of: F.struct(F.lit(k).alias("side"), of.alias("block"))
    sides = cells.select("family", F.xxhash64("family", one, two).alias("cell"), F.explode(F.when(alone, F.array(side(0, one))).otherwise(F.array(side(0, one), side(1, two)))).alias("s"))
    sides = sides.select("family", "cell", "s.side", F.col("s.block.lump").alias("lump"), F.col("s.block.part").alias("part"))
    placed = now.join(held.select("family", "component", "lump"), ["family", "component"]).join(lumps, ["family", "lump"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = placed.join(sides, ["family", "lump", "part"]).select("cell", "side", "node", "component").join(sets, "node").select("cell", "side", "node", "component", "shingles")
    return rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_across, "a long, b long")


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", short_list: int = SHORT_LIST, list_rows: int = LIST_ROWS, block: int = FAMILY_BLOCK) -> DataFrame:
    """(doc_id, component_id) of every row: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

    Candidates share the positional bytes of a posting key of 256-bit fingerprints and differ in at most
    PART_RADIUS of 64 further bits; each is verified on its shingle sets.  A list of up to short_list fingerprints
    gives its pairs.  A longer one gives the links that connect it: what they connect is a family, some of them are
    verified like pairs, and then all pairs of a family that are in different components still are compared.  Equal
    shingle sets (the same SHA-256 of the sorted hashes) are one node, named by the smallest doc_id; equal
    fingerprints of different sets are candidates like any other.  Texts without words are one class.  Repeated
    ids are one node (`without_near_copies` numbers rows where there are any), rows of null doc_id are left out, and an empty table gives no rows.  Texts are not shuffled.
    """
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t) for t in batch.column(1).to_pylist()]
            own = [distinct_shingles(w, NEAR_WORDS) for w in words]
            digests = pa.array([hashlib.sha256(x.tobytes()).digest() for x in own], pa.binary())
            columns = [batch.column(0), pa.array([wide_fingerprint(w) for w in words], pa.binary()), digests, pa.array([len(x) for x in own], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "set", "size"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(distinct_shingles(word_hashes(t), NEAR_WORDS).astype("<u4")).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "shingles"])

    body = df.where(df[f"`{doc_id}`"].isNotNull()).select(df[f"`{doc_id}`"].cast("long").alias("doc_id"), whole_text(df[f"`{text}`"]).alias("text"))
    prints = stored(body.mapInArrow(run, "doc_id long, fp binary, set binary, size int"), "wide-prints")
    nodes = prints.groupBy("set").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("size").alias("size"))
    nodes = stored(nodes, "near-nodes")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = nodes.where("size > 0").select("node", "fp").mapInArrow(_postings, "key int, node long, part long")
    lists = postings.repartition(n, "key").sortWithinPartitions("key", "node")  # lists of one group have one root, so their links are the same rows
    found = stored(lists.mapInArrow(lambda batches: _candidates(batches, short_list, list_rows), "a long, b long, kind int").distinct(), "near-lists")
    families = components(found.where(F.col("kind") != PAIR).select("a", "b"))
    families = families.select("node", F.col("component").alias("family"))

    wanted = found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = among(body, stored(wanted, "near-wanted"), "doc_id", lambda rows: rows.mapInArrow(shingles, "node long, shingles binary"), "node")
    sets = stored(sets.dropDuplicates(["node"]), "near-sets")
    pairs = found.where(F.col("kind") != FAMILY).select("a", "b").where("a <> b").distinct()

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(x, "<u4") for x in batch.column(k).to_pylist()] for k in (2, 3))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two, strict=True)], "i8")
            near = both >= NEAR * (np.array([len(x) for x in one], "i8") + np.array([len(y) for y in two], "i8") - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    two = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
    tied = components(two.select("a", "b", "one", "two").mapInArrow(agree, "a long, b long"))
    more = stored(_between(families, tied, sets, block), "near-more")
    if not more.isEmpty():
        tied = components(more.union(tied.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = prints.select("doc_id", "set").join(nodes.select("set", "node"), "set").join(tied, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return named.distinct()


def without_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows but those of which a near duplicate (`near_classes`) of a smaller doc_id stays; null ids come before all others.

    Where ids are null or repeat, rows are numbered in order of id first, so that each is a document of its own.
    """
    ids = df.select(df[f"`{doc_id}`"].alias("id"))
    if ids.groupBy("id").count().where("id IS NULL OR count > 1").isEmpty():
        rows, key = df, doc_id
    else:
        key = unused(df, "row")
        rows = stored(df.repartitionByRange(df[f"`{doc_id}`"], F.xxhash64(df[f"`{text}`"])).sortWithinPartitions(df[f"`{doc_id}`"]).withColumn(key, F.monotonically_increasing_id()), "numbered")
    classes = near_classes(rows, key, text)
    gone = stored(classes.where("doc_id <> component_id").select("doc_id"), "near-gone")
    return without(rows, gone, key).select(*(f"`{c}`" for c in df.columns))
