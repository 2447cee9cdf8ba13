"""Exact duplicates by an extendible-hash index kept in shared files.

1. Keys: (row key, XXH64, SHA-256, bytes) of every text go to a table in the shared folder.
2. Directory: the rows of each hash prefix are counted; starting from one slot, the directory doubles
   until no bucket is overfull (a bucket that doubling cannot relieve, because copies share all bits,
   stays at the greatest depth and chains).  It has at most 2 ** DEPTH slots.
3. Owners: texts go to the owner of their bucket, copies collapsed before they leave a task.  Sorted by
   hash within a bucket, each run of equal hashes is a chain whose texts are compared byte by byte.
4. The owners' classes are the index: written to the shared folder, one row per different text.
5. Each document takes its class from the index by (hash, digest); adaptive execution splits hot keys.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import BATCH_ROWS, stored, whole_text

#: Bits of the hash that the directory may use, so at most 65 536 slots whatever the input.
DEPTH = 16
#: Rows that a bucket holds before it splits.
BUCKET_ROWS = 4096
#: Bytes of texts that a task keeps to collapse further copies of them.
COLLAPSE_BYTES = 8 << 20


def directory(occupancy: np.ndarray, capacity: int) -> np.ndarray:
    """The bucket of each slot at the greatest depth, named by its first slot.

    occupancy: rows of each of the 2 ** d slots.  Each step doubles the directory and splits the
    buckets that hold more than `capacity` rows at the present depth.
    """
    slots = len(occupancy)
    bucket, width = np.zeros(slots, "i8"), slots
    while width > 1:
        held = np.add.reduceat(occupancy, np.arange(0, slots, width))
        whole = bucket[::width] == np.arange(0, slots, width)  # still a bucket of its own at this depth
        over = (held > capacity) & whole
        if not over.any():
            break
        width //= 2
        for first in (np.flatnonzero(over) * 2 + 1) * width:
            bucket[first : first + width] = first
    return bucket


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - DEPTH).cast("int")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a task become one row (bucket, h, sha, text, keep, n, and the kept row's other columns); what has shown copies is remembered and leaves at the end."""
    hot: dict[tuple, list] = {}
    held, schema = 0, None
    for batch in batches:
        new: dict[tuple, list] = {}
        schema = _partial(batch.schema, 5)
        for b, h, sha, text, doc, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = (h, text)
            seen = hot.get(k) or new.get(k)
            if seen is None:
                new[k] = [b, h, sha, text, doc, 1, *rest]
            else:
                _add(seen, 4, doc, 1, rest)
        for k in [k for k, v in new.items() if v[5] > 1]:
            hot[k] = new.pop(k)
            held += len(k[1])
        yield _rows(list(new.values()), schema)
        if held > COLLAPSE_BYTES:
            yield _rows(list(hot.values()), schema)
            hot, held = {}, 0
    if hot:
        yield _rows(list(hot.values()), schema)


_PARTIAL = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("sha", pa.string()), ("text", pa.binary()), ("keep", pa.int64()), ("n", pa.int64())])
_CLASS = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("sha", pa.string()), ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _partial(given: pa.Schema, at: int) -> pa.Schema:
    """The schema of collapsed rows, with the other columns that `given` has from `at` on."""
    return pa.schema([*_PARTIAL, *list(given)[at:]])


def _add(entry: list, at: int, doc: int | None, n: int, rest: list) -> None:
    """Count n more copies in an entry (keep at `at`, then n, then the other columns); the row of the larger doc_id gives the columns."""
    if doc is not None and (entry[at] is None or doc > entry[at]):
        entry[at], entry[at + 2 :] = doc, rest
    entry[at + 1] += n


def _rows(rows: list[list], schema: pa.Schema = _PARTIAL) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(hash, chain) of an owner's rows, which come sorted by hash: a chain has [bucket, sha, text, keep, n, other columns] of each different text, and only one is held at a time."""
    at, chain = None, []
    for batch in batches:
        for b, h, sha, text, keep, n, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h != at:
                if chain:
                    yield at, chain
                at, chain = h, []
            for e in chain:
                if e[2] == text:
                    _add(e, 3, keep, n, rest)
                    break
            else:
                chain.append([b, sha, text, keep, n, *rest])
    if chain:
        yield at, chain


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of the owner's buckets."""
    for part in _some(([e[0], h, e[1], k, e[3], e[4]] for h, chain in _chains(batches) for k, e in enumerate(chain)), BATCH_ROWS):
        yield _rows(part, _CLASS)


def _some(rows: Iterator[list], size: int) -> Iterator[list[list]]:
    while part := list(itertools.islice(rows, size)):
        yield part


def _owners(rows: DataFrame, counts: DataFrame, bucket_rows: int, rest: list[str]) -> DataFrame:
    """Collapsed rows at the owners of their buckets, sorted by hash.  rows: doc_id, text, h, sha and `rest`; counts: (slot, count)."""
    spark = rows.sparkSession
    held = np.zeros(1 << DEPTH, "i8")
    for slot, n in counts.collect():  # at most 2 ** DEPTH rows
        held[slot] = n
    # buckets keep the shape of the data, not its size: they grow with the input beyond the greatest directory
    bucket = directory(held, max(bucket_rows, int(held.sum()) >> (DEPTH - 2)))
    slots = spark.createDataFrame(pa.table({"slot": pa.array(np.arange(len(bucket)), pa.int32()), "bucket": pa.array(bucket, pa.int32())}))
    placed = rows.withColumn("slot", _slot(F.col("h"))).join(F.broadcast(slots), "slot").select("bucket", "h", "sha", "text", "doc_id", *rest)
    types = dict(placed.dtypes)
    partial = placed.mapInArrow(_collapse, ", ".join(["bucket int, h long, sha string, text binary, keep long, n long", *(f"`{c}` {types[c]}" for c in rest)]))
    return partial.repartition("bucket").sortWithinPartitions("h")


def _hashed(df: DataFrame, doc_id: str, text: str, rest: list[Column]) -> DataFrame:
    body = whole_text(df[f"`{text}`"]).cast("binary")
    rows = df.select(df[f"`{doc_id}`"].cast("long").alias("doc_id"), body.alias("text"), *rest)
    return rows.withColumns({"h": F.xxhash64("text"), "sha": F.sha2("text", 256)})


def build_index(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(keys, index): keys has doc_id, h, sha per row; index has bucket, h, sha, chain, keep_id, group_size per different text."""
    rows = _hashed(df, doc_id, text, [])
    keys = stored(rows.select("doc_id", "h", "sha"), "dedup-keys")
    counts = keys.groupBy(_slot(F.col("h")).alias("slot")).count()
    owned = _owners(rows, counts, bucket_rows, []).mapInArrow(_own, "bucket int, h long, sha string, chain int, keep_id long, group_size long")
    return keys, stored(owned, "dedup-index")


def exact_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id (the largest doc_id among equal texts), group_size, kept, text_sha256.

    Null text counts as empty.  Rows that repeat a doc_id are counted each, and all of them are kept if
    they are of the largest doc_id.  Null doc_id: such a row never stays unless its group has no other;
    its kept is null.  An empty table gives no rows.  Two different texts with equal XXH64 are told
    apart by their bytes within an owner and by SHA-256 outside.
    """
    keys, index = build_index(df, doc_id, text)
    found = keys.join(index.select("h", "sha", "keep_id", "group_size"), ["h", "sha"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def distinct_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of df per different text: that of the largest doc_id, with all its columns as they are.

    A null doc_id is smaller than any other; of rows that repeat id and text one stays; null and empty
    texts are equal, and the row that stays keeps the one it has.  An empty table gives no rows.  Texts
    are shuffled once: an owner has the kept row's other columns beside its text.
    """
    rest = [f"_{k}" for k in range(len(df.columns))]
    columns = [df[f"`{c}`"].alias(r) if c != text else df[f"`{c}`"].isNull().alias(r) for c, r in zip(df.columns, rest, strict=True)]
    rows = _hashed(df, doc_id, text, columns)
    counts = rows.groupBy(_slot(F.col("h")).alias("slot")).count()
    kept = _owners(rows, counts, bucket_rows, rest)
    types = dict(kept.dtypes)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field("text"), *list(first.schema)[6:]])
        for part in _some(([e[2], *e[5:]] for _, chain in _chains(itertools.chain([first], batches)) for e in chain), BATCH_ROWS):
            yield _rows(part, schema)

    out = kept.mapInArrow(own, ", ".join(["text binary", *(f"`{r}` {types[r]}" for r in rest)]))
    return out.select(*((F.when(~F.col(r), F.col("text").cast("string")) if c == text else F.col(r)).alias(c) for c, r in zip(df.columns, rest, strict=True)))
